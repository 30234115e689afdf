"""Walks, paths and distances, by frontier joins; best-first search where the result depends on the search order."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import graph_files, opened
from ..functions.storage import written
from ..functions.words import is_trap, surprise
from ..graph import WordGraph
from .multistep import information_gain

#: Moves that a worker's search keeps worked out, some 60 bytes each.
HELD_MOVES = 2_000_000


def _starts(graph: WordGraph, words) -> DataFrame:
    return words if isinstance(words, DataFrame) else graph.edges.sparkSession.createDataFrame([(w,) for w in words], "word string")


def trap_pathways(graph: WordGraph, words, max_steps: int = 3, min_weight: float = 0.01) -> DataFrame:
    """word, letter, target, path (words after the start), length, total_weight: all walks of at most max_steps moves over edges of
    min_weight or more that end at their first trap. A word stands once in a path, but the start may come back once."""
    e = written(graph.edges.where(F.col("weight") >= min_weight).select("src", "dst", "weight", is_trap("dst", graph.letters).alias("trap")), "walk-edges")
    front = _starts(graph, words).select("word", F.col("word").alias("at"), F.array().cast("array<string>").alias("path"), F.lit(0.0).alias("total_weight"))
    found = None
    for step in range(1, max_steps + 1):
        grown = front.join(e, front["at"] == e["src"]).select("word", F.col("dst").alias("at"), "path", (F.col("total_weight") + F.col("weight")).alias("total_weight"), "trap")
        grown = written(grown.where(F.col("trap") | ~F.array_contains("path", F.col("at"))).withColumn("path", F.concat("path", F.array("at"))), f"walk-{step}")
        ended = grown.where("trap").select("word", F.upper(F.substring("at", 1, 1)).alias("letter"), F.col("at").alias("target"), "path", F.lit(step).alias("length"), "total_weight")
        found = ended if found is None else found.unionByName(ended)
        front = grown.where("not trap").drop("trap")
    return found


def best_pathways(pathways: DataFrame, k: int = 5) -> DataFrame:
    """The k heaviest pathways of each (word, letter); ties by the path's text."""
    order = Window.partitionBy("word", "letter").orderBy(F.col("total_weight").desc(), F.array_join("path", " "))
    return pathways.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def direct_targets(graph: WordGraph, words) -> DataFrame:
    """word, direct_traps, neighbors, direct_share (a share of counts, not of weights)."""
    rows = graph.edges.join(_starts(graph, words).select(F.col("word").alias("src")), "src", "left_semi")
    return rows.groupBy(F.col("src").alias("word")).agg(F.count_if(is_trap("dst", graph.letters)).alias("direct_traps"), F.count("*").alias("neighbors")).withColumn("direct_share", F.col("direct_traps") / F.col("neighbors"))


def distances(graph: WordGraph, words, max_depth: int = 3) -> DataFrame:
    """start, word, depth: every word within max_depth moves, level by level; visited words drop out by an anti join."""
    seen = written(_starts(graph, words).select(F.col("word").alias("start"), "word", F.lit(0).alias("depth")), "bfs-0")
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(graph.edges.select(F.col("src").alias("word"), F.col("dst").alias("next")), "word").select("start", F.col("next").alias("word")).distinct()
        front = written(step.join(seen.select("start", "word"), ["start", "word"], "left_anti").withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(graph: WordGraph, pairs: DataFrame, max_depth: int = 4) -> DataFrame:
    """pairs(start, target) -> path, product (of raw weights): the first path in breadth-first order, ties by the path's words;
    equal words give themselves with product 1, unreachable ones a null path with product 0. A path has at most max_depth words."""
    targets = pairs.select("start", "target").distinct()
    front = targets.select("start").distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"), F.lit(1.0).alias("product"))
    seen = written(front, "sp-1")
    front = seen
    for depth in range(2, max_depth + 1):
        grown = front.join(graph.edges, front["at"] == graph.edges["src"]).select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("product") * F.col("weight")).alias("product"))
        grown = grown.groupBy("start", "at").agg(F.min(F.struct("path", "product")).alias("m")).select("start", "at", "m.path", "m.product")
        front = written(grown.join(seen.select("start", "at"), ["start", "at"], "left_anti"), f"sp-{depth}")
        seen = seen.unionByName(front)
    return targets.join(seen.withColumnRenamed("at", "target"), ["start", "target"], "left").select("start", "target", "path", F.coalesce("product", F.lit(0.0)).alias("product"))


def ways_to(graph: WordGraph, targets: DataFrame, longest: int) -> DataFrame:
    """target, word, words, product: for every word the number of words on, and the product of raw weights along, its first path in breadth-first
    order to the target (ties by the path's words), up to `longest` words. One backward search from each target: the first step of such a path
    is the smallest neighbour that is a move nearer."""
    front = written(targets.select("target", F.col("target").alias("word"), F.lit(1).alias("words"), F.lit(1.0).alias("product")), "ways-1")
    seen = front
    for words in range(2, longest + 1):
        steps = front.join(graph.edges, front["word"] == graph.edges["dst"]).groupBy("target", F.col("src").alias("at")).agg(F.min(F.struct("dst", (F.col("weight") * F.col("product")).alias("product"))).alias("m"))
        steps = steps.select("target", F.col("at").alias("word"), F.lit(words).alias("words"), "m.product")
        front = written(steps.join(seen.select("target", "word"), ["target", "word"], "left_anti"), f"ways-{words}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def path_measures(graph: WordGraph, words, max_steps: int = 3, min_weight: float = 0.0) -> DataFrame:
    """Simple paths from each word to their first trap with steps, probability, entropy, gain and score (the declarative search).

    score = .3 probability + .25 / (1 + steps) + .25 gain + .2 / (1 + entropy)."""
    kept = graph.edges.where(F.col("weight") >= min_weight).select("src", "dst").withColumn("kept", F.lit(True))
    e = information_gain(graph).join(kept, ["src", "dst"], "left_semi")
    e = written(e.select("src", "dst", "p", "gain", is_trap("dst", graph.letters).alias("trap")), "path-edges")
    front = _starts(graph, words).where(~is_trap("word", graph.letters)).select("word", F.col("word").alias("at"), F.array("word").alias("path"), F.lit(1.0).alias("probability"), F.lit(0.0).alias("entropy"), F.lit(0.0).alias("gain"))
    found = None
    for step in range(1, max_steps + 1):
        e2 = e.withColumnRenamed("gain", "g")
        grown = front.join(e2, front["at"] == e2["src"]).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("word", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("probability") * F.col("p")).alias("probability"), (F.col("entropy") + surprise("p")).alias("entropy"), (F.col("gain") + F.col("g")).alias("gain"), "trap")
        grown = written(grown, f"path-{step}")
        ended = grown.where("trap").select("word", F.col("at").alias("target"), "path", F.lit(step).alias("steps"), "probability", "entropy", "gain")
        found = ended if found is None else found.unionByName(ended)
        front = grown.where("not trap").drop("trap")
    score = 0.3 * F.col("probability") + 0.25 / (1 + F.col("steps")) + 0.25 * F.col("gain") + 0.2 / (1 + F.col("entropy"))
    return found.withColumn("score", score)


class _Moves:
    """The moves of a word that have a probability, those that promise most before the path's entropy counts first."""

    __slots__ = ("word", "p", "bits", "gain", "near", "ahead", "bound", "rows")

    def __init__(self, arrays, word: int):
        d, w = arrays.out(word)
        p = w / (arrays.total[word] or 1.0)
        d, p = d[p > 0], p[p > 0]
        bits = np.log2(p)
        gain = np.maximum(0.0, bits - (p * bits).sum())
        near, ahead = 0.4 * p + 0.3 * gain, 0.1 * arrays.share[d]
        order = np.argsort(-(near + ahead), kind="stable")
        self.word, self.p, self.bits, self.gain, self.near, self.ahead = (x[order] for x in (d, p, p * bits, gain, near, ahead))
        # what the moves from each place on can promise at most: the static part and the least surprise
        self.bound = self.near + self.ahead, np.minimum.accumulate(-self.bits[::-1])[::-1]
        self.rows: list[tuple] = []

    def __len__(self) -> int:
        return len(self.word)

    def first(self, n: int) -> list[tuple]:
        """(next word, p, its surprise, gain, the parts of its promise) of the first n moves."""
        if len(self.rows) < min(n, len(self.word)):
            part = slice(len(self.rows), n)
            self.rows += zip(*(x[part].tolist() for x in (self.word, self.p, self.bits, self.gain, self.near, self.ahead)))
        return self.rows

    def most(self, place: int, entropy: float) -> float:
        """A promise that no move from `place` on passes, for a path of this entropy."""
        static, surprise_ = self.bound
        return float(static[place] + 0.2 / (1 + entropy + surprise_[place])) + 1e-9


class _Search:
    """Best-first search over a graph's arrays. Words are numbers in their order, so paths compare as their words do."""

    def __init__(self, arrays):
        self.arrays, self.trap = arrays, arrays.words.traps
        self.held: dict[int, _Moves] = {}
        self.size = 0

    def _moves(self, word: int) -> _Moves:
        """A word's moves, worked out when first asked for; all are dropped when there are too many."""
        if word not in self.held:
            found = _Moves(self.arrays, word)
            self.size += len(found) + 50
            if self.size > HELD_MOVES:
                self.held.clear()
                self.size = len(found) + 50
            self.held[word] = found
        return self.held[word]

    def reaches(self, start: int, max_steps: int, least: float) -> bool:
        """Whether any simple path from start to its first trap within max_steps has a probability over least (under 1 / least ways a step)."""
        stack = [((start,), 1.0)]
        while stack:
            path, prob = stack.pop()
            if self.trap[path[-1]]:
                return True
            if len(path) <= max_steps:
                d, w = self.arrays.out(path[-1])
                p = prob * (w / (self.arrays.total[path[-1]] or 1.0))
                over = np.flatnonzero(p > least)
                stack += [((*path, x), q) for x, q in zip(d[over].tolist(), p[over].tolist()) if x not in path]
        return False

    def states(self, start: int, max_steps: int) -> Iterator[tuple]:
        """(promise, steps, path, probability, entropy, gain) in the order of the search: the best promise first, then fewer steps, then the path; of
        all ways to be at a word after so many steps the first one alone. Traps and states of max_steps have no successors.

        A state's successors come on the agenda some at a time. What stands for the rest has -1 steps and the most that the rest can promise, so it
        is taken before any of them."""
        agenda, met = [(0.0, 0, (start,), 1.0, 0.0, 0.0)], set()
        while agenda:
            state = heapq.heappop(agenda)
            if state[1] < 0:
                self._grow(agenda, met, *state[6:])
                continue
            place = state[2][-1], state[1]
            if place not in met:
                met.add(place)
                yield state
                if state[1] < max_steps and not self.trap[place[0]]:
                    self._grow(agenda, met, state, 0)

    def _grow(self, agenda: list, met: set, state: tuple, done: int) -> None:
        """The next successors of a state, over words that are not in the path yet; only the last move and the path's entropy make a promise."""
        _, steps, path, prob, entropy, gain = state
        moves, more = self._moves(path[-1]), max(16, 2 * done)
        for d, p, bits, g, near, ahead in itertools.islice(moves.first(more), done, more):
            if d not in path and (d, steps + 1) not in met:
                own = entropy - bits
                heapq.heappush(agenda, (-(near + 0.2 / (1 + own) + ahead), steps + 1, (*path, d), prob * p, own, gain + g))
        if more < len(moves):
            heapq.heappush(agenda, (-moves.most(more, entropy), -1, path, 0.0, 0.0, 0.0, state, more))

    def paths(self, start: int, max_steps: int, max_paths: int) -> list[tuple]:
        """(path, steps, probability, entropy, gain, score), by score, of the first max_paths states of the search that are traps."""
        ends = itertools.islice((s for s in self.states(start, max_steps) if self.trap[s[2][-1]]), max_paths)
        scored = [(path, steps, prob, entropy, gain, 0.3 * prob + 0.25 / (1 + steps) + 0.25 * gain + 0.2 / (1 + entropy)) for _, steps, path, prob, entropy, gain in ends]
        words = self.arrays.words.words
        return [(words.take(path).to_pylist(), *more) for path, *more in sorted(scored, key=lambda x: (-x[5], x[0]))]


def best_first_paths(graph: WordGraph, words, max_steps: int = 5, max_paths: int = 10, least: float = 0.0) -> DataFrame:
    """word, path, steps, probability, entropy, gain, score: paths to traps in the order of a best-first search.

    A state (word, steps) closes when it is first popped, so which paths are found depends on that order; each start is searched on its own.
    The workers read the whole graph as arrays from the shared folder, whatever its size. With `least`, of the paths found only those of a
    probability over it are given; starts that no such path leaves are not searched."""
    spark = graph.edges.sparkSession
    starts = _starts(graph, words).select("word")
    files, letters = graph_files(graph), graph.letters
    cols = ["word", "path", "steps", "probability", "entropy", "gain", "score"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _Search(opened(files))
        for b in batches:
            rows = []
            for w, i in zip(b["word"], s.arrays.words.ids(b["word"])):
                if i is None:  # a word of no edge is a path if it is a trap itself
                    found = [([w], 0, 1.0, 0.0, 0.0, 0.3 + 0.25 + 0.2)] if w and w[0].lower() in letters else []
                else:
                    found = s.paths(i, max_steps, max_paths) if not least or s.reaches(i, max_steps, least) else []
                rows += [(w, *x) for x in found if x[2] > least]
            yield pd.DataFrame(rows, columns=cols)

    return starts.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(search, "word string, path array<string>, steps int, probability double, entropy double, gain double, score double")
