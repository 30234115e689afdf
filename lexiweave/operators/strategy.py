"""Strategic analysis and move evaluation, for all candidate words at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import is_trap
from ..graph import WordGraph
from .multistep import first_hit
from .paths import best_first_paths
from .ranking import recommend


@dataclass(frozen=True)
class Difficulty:
    lookahead: int
    safety: float
    aggression: float
    min_escape: int
    patterns: bool


# The four difficulty settings.
DIFFICULTIES = {
    "easy": Difficulty(2, 0.8, 0.2, 2, False),
    "medium": Difficulty(3, 0.65, 0.35, 1, True),
    "hard": Difficulty(4, 0.5, 0.5, 1, True),
    "expert": Difficulty(5, 0.4, 0.6, 0, True),
}


def analyze(graph: WordGraph, words: DataFrame, max_k: int = 5, keep: int = 5) -> DataFrame:
    """For each of words(word): cumulative (array over steps 1..max_k), total, path_count, avg_entropy, max_gain, best paths, strategic score.

    The score is 0 without paths; else .5 mean(cumulative) + .3 min(1, mean(gain / max(1, steps))) + .2 min(1, paths / 10)."""
    hits = first_hit(graph, max_k).join(words, "word", "left_semi").groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "cumulative"))), lambda x: x["cumulative"]).alias("cumulative"))
    p = best_first_paths(graph, words, max_k, 10)
    per = p.groupBy("word").agg(
        F.count("*").alias("path_count"),
        F.avg("entropy").alias("avg_entropy"),
        F.max("gain").alias("max_gain"),
        F.avg(F.col("gain") / F.greatest(F.lit(1), F.col("steps"))).alias("_rate"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_s"), F.col("path")))), 1, keep).alias("_p"),
    )
    zero = F.transform(F.sequence(F.lit(1), F.lit(max_k)), lambda _: F.lit(0.0))
    rows = words.join(hits, "word", "left").join(per, "word", "left").withColumn("cumulative", F.coalesce("cumulative", zero))
    mean = F.aggregate("cumulative", F.lit(0.0), lambda a, x: a + x) / F.lit(float(max_k))
    score = F.when(F.col("path_count") > 0, 0.5 * mean + 0.3 * F.least(F.lit(1.0), "_rate") + 0.2 * F.least(F.lit(1.0), F.col("path_count") / 10)).otherwise(F.lit(0.0))
    return rows.select("word", "cumulative", F.element_at("cumulative", -1).alias("total"), F.coalesce("path_count", F.lit(0)).alias("path_count"), F.coalesce("avg_entropy", F.lit(0.0)).alias("avg_entropy"), F.coalesce("max_gain", F.lit(0.0)).alias("max_gain"), F.transform("_p", lambda x: x["path"]).alias("paths"), score.alias("strategic"))


def self_safety(graph: WordGraph, lookahead: int = 3) -> DataFrame:
    """word, safety: 0 for traps; else .7 (1 - cumulative hit within lookahead) + .3 share of non-trap neighbours (the first part alone without neighbours)."""
    hit = first_hit(graph, lookahead).where(F.col("step") == lookahead).select("word", F.col("cumulative").alias("hit"))
    free = graph.edges.groupBy(F.col("src").alias("word")).agg((F.count_if(~is_trap("dst", graph.letters)) / F.count("*")).alias("free"))
    rows = graph.words.join(hit, "word", "left").join(free, "word", "left")
    base = 1.0 - F.coalesce("hit", F.lit(0.0))
    return rows.select("word", F.when(F.col("is_trap"), F.lit(0.0)).when(F.col("free").isNotNull(), 0.7 * base + 0.3 * F.col("free")).otherwise(base).alias("safety"))


def opponent_danger(graph: WordGraph, lookahead: int = 3) -> DataFrame:
    """word, danger: expected hit probability of the opponent's next word, over non-trap neighbours (shares of the full total)."""
    k = max(1, lookahead - 1)
    hit = first_hit(graph, k).where(F.col("step") == k).select(F.col("word").alias("dst"), F.col("cumulative").alias("hit"))
    return graph.moves.where("not trap").join(hit, "dst").groupBy(F.col("src").alias("word")).agg(F.sum(F.col("p") * F.col("hit")).alias("danger"))


def escape_routes(graph: WordGraph) -> DataFrame:
    """word, routes: non-trap neighbours that have a non-trap neighbour themselves."""
    safe = graph.edges.where(~is_trap("dst", graph.letters))
    return safe.join(safe.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("word")).agg(F.count("*").alias("routes"))


def evaluate_moves(graph: WordGraph, words: DataFrame, level: str = "medium", patterns: dict[str, int] | None = None) -> DataFrame:
    """Candidates (non-trap neighbours) of each word with safety, danger, routes, trap paths of the opponent and strategic value in [0, 1]."""
    d = DIFFICULTIES.get(level, DIFFICULTIES["medium"])
    moves = graph.edges.join(words.select(F.col("word").alias("src")), "src", "left_semi").where(~is_trap("dst", graph.letters)).select(F.col("src").alias("word"), F.col("dst").alias("move"))
    replies = graph.edges.where(~is_trap("dst", graph.letters)).select(F.col("src").alias("move"), F.col("dst").alias("reply")).join(moves.select("move").distinct(), "move", "left_semi")
    paths = best_first_paths(graph, replies.select(F.col("reply").alias("word")).distinct(), d.lookahead, 3, least=0.3)
    threats = replies.join(paths.select(F.col("word").alias("reply"), F.array_join("path", " -> ").alias("text")), "reply").groupBy("move").agg(F.count("*").alias("n_paths"), F.sort_array(F.collect_set("text")).alias("trap_paths"))
    rows = moves
    for part in (self_safety(graph, d.lookahead), opponent_danger(graph, d.lookahead), escape_routes(graph)):
        rows = rows.join(part.withColumnRenamed("word", "move"), "move", "left")
    rows = rows.join(threats, "move", "left").fillna(0.0, ["safety", "danger"]).fillna(0, ["routes", "n_paths"])
    seen = patterns or {}
    bonus = 0.05 if d.patterns and len(seen) >= 3 and max(seen.values()) >= 2 else 0.0
    enough = F.when(F.col("routes") >= d.min_escape, 0.1 * F.least(F.col("routes") - d.min_escape, F.lit(3))).otherwise(-0.2 * (d.min_escape - F.col("routes")))
    value = d.safety * F.col("safety") + d.aggression * F.col("danger") + enough + 0.1 * F.least("n_paths", F.lit(3)) + F.lit(bonus)
    return rows.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def choose_moves(graph: WordGraph, words: DataFrame, level: str = "medium", patterns: dict[str, int] | None = None) -> DataFrame:
    """word, move, value, reason: the move each word's player takes at a difficulty."""
    rows = evaluate_moves(graph, words, level, patterns)
    order = Window.partitionBy("word").orderBy(F.round("value", 9).desc(), "move")
    top = rows.withColumn("rn", F.row_number().over(order))
    if level == "easy":
        safe = Window.partitionBy("word")
        top = top.withColumn("pick", F.coalesce(F.min(F.when(F.col("safety") > 0.7, F.col("rn"))).over(safe), F.lit(1))).where("rn = pick")
    elif level == "expert":
        by = Window.partitionBy("word")
        at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c))).over(by)
        second = (at(2, "danger") > at(1, "danger")) & (at(2, "safety") > 0.6)
        top = top.withColumn("pick", F.when(second, 2).otherwise(1)).where("rn = pick")
    else:
        top = top.where("rn = 1")
    reason = F.format_string("safety %.2f, danger %.2f, %d escape routes", "safety", "danger", "routes")
    return top.select("word", "move", "value", reason.alias("reason"))


def greedy_moves(graph: WordGraph) -> DataFrame:
    """word, move: the heaviest edge of each source (ties by word)."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("move")))
    return graph.edges.groupBy(F.col("src").alias("word")).agg(best.alias("b")).select("word", "b.move")


def avoid_scores(graph: WordGraph) -> DataFrame:
    """src, dst, score = weight * (1 + trap share of dst's weight): what a player that herds its opponent maximises."""
    share = graph.moves.groupBy(F.col("src").alias("dst")).agg(F.sum(F.when(F.col("trap"), F.col("p")).otherwise(0.0)).alias("share"))
    return graph.edges.join(share, "dst", "left").select("src", "dst", (F.col("weight") * (1 + F.coalesce("share", F.lit(0.0)))).alias("score"))


def multistep_recommend(graph: WordGraph, words: DataFrame, top_k: int = 10, **rank) -> DataFrame:
    """recommend() reordered by .4 score + .4 strategic (3 steps) + .2 cumulative hit within 3."""
    first = recommend(graph, words, top_k, **rank)
    deep = analyze(graph, first.select(F.col("next_word").alias("word")).distinct(), 3).select(F.col("word").alias("next_word"), "strategic", "total")
    rows = first.join(deep, "next_word", "left").withColumn("combined", 0.4 * F.col("score") + 0.4 * F.col("strategic") + 0.2 * F.col("total"))
    order = Window.partitionBy("word").orderBy(F.round("combined", 9).desc(), "next_word")
    return rows.withColumn("rank", F.row_number().over(order)).select("word", "rank", "next_word", "combined", "score", "strategic", "total")
