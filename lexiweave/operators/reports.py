"""Reports that combine metrics, and the learned player's view of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import chance, is_trap
from ..graph import WordGraph
from .multistep import first_hit_one, hit_within
from .paths import best_first_paths, shortest_paths
from .ranking import pagerank_positions
from .strategy import analyze


def trap_effectiveness(graph: WordGraph, k: int = 2) -> DataFrame:
    """word, one_step, k_step, connectivity, is_trap, combined = .7 one_step + .3 k_step, for every word."""
    n = graph.edges.groupBy(F.col("src").alias("word")).agg(F.count("*").alias("connectivity"))
    rows = graph.words.select("word", "is_trap").join(first_hit_one(graph), "word", "left").join(hit_within(graph, k).withColumnRenamed("p", "k_step"), "word").join(n, "word", "left")
    rows = rows.select("word", F.coalesce("one_step", F.lit(0.0)).alias("one_step"), "k_step", F.coalesce("connectivity", F.lit(0)).alias("connectivity"), "is_trap")
    return rows.withColumn("combined", 0.7 * F.col("one_step") + 0.3 * F.col("k_step"))


def degrees(graph: WordGraph) -> DataFrame:
    """word, out_degree, in_degree, from one pass over both ends of each edge."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("word"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("word"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("word").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def average_degree(graph: WordGraph) -> DataFrame:
    """One row: both ways in which it is counted, 2 E / V and E / V."""
    e, v = graph.edges.agg(F.count("*").alias("e")), graph.words.agg(F.count("*").alias("v"))
    return e.crossJoin(v).select(F.when(F.col("v") > 0, 2 * F.col("e") / F.col("v")).alias("both_ends"), F.when(F.col("v") > 0, F.col("e") / F.col("v")).alias("one_end"))


def word_details(graph: WordGraph, **rank) -> DataFrame:
    """word, degree, is_trap, least, greatest and mean weight, the ten strongest neighbours, five strongest trap neighbours and ten strongest
    sources into it (arrays, strongest first), PageRank and its position."""
    trap = is_trap("dst", graph.letters)
    strongest = lambda rows, by, to, k: _strongest(rows.select(F.col(by).alias("word"), F.col(to).alias("other"), "weight"), k)
    rows = graph.edges.groupBy(F.col("src").alias("word")).agg(F.count("*").alias("degree"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"))
    for name, part in (("top_out", strongest(graph.edges, "src", "dst", 10)), ("top_traps", strongest(graph.edges.where(trap), "src", "dst", 5)), ("top_in", strongest(graph.edges, "dst", "src", 10))):
        rows = rows.join(part.withColumnRenamed("others", name), "word", "left")
    rows = rows.join(pagerank_positions(graph, **rank), "word")
    empty = F.array().cast("array<string>")
    return rows.select("word", "degree", is_trap("word", graph.letters).alias("is_trap"), "min_weight", "max_weight", "mean_weight", *[F.coalesce(c, empty).alias(c) for c in ("top_out", "top_traps", "top_in")], "pagerank", "position")


def _strongest(rows: DataFrame, k: int) -> DataFrame:
    """word, others: the k heaviest of rows(word, other, weight) of each word, in order."""
    order = Window.partitionBy("word").orderBy(F.col("weight").desc(), "other")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("others"))


def playable_moves(graph: WordGraph, k: int = 8) -> DataFrame:
    """word, moves: the k strongest neighbours that are no traps, in order."""
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    safe = graph.edges.where(~is_trap("dst", graph.letters)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return safe.groupBy(F.col("src").alias("word")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("moves"))


def trap_potential(graph: WordGraph, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
    """pairs(start, target) with path, product and label: no path is a perfect trap, under .1 a trap, over .3 an easy way out."""
    rows = shortest_paths(graph, pairs, max_depth)
    p = F.col("product")
    return rows.withColumn("label", F.when(F.col("path").isNull(), "perfect trap").when(p < 0.1, "trap").when(p > 0.3, "easy").otherwise("medium"))


def position_features(positions: DataFrame, letters) -> DataFrame:
    """positions(word, history ARRAY, moves ARRAY) with features: turns so far, threat, number of moves, word length, trap word, trap share of history."""
    trap = lambda x: is_trap(x, letters)
    share = lambda c: F.size(F.filter(c, trap)) / F.greatest(F.lit(1), F.size(c))
    threat = F.when(F.size("moves") == 0, 1.0).otherwise(share(F.col("moves")))
    parts = [F.size("history"), threat, F.size("moves"), F.length("word"), F.when(is_trap("word", letters), 1.0).otherwise(0.0), share(F.col("history"))]
    return positions.withColumn("features", F.array(*[x.cast("double") for x in parts]))


def network_score(features: Column, weights: list[float]) -> Column:
    """A 6-4-1 network (ReLU, sigmoid) as a column expression. weights: 24 to the hidden units, their 4 biases, 4 to the output, its bias."""
    if len(weights) != 33:
        raise ValueError("33 weights are needed")
    hidden = []
    for h in range(4):
        total = F.lit(float(weights[24 + h]))
        for i in range(6):
            total = total + F.get(features, F.lit(i)) * F.lit(float(weights[h * 6 + i]))
        hidden.append(F.greatest(F.lit(0.0), total))
    out = F.lit(float(weights[32]))
    for h in range(4):
        out = out + hidden[h] * F.lit(float(weights[28 + h]))
    return 1.0 / (1.0 + F.exp(-out))


def weighted_choice(graph: WordGraph, listed: DataFrame, target_odds: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """word, move: a seeded draw for each source, in proportion to weight * (.5 for words of listed(word)) * (1 + 10 * odds, or .001 without a way
    to the target; only if target_odds(word, odds) are given) * noise in (.7, 1.3)."""
    u = lambda tag: chance(F.col("src"), F.col("dst"), F.lit(seed), F.lit(tag))
    rows = graph.edges.join(listed.select(F.col("word").alias("dst"), F.lit(True).alias("on")), "dst", "left")
    w = F.col("weight") * F.when(F.col("on"), 0.5).otherwise(1.0) * (0.7 + 0.6 * u("noise"))
    if target_odds is not None:
        rows = rows.join(target_odds.select(F.col("word").alias("dst"), "odds"), "dst", "left")
        w = w * F.when(F.col("odds") > 0, 1 + 10 * F.col("odds")).otherwise(0.001)
    # the smallest of -log(u) / w falls on each move in proportion to w
    drawn = F.min(F.struct((-F.log(u("draw")) / w).alias("k"), F.col("dst").alias("move")))
    return rows.groupBy(F.col("src").alias("word")).agg(drawn.alias("d")).select("word", "d.move")


def strategic_depth(graph: WordGraph, words: DataFrame, max_k: int = 5) -> DataFrame:
    """The multi-step analysis of those of words(word) that are sources."""
    return analyze(graph, words.join(graph.sources, "word", "left_semi"), max_k)


def pathway_report(graph: WordGraph, words: DataFrame, max_steps: int = 3, keep: int = 5) -> DataFrame:
    """word, cumulative, total, strategic, path_count and its `keep` best paths (array of path, steps, probability, score)."""
    best = best_first_paths(graph, words, max_steps, keep).groupBy("word").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", "steps", "probability", "score"))).alias("b"))
    rows = analyze(graph, words, max_steps).drop("paths", "avg_entropy", "max_gain").join(best, "word", "left")
    return rows.withColumn("best", F.transform("b", lambda x: F.struct(x["path"].alias("path"), x["steps"].alias("steps"), x["probability"].alias("probability"), x["score"].alias("score")))).drop("b")
