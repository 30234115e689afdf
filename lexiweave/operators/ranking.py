"""Scores, rankings and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import half_up, is_trap
from ..graph import WordGraph
from .metrics import WEIGHTS, top_neighbors, with_composite, word_metrics
from .pagerank import pagerank


def scores(graph: WordGraph, weights=WEIGHTS, **rank) -> DataFrame:
    """All metrics and the composite score of every source."""
    return with_composite(word_metrics(graph).join(pagerank(graph, **rank), "word"), weights)


def rank_words(graph: WordGraph, top_k: int | None = None, weights=WEIGHTS, **rank) -> DataFrame:
    """word, composite of sources that are no traps, best first (ties by word)."""
    found = scores(graph, weights, **rank).where(~is_trap("word", graph.letters)).select("word", "composite")
    found = found.orderBy(F.round("composite", 9).desc(), "word")
    return found.limit(top_k) if top_k else found


def recommend(graph: WordGraph, words: DataFrame, top_k: int = 10, weights=WEIGHTS, **rank) -> DataFrame:
    """For each of words(word): its best non-trap neighbours by their own composite score; neighbours that are no source score 0 but for
    their PageRank. word, rank, next_word, score, one_step, escape_hardness, pagerank, edge_weight."""
    own = graph.edges.join(words.select(F.col("word").alias("src")), "src", "left_semi").where(~is_trap("dst", graph.letters))
    s = scores(graph, weights, **rank).select(F.col("word").alias("dst"), F.col("composite").alias("score"), "one_step", "escape_hardness")
    rows = own.join(s, "dst", "left").join(pagerank(graph, **rank).withColumnRenamed("word", "dst"), "dst", "left").fillna(0.0, ["score", "one_step", "escape_hardness", "pagerank"])
    order = Window.partitionBy("src").orderBy(F.round("score", 9).desc(), "dst")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return rows.select(F.col("src").alias("word"), "rank", F.col("dst").alias("next_word"), "score", "one_step", "escape_hardness", "pagerank", F.col("weight").alias("edge_weight"))


def word_analysis(graph: WordGraph, weights=WEIGHTS, **rank) -> DataFrame:
    """Every source with its metrics, scores and ten strongest neighbours as an array of (word, weight, is_trap)."""
    best = top_neighbors(graph, 10).groupBy(F.col("src").alias("word")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("dst").alias("word"), "weight", "is_trap"))).alias("t"))
    top = F.transform("t", lambda x: F.struct(x["word"].alias("word"), x["weight"].alias("weight"), x["is_trap"].alias("is_trap")))
    return scores(graph, weights, **rank).join(best.select("word", top.alias("top_neighbors")), "word", "left")


def pagerank_positions(graph: WordGraph, **rank) -> DataFrame:
    """word, pagerank, position (1 is the highest; ties by word). Positions are two-level ranks: rows are dealt into ranges of the
    value, ranked inside, and offset by the ranges before, so no task sorts all words."""
    r = pagerank(graph, **rank).withColumn("v", F.round("pagerank", 12))
    low, high = r.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return r.select("word", "pagerank", F.lit(0).cast("long").alias("position"))
    # values crowd near the minimum, so ranges are logarithmic
    cell = F.floor(F.log2(F.col("v") / F.lit(max(low, 1e-12)) + F.lit(1.0)) * 64)
    r = r.withColumn("cell", cell)
    counts = r.groupBy("cell").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("v").desc(), "word"))
    return r.withColumn("_in", inside).join(counts, "cell").select("word", "pagerank", (F.col("_in") + F.col("ahead")).alias("position"))


def export_scores(graph: WordGraph, weights=WEIGHTS, **rank) -> DataFrame:
    """The score export: numbers with six decimals as text, every source."""
    six = lambda c, name: F.format_string("%.6f", half_up(half_up(F.col(c), 9), 6)).alias(name)
    return scores(graph, weights, **rank).select("word", six("composite", "composite_score"), six("one_step", "one_step_prob"), six("escape_hardness", "escape_hardness"), six("pagerank", "pagerank_score"), F.col("n_neighbors").alias("neighbor_count"))
