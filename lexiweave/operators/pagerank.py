"""Biased PageRank by iterated joins on the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.storage import drop_written, written
from ..functions.words import is_trap
from ..graph import WordGraph


def pagerank(graph: WordGraph, trap_bias: float = 1.5, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """word, pagerank over all words.

    Moves are weighted by weight * (trap_bias if dst is a trap else 1). The mass of words that are no source is spread evenly; a source
    without edges loses its mass. Stops when the L1 change is under tolerance (0: always max_iterations); the result is scaled to sum 1.
    Transition shares are computed once; each round is one join on src and one sum by word, and is written to the shared folder."""
    key = ("pagerank", trap_bias, damping, max_iterations, tolerance)
    if key in graph._memo:
        return graph._memo[key]
    words = written(graph.words.select("word", "is_source"), "rank-words")
    n = words.count()
    if not n:
        return words.select("word", F.lit(0.0).alias("pagerank"))
    biased = graph.edges.select("src", "dst", (F.col("weight") * F.when(is_trap("dst", graph.letters), F.lit(float(trap_bias))).otherwise(F.lit(1.0))).alias("w"))
    total = biased.groupBy("src").agg(F.sum("w").alias("t")).where("t > 0")
    moves = written(biased.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("share")), "rank-moves")
    ranks = words.select("word", "is_source", F.lit(1.0 / n).alias("pagerank"))
    dangling = words.where(~F.col("is_source")).count() / n
    old = None
    for _ in range(max_iterations):
        base = (1.0 - damping) / n + damping * dangling / n
        # what the moves bring and the words themselves go through one sum by word; a word's old rank is only there to be compared
        pushed = moves.join(ranks.select(F.col("word").alias("src"), "pagerank"), "src").select(F.col("dst").alias("word"), (F.col("share") * F.col("pagerank")).alias("got"), F.lit(None).cast("boolean").alias("is_source"), F.lit(None).cast("double").alias("before"))
        kept = ranks.select("word", F.lit(0.0).alias("got"), "is_source", F.col("pagerank").alias("before"))
        new = pushed.unionByName(kept).groupBy("word").agg(F.max("is_source").alias("is_source"), (F.lit(base) + F.lit(damping) * F.sum("got")).alias("pagerank"), F.max("before").alias("before"))
        # both sums are taken while the round is written
        seen = Observation()
        measured = new.observe(seen, F.sum(F.abs(F.col("pagerank") - F.col("before"))).alias("change"), F.sum(F.when(F.col("is_source"), 0.0).otherwise(F.col("pagerank"))).alias("dangling"))
        new = written(measured, "ranks")
        change, dangling = seen.get["change"], seen.get["dangling"]
        if old is not None:
            drop_written(old)
        ranks, old = new.drop("before"), new
        if tolerance and change < tolerance:
            break
    whole = ranks.agg(F.sum("pagerank")).first()[0]
    graph._memo[key] = ranks.select("word", (F.col("pagerank") / F.lit(whole)).alias("pagerank"))
    return graph._memo[key]
