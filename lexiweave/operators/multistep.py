"""k-step hitting probabilities for all words at once, and information measures on edges and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from ..functions.words import is_trap, surprise
from ..graph import WordGraph


def hit_within(graph: WordGraph, k: int) -> DataFrame:
    """word, p: probability to be on a trap now or within k moves; traps absorb. Every word."""
    f = graph.words.select("word", F.col("is_trap").cast("double").alias("p"))
    moves = written(graph.moves.where(~is_trap("src", graph.letters)).select("src", "dst", F.col("p").alias("move")), "hit-moves") if k > 0 else None
    traps = graph.words.select("word", "is_trap")
    for _ in range(max(0, k)):
        next_ = moves.join(f.withColumnRenamed("word", "dst"), "dst").groupBy(F.col("src").alias("word")).agg(F.sum(F.col("move") * F.col("p")).alias("q"))
        f = written(traps.join(next_, "word", "left").select("word", F.when(F.col("is_trap"), F.lit(1.0)).otherwise(F.coalesce("q", F.lit(0.0))).alias("p")), "hit")
    return f


def first_hit(graph: WordGraph, k: int) -> DataFrame:
    """word, step, exact, cumulative for steps 1..k: probability that the first trap comes at exactly / up to that step.
    A word that is a trap itself has 0 everywhere. Each level is one join on dst and one sum by src."""
    moves = written(graph.moves.where(~is_trap("src", graph.letters)).select("src", "dst", "p", "trap"), "first-moves")
    level = written(moves.groupBy(F.col("src").alias("word")).agg(F.sum(F.when(F.col("trap"), F.col("p")).otherwise(0.0)).alias("exact")), "first-1")
    found = level.withColumn("step", F.lit(1))
    inner = moves.where(~F.col("trap"))
    for step in range(2, k + 1):
        level = written(inner.join(level.withColumnRenamed("word", "dst"), "dst").groupBy(F.col("src").alias("word")).agg(F.sum(F.col("p") * F.col("exact")).alias("exact")), f"first-{step}")
        found = found.unionByName(level.withColumn("step", F.lit(step)))
    words = graph.words.select("word", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    found = words.join(found, ["word", "step"], "left").select("word", "step", F.coalesce("exact", F.lit(0.0)).alias("exact"))
    return found.withColumn("cumulative", F.sum("exact").over(Window.partitionBy("word").orderBy("step")))


def k_step(graph: WordGraph, k: int) -> DataFrame:
    """The two-sided dispatcher: up to 3 steps hit_within, beyond that the cumulative first-hit probability (0 for traps)."""
    if k <= 3:
        return hit_within(graph, k)
    return first_hit(graph, k).where(F.col("step") == k).select("word", F.col("cumulative").alias("p"))


def entropies(graph: WordGraph) -> DataFrame:
    """word, entropy (bits) of each source's moves."""
    return graph.moves.groupBy(F.col("src").alias("word")).agg(F.sum(surprise("p")).alias("entropy"))


def information_gain(graph: WordGraph) -> DataFrame:
    """src, dst, p, gain = max(0, entropy of src - surprise of the move)."""
    by = Window.partitionBy("src")
    rows = graph.moves.withColumn("h", F.sum(surprise("p")).over(by))
    return rows.select("src", "dst", "p", F.greatest(F.lit(0.0), F.col("h") + F.log2("p")).alias("gain"))


def information_flow(graph: WordGraph, k: int = 5) -> DataFrame:
    """src, dst, gain and the neighbour's own one-step trap share: the k strongest moves of each source."""
    order = Window.partitionBy("src").orderBy(F.col("p").desc(), "dst")
    one = first_hit_one(graph)
    rows = information_gain(graph).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.join(one.withColumnRenamed("word", "dst"), "dst", "left").select("src", "dst", "rank", "gain", F.coalesce("one_step", F.lit(0.0)).alias("one_step"))


def first_hit_one(graph: WordGraph) -> DataFrame:
    return graph.moves.groupBy(F.col("src").alias("word")).agg(F.sum(F.when(F.col("trap"), F.col("p")).otherwise(0.0)).alias("one_step"))


def compare_hits(graph: WordGraph, k: int) -> DataFrame:
    """One row: greatest and mean difference of hit_within and the cumulative first hit over words that are no traps."""
    a = hit_within(graph, k).where(~is_trap("word", graph.letters))
    b = first_hit(graph, k).where(F.col("step") == k)
    return a.join(b, "word").agg(F.max(F.abs(F.col("p") - F.col("cumulative"))).alias("max_diff"), F.avg(F.abs(F.col("p") - F.col("cumulative"))).alias("mean_diff"))
