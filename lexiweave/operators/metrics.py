"""Per-word metrics, summaries and connectivity reports; each is one or two grouped aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import is_trap, richness
from ..graph import WordGraph

WEIGHTS = (0.4, 0.2, 0.2, 0.2)
# The function words of the connectivity reports.
FUNCTION_WORDS = (
    "the", "and", "of", "to", "a", "in", "is", "it", "you", "that", "he", "was", "for", "on", "are", "as", "with", "his", "they", "i",
    "be", "have", "not", "will", "from", "we", "she", "or", "an", "do", "been", "this", "but", "by", "at", "can", "would",
)
STRONG = 0.05


def strong_edges(graph: WordGraph, fraction: float = STRONG) -> DataFrame:
    """Edges of at least `fraction` of their source's greatest weight."""
    top = F.max("weight").over(Window.partitionBy("src"))
    return graph.edges.withColumn("top", top).where(F.col("weight") >= fraction * F.col("top")).drop("top")


def word_metrics(graph: WordGraph, fraction: float = STRONG) -> DataFrame:
    """word, n_neighbors, out_sum, one_step, escape_hardness, richness for every source, from one shuffle on src.

    A source's greatest weight, its totals and its strong edges share the partitioning of the window."""
    by = Window.partitionBy("src")
    rows = graph.edges.withColumn("top", F.max("weight").over(by)).withColumn("trap", is_trap("dst", graph.letters))
    strong = F.col("weight") >= fraction * F.col("top")
    agg = rows.groupBy(F.col("src").alias("word")).agg(
        F.count("*").alias("n_neighbors"),
        F.sum("weight").alias("out_sum"),
        F.sum(F.when(F.col("trap"), F.col("weight")).otherwise(0.0)).alias("trap_sum"),
        F.count_if(strong & F.col("trap")).alias("strong_traps"),
        F.count_if(strong).alias("strong"),
    )
    if graph.lone_sources is not None:
        agg = graph.sources.join(agg, "word", "left").fillna(0)
    return agg.select(
        "word",
        "n_neighbors",
        "out_sum",
        F.when(F.col("out_sum") > 0, F.col("trap_sum") / F.col("out_sum")).otherwise(F.lit(0.0)).alias("one_step"),
        F.when(F.col("strong") > 0, F.col("strong_traps") / F.col("strong")).otherwise(F.lit(0.0)).alias("escape_hardness"),
        richness("n_neighbors").alias("richness"),
    )


def with_composite(metrics: DataFrame, weights=WEIGHTS) -> DataFrame:
    """metrics with pagerank -> with composite: the weighted sum, and a bonus for words both risky and well connected."""
    a, b, c, d = (F.lit(float(w)) for w in weights)
    score = a * F.col("one_step") + b * F.col("richness") + c * F.col("escape_hardness") + d * F.col("pagerank")
    bonus = F.when((F.col("one_step") > 0.1) & (F.col("n_neighbors") >= 5), 0.1 * F.least("one_step", "richness")).otherwise(F.lit(0.0))
    return metrics.withColumn("composite", score + bonus)


def graph_summary(graph: WordGraph) -> DataFrame:
    """One row: n_words, n_sources, n_edges, total_weight, n_traps, trap_percent, edges_per_word."""
    words = graph.words.agg(F.count("*").alias("n_words"), F.count_if("is_source").alias("n_sources"), F.count_if("is_trap").alias("n_traps"))
    edges = graph.edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    percent = F.when(F.col("n_words") > 0, 100.0 * F.col("n_traps") / F.col("n_words"))
    return words.crossJoin(edges).select("n_words", "n_sources", "n_edges", "total_weight", "n_traps", percent.alias("trap_percent"), F.when(F.col("n_words") > 0, F.col("n_edges") / F.col("n_words")).alias("edges_per_word"))


def weight_stats(edges: DataFrame) -> DataFrame:
    """min, max, mean and upper median (position n div 2 + 1 in ascending order) of the weights.

    The median comes from a histogram of distinct weights, so no task sorts all edges."""
    tally = edges.groupBy("weight").agg(F.count("*").alias("n"))
    run = tally.withColumn("upto", F.sum("n").over(Window.orderBy("weight"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return run.agg(
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
        (F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("mean_weight"),
        F.min(F.when(F.col("upto") >= F.expr("total div 2 + 1"), F.col("weight"))).alias("median_weight"),
    )


def top_neighbors(graph: WordGraph, k: int = 10) -> DataFrame:
    """src, rank, dst, weight, is_trap: each source's k strongest neighbours."""
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return graph.edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("is_trap", is_trap("dst", graph.letters))


def top_incoming(graph: WordGraph, k: int = 3) -> DataFrame:
    """dst, rank, src, weight: the k strongest edges into each word."""
    order = Window.partitionBy("dst").orderBy(F.col("weight").desc(), "src")
    return graph.edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def trap_incoming(graph: WordGraph, k: int | None = 20) -> DataFrame:
    """letter, word, incoming, rank: for each trap word that is a source, how many other-letter sources lead to it (0 kept)."""
    traps = graph.sources.where(is_trap("word", graph.letters))
    count = graph.edges.where(~is_trap("src", graph.letters)).groupBy(F.col("dst").alias("word")).agg(F.count("*").alias("incoming"))
    found = traps.join(count, "word", "left").select(F.upper(F.substring("word", 1, 1)).alias("letter"), "word", F.coalesce("incoming", F.lit(0)).alias("incoming"))
    order = Window.partitionBy("letter").orderBy(F.col("incoming").desc(), "word")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k) if k else found


def score_distribution(scores: DataFrame, column: str = "composite") -> DataFrame:
    """highest, lowest, median (position n div 2 of the descending list), spread, and how many lie in the tiers."""
    c = F.round(column, 9)
    tally = scores.groupBy(c.alias("s")).agg(F.count("*").alias("n"))
    run = tally.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("s").desc()))).withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("top", F.max("s").over(Window.partitionBy()))
    return run.agg(
        F.max("s").alias("highest"),
        F.max(F.when(F.col("upto") > F.expr("total div 2"), F.col("s"))).alias("median"),
        F.min("s").alias("lowest"),
        (F.max("s") - F.min("s")).alias("spread"),
        F.coalesce(F.sum(F.when(F.col("s") >= F.col("top") - 0.001, F.col("n"))), F.lit(0)).alias("n_high"),
        F.coalesce(F.sum(F.when((F.col("s") >= 0.5) & (F.col("s") < F.col("top") - 0.001), F.col("n"))), F.lit(0)).alias("n_mid"),
        F.coalesce(F.sum(F.when(F.col("s") < 0.5, F.col("n"))), F.lit(0)).alias("n_low"),
    )


def bounds_check(graph: WordGraph) -> DataFrame:
    """One row of counts of violations: probabilities outside [0, 1], self-loops, weights of 0 or less."""
    m = word_metrics(graph).agg(F.count_if(~F.col("one_step").between(0, 1)).alias("bad_one_step"), F.count_if(~F.col("escape_hardness").between(0, 1)).alias("bad_hardness"))
    e = graph.edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.count_if(F.col("weight") <= 0).alias("bad_weights"))
    return m.crossJoin(e)


# Connectivity of a list of function words -------------------------------------------------------------------------------


def listed_sources(graph: WordGraph, words) -> DataFrame:
    """word: those of the (short, literal) list that are sources."""
    return graph.sources.where(F.col("word").isin(*sorted(set(words))))


def list_connections(graph: WordGraph, words) -> DataFrame:
    """word, listed (distinct neighbours from the list), degree, percent: every source."""
    on = F.col("dst").isin(*sorted(set(words)))
    listed = listed_sources(graph, words).select(F.col("word").alias("dst"), F.lit(True).alias("on"))
    rows = graph.edges.join(F.broadcast(listed), "dst", "left") if words else graph.edges.withColumn("on", on)
    agg = rows.groupBy(F.col("src").alias("word")).agg(F.count_if("on").alias("listed"), F.count("*").alias("degree"))
    return agg.withColumn("percent", 100.0 * F.col("listed") / F.col("degree"))


def list_reach(graph: WordGraph, words) -> DataFrame:
    """For each listed source: outgoing, incoming, trap neighbours, trap_score = incoming * (1 + trap neighbours), label."""
    own = listed_sources(graph, words)
    out = graph.edges.groupBy(F.col("src").alias("word")).agg(F.count("*").alias("outgoing"), F.count_if(is_trap("dst", graph.letters)).alias("trap_neighbors"))
    into = graph.edges.groupBy(F.col("dst").alias("word")).agg(F.count("*").alias("incoming"))
    rows = own.join(out, "word", "left").join(into, "word", "left").fillna(0, ["outgoing", "incoming", "trap_neighbors"])
    score = F.col("incoming") * (1 + F.col("trap_neighbors"))
    label = F.when(score > 100, "extreme").when(score > 50, "high").when(score > 10, "moderate").when(F.col("outgoing") == 0, "dead end").otherwise("low")
    return rows.select("word", "outgoing", "incoming", "trap_neighbors", score.alias("trap_score"), label.alias("label"))


def cluster_centers(graph: WordGraph, words, least: int = 2) -> DataFrame:
    """word, links, weight: words off the list with at least `least` listed neighbours that are sources."""
    listed = listed_sources(graph, words).select(F.col("word").alias("dst"))
    rows = graph.edges.where(~F.col("src").isin(*sorted(set(words)))).join(F.broadcast(listed), "dst", "left_semi")
    return rows.groupBy(F.col("src").alias("word")).agg(F.count("*").alias("links"), F.sum("weight").alias("weight")).where(F.col("links") >= least)


def list_escapes(graph: WordGraph, words) -> DataFrame:
    """word, listed, others, escape_score of words off the list with over three times as many other as listed neighbours (at least one)."""
    rows = list_connections(graph, words).where(~F.col("word").isin(*sorted(set(words))))
    rows = rows.withColumn("others", F.col("degree") - F.col("listed")).where("listed > 0 and others > 3 * listed")
    return rows.select("word", "listed", "others", (F.col("others") / (F.col("listed") + 1)).alias("escape_score"))
