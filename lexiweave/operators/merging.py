"""Merging and pruning of edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import half_even
from ..graph import WordGraph

# Words that pruning removes.
ARTICLES = ("the", "a", "an")
CONJUNCTIONS = ("and", "but", "or", "nor", "for", "so", "yet", "because", "since", "while", "although", "though", "unless", "until", "before", "after", "when", "where", "if", "whether")
# Function words that a pruned graph may still have as sources.
REMAINING_WORDS = (
    "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "should", "may", "might", "must",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
    "in", "on", "at", "by", "with", "from", "to", "of", "about", "into", "through",
)
# What an edge of each data set counts in the weighted merges.
SOURCE_FACTORS = {"conceptnet57": 1.0, "swow_en18": 2.0, "eat": 1.5, "conceptnet": 1.0}
TARGETED_FACTORS = {"swow": 3.0, "usf": 1.5, "conceptnet": 0.3}


def merge_sum(edges: DataFrame) -> DataFrame:
    """Equal edges add up; empty words and self-loops go."""
    rows = edges.where("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def merge_max(edges: DataFrame) -> DataFrame:
    return edges.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def merge_running_average(edges: DataFrame, factor: Column, order: list[str], self_loops: bool = False) -> DataFrame:
    """Fold each edge's weights (times factor) in arrival order by new = (old + next) / 2, rounded to 6 places.

    The fold is not associative, so an edge's few values meet in one array, ordered by `order` columns."""
    rows = edges if self_loops else edges.where("src <> dst")
    got = rows.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct(*order, factor.cast("double").alias("_w")))).alias("v"))
    fold = F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", 0)["_w"], lambda a, x: (a + x["_w"]) / 2)
    return got.withColumn("folded", fold).select("src", "dst", half_even(F.col("folded")).alias("weight"))


def _merge_named(edges: DataFrame, names: list[str], order: list[str], self_loops: bool) -> DataFrame:
    """Running average of edges(name, src, dst, weight) of the data sets in `names`, in that order, each times its factor."""
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    factor = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(TARGETED_FACTORS.get(n.removesuffix("_light"), 1.0)))])
    rows = edges.where(F.col("name").isin(*names)).withColumn("_place", place[F.col("name")])
    return merge_running_average(rows, factor[F.col("name")] * F.col("weight"), ["_place", *order], self_loops)


def merge_complete(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """src, dst, weight of edges(name, src, dst, weight): SWOW, then USF, then ConceptNet, by running average; self-loops stay."""
    return _merge_named(edges, ["swow", "usf", "conceptnet"], order or [], True)


def merge_targeted(edges: DataFrame, names: list[str], order: list[str] | None = None) -> DataFrame:
    """As merge_complete, over the data sets in `names` in the order given (`_light` in a name doesn't count), without self-loops."""
    return _merge_named(edges, names, order or [], False)


def prune(graph: WordGraph, words=ARTICLES + CONJUNCTIONS) -> DataFrame:
    """Edges without those from or to a listed word that is a source; a listed word that is only a target stays."""
    stop = F.broadcast(graph.sources.where(F.col("word").isin(*words)))
    e = graph.edges
    return e.join(stop, e["src"] == stop["word"], "left_anti").join(stop, e["dst"] == stop["word"], "left_anti")


def prune_impact(graph: WordGraph, words=ARTICLES + CONJUNCTIONS) -> DataFrame:
    """word, outgoing, incoming, total, percent of all edges for each listed word that is a source."""
    stop = graph.sources.where(F.col("word").isin(*words))
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("word"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("word"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    per = ends.where(F.col("word").isin(*words)).groupBy("word").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    n = graph.edges.agg(F.count("*").alias("n"))
    rows = stop.join(per, "word").crossJoin(F.broadcast(n))
    return rows.select("word", "outgoing", "incoming", (F.col("outgoing") + F.col("incoming")).alias("total"), (100.0 * (F.col("outgoing") + F.col("incoming")) / F.col("n")).alias("percent"))


def prune_comparison(graph: WordGraph, words=ARTICLES + CONJUNCTIONS) -> DataFrame:
    """One row: words and edges before and after pruning, the share that went, and how many of the listed function words are still sources."""
    after = WordGraph(prune(graph, words), graph.letters)
    count = lambda g, tag: g.edges.agg(F.count("*").alias(f"edges_{tag}")).crossJoin(g.words.agg(F.count("*").alias(f"words_{tag}")))
    left = after.sources.where(F.col("word").isin(*REMAINING_WORDS)).agg(F.count("*").alias("function_words_left"))
    rows = count(graph, "before").crossJoin(count(after, "after")).crossJoin(left)
    return rows.withColumn("edge_percent", 100.0 * (F.col("edges_before") - F.col("edges_after")) / F.col("edges_before")).withColumn("word_percent", 100.0 * (F.col("words_before") - F.col("words_after")) / F.col("words_before"))


def composition(edges: DataFrame, by: str = "source") -> DataFrame:
    """Edges of each data set and their percent of all."""
    per = edges.groupBy(by).agg(F.count("*").alias("edges"))
    return per.withColumn("percent", 100.0 * F.col("edges") / F.sum("edges").over(Window.partitionBy()))
