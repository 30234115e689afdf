"""The word graph: edges(src, dst, weight), unique on (src, dst), and words(word, is_source)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.words import is_trap, trap_letters


@dataclass
class WordGraph:
    edges: DataFrame
    letters: tuple[str, ...] = ()
    lone_sources: DataFrame | None = None  # word: sources without edges
    _memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.letters = trap_letters(self.letters)

    @classmethod
    def from_dict(cls, spark: SparkSession, graph: Mapping[str, Mapping[str, float]], letters=None) -> WordGraph:
        """From {src: {dst: weight}}; a source with an empty mapping is kept as a source without edges."""
        rows = [(s, d, float(w)) for s, out in graph.items() for d, w in out.items()]
        lone = [(s,) for s, out in graph.items() if not out]
        return cls(spark.createDataFrame(rows, "src string, dst string, weight double"), letters or (), spark.createDataFrame(lone, "word string"))

    @cached_property
    def sources(self) -> DataFrame:
        found = self.edges.select(F.col("src").alias("word")).distinct()
        return found.unionByName(self.lone_sources).distinct() if self.lone_sources is not None else found

    @cached_property
    def words(self) -> DataFrame:
        """word, is_source, is_trap."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("word"), F.lit(True).alias("s")), F.struct(F.col("dst").alias("word"), F.lit(False).alias("s")))).alias("x")).select("x.*")
        if self.lone_sources is not None:
            ends = ends.unionByName(self.lone_sources.withColumn("s", F.lit(True)))
        return ends.groupBy("word").agg(F.max("s").alias("is_source")).withColumn("is_trap", is_trap("word", self.letters))

    @cached_property
    def moves(self) -> DataFrame:
        """edges with p (share of the source's weight) and trap (whether dst is one)."""
        total = F.sum("weight").over(Window.partitionBy("src"))
        return self.edges.withColumn("p", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(0.0))).withColumn("trap", is_trap("dst", self.letters))

    def neighbors(self, word: str) -> DataFrame:
        return self.edges.where(F.col("src") == word).select("dst", "weight")

    def incoming(self, word: str) -> DataFrame:
        return self.edges.where(F.col("dst") == word).select("src", "weight")

    def has_word(self, word: str) -> bool:
        """Whether the word is a source; a word that is only pointed at is not found."""
        return bool(self.sources.where(F.col("word") == word).limit(1).count())
