"""An edge feed: files of new associations are summed into a versioned edge table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.storage import delete
from ..sources.edges import clean_edges

#: Versions of the table that stay; a batch reads the one before it, and a reader of the newest is not cut off at once.
KEEP_VERSIONS = 3


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """file, value: the lines of CSV files as they arrive."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def by_header(lines: DataFrame) -> DataFrame:
    """src, dst, weight (as text) of lines(file, value): each file's columns by its own header, whatever their order; files without src and dst give none.

    A header is the line that holds both names as fields. Fields hold no line feeds."""
    bare = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    heads = lines.select("file", bare.alias("names")).where(F.array_contains("names", "src") & F.array_contains("names", "dst")).groupBy("file").agg(F.min("names").alias("names"))
    # a field is quoted, with doubled quotes inside, or holds no comma
    cut = F.regexp_extract_all("value", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    cell = lambda name: F.get("cells", (F.array_position("names", name) - 1).cast("int"))
    plain = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c)
    rows = lines.join(heads, "file").withColumn("cells", cut)
    rows = rows.where(~((plain(cell("src")) == "src") & (plain(cell("dst")) == "dst")))
    weight = F.when(F.array_contains("names", "weight"), plain(cell("weight"))).otherwise("0")
    return rows.select(plain(cell("src")).alias("src"), plain(cell("dst")).alias("dst"), weight.alias("weight"))


def current(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """The edges of the table's newest (or a given) version; null before the first batch."""
    try:
        rows = spark.read.parquet(table)
    except AnalysisException:
        return None
    last = rows.agg(F.max("version")).first()[0] if version is None else version
    return rows.where(F.col("version") == last).drop("version")


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Sum every batch of the feed into the table. Each batch writes version = batch id from version - 1, so a batch that runs again
    after a failure overwrites its own version and counts once; the last KEEP_VERSIONS stay."""

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        new = clean_edges(by_header(batch))
        old = current(own, table, number - 1) if number else None
        both = new if old is None else old.select("src", "dst", "weight").unionByName(new).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        both.write.mode("overwrite").parquet(f"{table}/version={number}")
        if number >= KEEP_VERSIONS:
            delete(own, f"{table}/version={number - KEEP_VERSIONS}")

    return read_feed(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
