"""What the corpus operators share: tables, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import drop_written, new_folder, ship, written

__all__ = ["attach", "components", "drop_written", "hand_back", "new_folder", "semi_by_key", "ship", "spare", "table", "tidy", "written"]

#: Rows up to which a table of a few longs may be broadcast (some 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more than one in HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 256


def hand_back() -> None:
    """Give memory that is freed but still held by the allocators back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(task, encodes: bool = False):
    """A task over Arrow batches that hands its worker's freed memory back at the end; idle workers stay with their executor. A task that does not
    encode drops what earlier ones of its worker have kept to encode with."""

    holder = f"{__package__}.encoding"

    @functools.wraps(task)
    def run(batches):
        if not encodes and (encoding := sys.modules.get(holder)):
            encoding.forget_encoders()
        try:
            yield from task(batches)
        finally:
            gc.collect()
            hand_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any spelling: name, with underscores before it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def semi_by_key(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows whose `on` is among keys. The keys go out as a broadcast only if their count is under
    BROADCAST_ROWS; otherwise both sides shuffle (and adaptive execution splits skewed keys)."""
    keys = keys.select(on)
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return rows.join(keys, on, "left_semi")


def attach(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows left join groups (unique on `on`, with the number of rows of each in `size`) without a hot task.

    Small group tables are broadcast (checked count). Else the fewer than HOT_PARTS groups that hold
    over 1/HOT_PARTS of the rows are broadcast and only the rest meet in a shuffle."""
    n = groups.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on, "left")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_PARTS > total)
    flagged = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    warm = flagged.where("_hot").drop("_hot").join(F.broadcast(hot), on, "left")
    cool = flagged.where("_hot is null").drop("_hot").join(groups.where(F.col(size) * HOT_PARTS <= total), on, "left")
    return warm.select(*cool.columns).unionByName(cool)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges(a, b): rows (node, component), component = smallest node.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until the edge set repeats. Each
    step points every neighbour at the smallest one, so a hub's list shrinks to one edge per node;
    minima are pre-aggregated before the shuffle. The state is written to the shared folder each
    round, the driver sees only two sums. A component's smallest node and nodes without edges have no row. Self-edges are ignored."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        # large star: every larger neighbour of u points at u's smallest neighbour (or u itself)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(e)
        e = after
        if mark == before:
            break
        before = mark
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
