"""Exact duplicates through an extendible-hash index on shared files (DataFrame operations only).

Plan
1. ``entries``: one narrow row per document (64-bit key of the normalised text, SHA-256, bytes),
   written to the shared folder in scan order. No shuffle.
2. ``directory``: distinct keys are counted per cell (the leading bits of the key). The directory starts with as many buckets as the
   count asks for and doubles: in each round only the buckets over ``capacity`` distinct keys split, on their next bit.
   Copies of one key never force a split, they lengthen its chain.
3. ``index``: one chain head per key with its bucket, sorted within the bucket (a key range each).
4. A text is looked up in the index: where its key's chain is longer than one, it is read again and goes to the task that owns the
   key's bucket. Scan tasks send each text once, with a count, so a text that fills a third of the rows comes to its owner once per task.
   The owner walks its buckets key by key and compares the bytes of the texts in a chain; equal ones form a group.
5. ``entries`` get the group of their text back; singletons keep themselves.

Cases: a null text counts as empty, so null and empty texts are copies of each other; a null doc_id
takes part, but stays only where its whole group has none; repeated rows count once each in group_size
and share kept; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, attach, spare, written

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 4096
#: Bits above the expected directory depth at which splitting starts, and bits below it that cells resolve.
EARLY_BITS = 2
SPARE_BITS = 3


def normalised(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; null as empty. Pure ASCII takes the byte path."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    other = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(other)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("_norm")).select("doc_id", "_norm", F.xxhash64("_norm").alias("key"))


def cell_of(key: Column, bits: int) -> Column:
    """The leading `bits` bits of a 64-bit key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, distinct: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slots, bits): slots(cell, bucket, depth) gives each cell of the directory its bucket.

    keys: distinct `key`s, `distinct` of them. A bucket is named by its first cell."""
    expected = max(0, math.ceil(math.log2(max(1, distinct) / capacity)))
    bits = min(40, expected + SPARE_BITS)
    slots = keys.groupBy(cell_of(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(None).cast("int"))
    for depth in range(max(0, expected - EARLY_BITS), bits + 1):
        # a bucket of this depth has at most 2 ** (EARLY_BITS + SPARE_BITS) cells
        bucket = Window.partitionBy(F.shiftright("cell", bits - depth))
        fits = (F.sum("n").over(bucket) <= capacity) | F.lit(depth == bits)
        slots = slots.withColumn("depth", F.when(F.col("depth").isNull() & fits, F.lit(depth)).otherwise(F.col("depth")))
    return slots.select("cell", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)").alias("bucket"), "depth"), bits


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index file: index(bucket, depth, key, n, head), a chain head per key, sorted within its bucket."""
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("head")), "dedup-keys")
    slots, bits = build_directory(keys, keys.count(), capacity)
    slots = written(slots, "dedup-directory")
    dealt = keys.withColumn("cell", cell_of(F.col("key"), bits)).join(slots, "cell").drop("cell")
    return written(dealt.repartition("bucket").sortWithinPartitions("bucket", "key"), "dedup-index")


def compared(docs: DataFrame, index: DataFrame) -> DataFrame:
    """bucket, key, _norm, group_size, keep_id of every distinct text whose key's chain in the index is longer than one."""
    chained = attach(_keyed(docs), index.where("n > 1").select("key", "bucket", "n"), ["key"], "n").where("bucket is not null")
    sent = chained.withColumn("task", F.spark_partition_id()).groupBy("bucket", "key", "_norm", "task").agg(F.count("*").alias("rows"), F.max("doc_id").alias("last"))
    owned = sent.repartition("bucket").sortWithinPartitions("bucket", "key")
    # the owner has all rows of its buckets, so this aggregation has no exchange of its own
    return owned.groupBy("bucket", "key", "_norm").agg(F.sum("rows").alias("group_size"), F.max("last").alias("keep_id"))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, n_bytes; a row per document."""
    entries = written(_keyed(docs).select("doc_id", "key", F.sha2("_norm", 256).alias("text_sha256"), F.octet_length("_norm").cast("long").alias("n_bytes")), "dedup-entries")
    index = build_index(entries, capacity)
    groups = written(compared(docs, index).where("group_size > 1").select("key", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-groups")
    found = attach(entries, groups, ["key", "text_sha256"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_bytes")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without all but the copy with the largest doc_id of each text; rows that repeat a kept doc_id
    with the same text go too. Columns as in docs. Texts that stand alone pass without a lookup of their own; those of groups are
    known by doc_id (without one, by their text) and the text's SHA-256."""
    found = exact_duplicates(docs).where("group_size > 1").select(F.coalesce(F.col("doc_id").cast("string"), F.col("text_sha256")).alias("id"), "text_sha256", "kept")
    found = written(found.groupBy("id", "text_sha256", "kept").agg(F.count("*").alias("rows")), "dedup-decisions")
    one, other = (spare(docs, x) for x in ("one", "other"))
    sha = F.sha2(normalised(docs["text"]), 256)
    keyed = docs.withColumn(one, F.coalesce(F.col("doc_id").cast("string"), sha))

    def among(rows: DataFrame, kind: str) -> DataFrame:
        """keyed rows with (left_semi) or without (left_anti) a partner in rows; the text is hashed only where the id is found."""
        rows = rows.select(F.col("id").alias(one), F.col("text_sha256").alias(other))
        rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
        same = F.coalesce(F.sha2(normalised(keyed["text"]), 256) == rows[other], F.lit(False))
        return keyed.join(rows, (keyed[one] == rows[one]) & same, kind).drop(one)

    repeated = "kept and rows > 1"
    alone = among(found.where(f"not kept or {repeated}"), "left_anti")
    return alone.unionByName(among(found.where(repeated), "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
