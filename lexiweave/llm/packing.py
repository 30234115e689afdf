"""Packing by powers of two: each document is split into binary-length pieces, and equal lengths share a bucket.

A document of n tokens (its end id included) gives n // 1024 pieces of 1024 tokens and one piece for each bit
set in n % 1024, longest first. Each piece is a sequence of its own: no sequence crosses documents and none
is padded, since every length is a power of two. Sequences are numbered within their bucket.

Cases: a null or empty text is its end id alone; repeated rows are packed each; a null doc_id is kept as null; extra
columns are ignored; an empty table gives no rows. A document of any length is one row at a time in memory.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoded, encoder
from .shared import ship, tidy, written

SEQUENCE = 1024
#: Bits of a sequence_id that number the sequence within its bucket.
RANK_BITS = 48


def binary_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """n as pieces of `longest` and then its remaining powers of two, descending."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, part, rank[, ids]; a row per piece."""
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("rank", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def split(batches):
        import numpy as np

        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows = []
            for doc, got in encoded(batch, enc):
                ids = memoryview(bytes(got) + end)
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    own = ids[4 * at : 4 * (at + length)]
                    row = (doc, at, length, zlib.crc32(own), n, part, seen[length])
                    rows.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
                    seen[length] += 1
                    at += length
                if len(rows) >= 20_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(split, encodes=True), out)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: bucket (the length's exponent) in the high bits, rank in the bucket below."""
    found = written(pieces(docs, tokenizer, end_id, longest, with_ids), "pack-pieces")
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = found.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    numbered = found.join(tally, ["length", "part"])
    bucket = F.log2("length").cast("int").cast("long")
    return numbered.withColumn("sequence_id", bucket * (1 << RANK_BITS) + F.col("_ahead") + F.col("rank")).withColumn("offset", F.lit(0).cast("long")).drop("part", "rank", "_ahead")
