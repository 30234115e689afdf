"""From raw documents to packed sequences: language ID, exact dedup, near dedup, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything its predecessor kept; run() writes each result as
Parquet into the shared folder and reads it again. All stages but the last return the columns of documents.

Cases: documents without a letter (null and empty texts among them) leave in the first stage; repeated rows leave in the second; extra columns
pass through; an empty table passes all stages empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import exact_dedup, jaccard_join, language, mixing, packing
from lexiweave.llm.shared import BROADCAST_ROWS, spare, table, written

#: Posterior below which no language is taken for granted.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle and percent of Jaccard similarity.
WIDTH, PERCENT = 5, 80
WEIGHTS, FACTOR, PASSES = [3.0, 1.0, 2.0], 1.5, 2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter or no likely language."""
    into = spare(docs, "language"), spare(docs, "posterior")
    found = language.identify(docs, language.fit(docs), into)
    return found.where((F.col(into[0]) != "und") & (F.col(into[1]) >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the copy with the largest doc_id of each text."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest doc_id of each group of near copies."""
    found = jaccard_join.shingle_components(docs, WIDTH, PERCENT)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-near-copies")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources approach their target weights, in the order of the schedule: a document stands
    as often as the mix takes it, to the nearest whole copy, each copy where the schedule first comes to it."""
    size = mixing.n_words(F.col("text"))
    taken, _ = mixing.mix(docs.select("doc_id", "source", size.alias("size")), WEIGHTS, FACTOR, PASSES)
    known, slot = spare(docs, "known"), spare(docs, "slot")
    copies = mixing.whole_copies(taken).select(F.col("id").alias(known), F.col("slot").alias(slot))
    laid = docs.withColumn(known, mixing.copy_id(F.col("doc_id"), size)).join(copies, known)
    return laid.repartitionByRange(slot).sortWithinPartitions(slot, known).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, longest=1024)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned, set-similarity and tokenizer stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
