"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

Plan
1. Each source's documents are shuffled (order of a hash of doc_id) into a token stream. Offsets are two-level
   prefix sums: totals per (source, bin) first, then positions inside a bin, so a source with a third of
   all rows is spread over its bins.
2. Targets: every source wants its weight's share of ``factor`` times all tokens, but at most ``passes``
   times its own; the excess goes to the others by weight (water filling over the sorted caps).
3. Slots 0..S-1 take the golden-ratio points frac(n * 0.618...). Cumulative target shares divide [0, 1)
   among the sources; slots meet the sources by an equality join on cells of that interval.
4. A slot's rank among its source's slots (again two-level) names the block of ``block`` tokens that it takes
   from the source's stream, read round and round. Each source keeps the ranks that its target needs; the few that
   the points leave short (their discrepancy is logarithmic) follow after the last slot.
5. Blocks join the pieces of the documents that they cover.

Cases: a null text has size 0, a document of size 0 is never taken; a null source is a source of its own, last
in order; repeated rows are separate pieces of their stream; no tokens at all give targets of 0; ties in the
shuffle are broken by doc_id, then size; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Fractional part of the golden ratio, and of 2^20 times it.
GOLDEN = 0.6180339887498949
GOLDEN_20 = (0.6180339887498948482045868343656 * 2**20) % 1.0
BLOCK = 256
#: Documents that a bin of a source's shuffle holds on average, and slots that a chunk of the schedule holds.
PER_BIN = 2048
PER_CHUNK = 16384


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t-\\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_shares(sizes: DataFrame, weights: list[float], factor: float, passes: int) -> DataFrame:
    """sizes(source, source_size) -> with weight and target. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))).withColumn("cap", F.lit(passes) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", (F.lit(factor) * F.sum("source_size").over(everything) - full) / left)
    level = level.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    rate = F.min(F.when(F.col("fits"), F.struct("cap_rate", "level"))).over(everything)["level"]
    level = level.withColumn("cap_rate", F.col("cap") / F.col("weight")).withColumn("rate", rate)
    return level.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap").cast("double"), F.col("rate") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def shuffled_streams(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """(stream(doc_id, source, size, begins), sizes(source, source_size)) of docs(doc_id, source, size)."""
    bits = max(0, min(24, math.ceil(math.log2(max(1, docs.count()) / PER_BIN))))
    # rows without an id are dealt by their size
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.col("size").cast("string")))).cast("binary"))
    dealt = docs.withColumn("_order", order).withColumn("_bin", F.conv(F.substring("_order", 1, 6), 16, 10).cast("long").bitwiseAND(2**24 - 1))
    dealt = dealt.withColumn("_bin", F.shiftright("_bin", 24 - bits))
    bins = written(dealt.groupBy("source", "_bin").agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows")), "mix-bins")
    ahead = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "_ahead")
    within = Window.partitionBy("source", "_bin").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    stream = placed.join(starts, placed["source"].eqNullSafe(starts["_s"]) & (placed["_bin"] == starts["_b"]))
    sizes = bins.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    return stream.select("doc_id", "source", "size", (F.col("_in") + F.col("_ahead")).alias("begins")), sizes


def golden_point(n: Column) -> Column:
    """frac(n * golden ratio) with n split in two so that precision holds to 2^40 slots."""
    high = F.shiftright(n, 20).cast("double") * F.lit(GOLDEN_20)
    low = n.bitwiseAND(2**20 - 1).cast("double") * F.lit(GOLDEN)
    x = (high - F.floor(high)) + (low - F.floor(low))
    return x - F.floor(x)


def schedule(spark: SparkSession, targets: DataFrame, block: int) -> DataFrame:
    """slots(slot, source_no, rank, words): the mix in order. targets: source_no, target (whole tokens).

    Slot n takes `words` tokens of its source from rank * block of the source's endless stream on."""
    wanted = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(targets.withColumn("lo", F.coalesce(F.sum("target").over(wanted), F.lit(0))), "mix-bounds")
    total, sources = bounds.agg(F.sum("target"), F.count("*")).first()
    total, sources = int(total or 0), int(sources)
    slots, cells = math.ceil(total / block), 4 * max(1, sources)
    scale = F.lit(cells / max(1, total))
    # a cell more on both sides, for the rounding of bounds
    first, last = F.greatest(F.floor(F.col("lo") * scale) - 1, F.lit(0)), F.least(F.floor((F.col("lo") + F.col("target")) * scale) + 1, F.lit(cells - 1))
    held = bounds.where("target > 0").withColumn("cell", F.explode(F.sequence(first, last)))
    numbered = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")).withColumn("at", F.col("x") * F.lit(float(total))).withColumn("cell", F.floor(F.col("x") * cells))
    met = numbered.join(held, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("target"))).select("slot", "source_no", "target", F.floor(F.col("slot") / PER_CHUNK).alias("chunk"))
    met = written(met, "mix-met")
    counts = met.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "mix-chunks")
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = met.withColumn("_in", F.row_number().over(inside) - 1).join(counts.drop("n"), ["source_no", "chunk"])
    need = F.ceil(F.col("target") / F.lit(block))
    ranked = ranked.select("slot", "source_no", "target", (F.col("_in") + F.col("ahead")).cast("long").alias("rank")).where(F.col("rank") < need)
    have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
    short = bounds.where("target > 0").join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < need)
    short = short.select("source_no", "target", "have", F.explode(F.sequence(F.col("have"), need - 1)).alias("rank"))
    short = short.select((F.lit(slots - 1) + (F.col("rank") - F.col("have")) * sources + F.col("source_no")).alias("slot"), "source_no", "target", "rank")
    words = F.least(F.lit(block), F.col("target") - F.col("rank") * block).cast("long")
    return ranked.unionByName(short).select("slot", "source_no", "rank", words.alias("words"))


def mix(docs: DataFrame, weights: list[float], factor: float = 1.5, passes: int = 2, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(taken, pieces) of docs(doc_id, source, size).

    taken: doc_id, size, source, source_size, target, taken, first_slot (null if none), n_slots, pass_slots (the first slot
    of each pass over the source) - a row per document.
    pieces: slot, doc_id, begins, words - the tokens [begins, begins + words) of doc_id that a slot takes."""
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", "source", "size"), "mix-sizes")
    stream, sizes = shuffled_streams(rows, seed)
    shares = target_shares(sizes, weights, factor, passes)
    shares = written(shares.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "mix-shares")
    stream = stream.join(shares.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    stream = written(stream, "mix-stream")
    slots = schedule(spark, shares.select("source_no", F.floor("target").alias("target")), block)
    # each document stands once in every pass of its source's endless stream
    laid = stream.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass")).withColumn("_from", F.col("begins") + F.col("_pass") * F.col("source_size"))
    laid = laid.where("size > 0 and _from < floor(target)")
    cut = laid.withColumn("rank", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_from + size - 1) div {block}"))))
    pieces = cut.join(slots, ["source_no", "rank"])
    first = F.greatest(F.col("_from"), F.col("rank") * block)
    last = F.least(F.col("_from") + F.col("size"), F.col("rank") * block + F.col("words"))
    pieces = pieces.select("slot", "source_no", F.col("begins").alias("_at"), "_pass", "doc_id", (first - F.col("_from")).alias("begins"), (last - first).alias("words")).where("words > 0")
    # a place in a source's stream is one document, besides documents without words
    got = pieces.groupBy("source_no", F.col("_at").alias("begins")).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.countDistinct("slot").alias("n_slots"), F.array(*[F.min(F.when(F.col("_pass") == p, F.col("slot"))) for p in range(passes)]).alias("pass_slots"))
    real = F.col("size") > 0
    taken = stream.join(got, ["source_no", "begins"], "left").withColumn("taken", F.when(real, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    taken = taken.withColumn("first_slot", F.when(real, F.col("first_slot"))).withColumn("n_slots", F.when(real, F.coalesce("n_slots", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return taken.select("doc_id", "size", "source", "source_size", "target", "taken", "first_slot", "n_slots", "pass_slots"), pieces


def whole_copies(taken: DataFrame) -> DataFrame:
    """copies(id, slot) of mix()'s taken: as many rows of an id as the mix takes whole copies of its document, to the nearest, each at the
    slot that comes to it first. Rows of one id share their words evenly; id is that of copy_id()."""
    by_id = taken.where("size > 0").groupBy(copy_id(F.col("doc_id"), F.col("size")).alias("id")).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("n"), F.min("pass_slots").alias("slots"))
    return by_id.where("n > 0").select("id", F.explode(F.slice("slots", 1, F.col("n"))).alias("slot"))


def copy_id(doc_id: Column, size: Column) -> Column:
    """What whole_copies() knows a document by: its id, or its size where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("none:"), size.cast("string")))
