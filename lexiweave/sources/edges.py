"""Readers of association data and derivations of edges; all give src, dst, weight."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stamp, written
from ..functions.words import clean_word, number, plain_word

# Relations that the wide and the light ConceptNet scans keep.
CONCEPTNET_WIDE = (
    "/r/RelatedTo", "/r/IsA", "/r/PartOf", "/r/HasA", "/r/UsedFor", "/r/CapableOf", "/r/AtLocation", "/r/Causes", "/r/HasSubevent",
    "/r/HasFirstSubevent", "/r/HasLastSubevent", "/r/HasPrerequisite", "/r/HasProperty", "/r/MotivatedByGoal", "/r/ObstructedBy",
    "/r/Desires", "/r/CreatedBy", "/r/Synonym", "/r/Antonym", "/r/DerivedFrom", "/r/EtymologicallyDerivedFrom",
    "/r/EtymologicallyRelatedTo", "/r/FormOf", "/r/DefinedAs", "/r/MannerOf", "/r/LocatedNear", "/r/HasContext", "/r/SimilarTo", "/r/DistinctFrom",
)
CONCEPTNET_LIGHT = ("/r/RelatedTo", "/r/Synonym", "/r/IsA", "/r/UsedFor", "/r/CapableOf")
STRENGTH_COLUMNS = ("strength.R123", "R123.Strength", "strength", "R123")


def _sum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def clean_edges(rows: DataFrame) -> DataFrame:
    """The loader's rules on string columns src, dst, weight: comment rows (src starts with # before trimming) go, words are
    trimmed and lower-cased, empty ones go, weights that are no finite number over 0 go, duplicates add up, self-loops stay."""
    rows = rows.where(~F.coalesce(F.col("src").startswith("#"), F.lit(False)))
    rows = rows.select(clean_word("src").alias("src"), clean_word("dst").alias("dst"), number("weight").alias("weight"))
    return _sum(rows.where("src <> '' and dst <> '' and weight > 0"))


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; columns are matched by name, others ignored."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    weight = F.col("weight") if "weight" in raw.columns else F.lit("0")
    return clean_edges(raw.select(F.col("src"), F.col("dst"), weight.alias("weight")))


def read_edge_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_edges(spark.read.parquet(path).select(*[F.col(c).cast("string") for c in ("src", "dst", "weight")]))


def discover(spark: SparkSession, folder: str, skip: str = "usf") -> list[str]:
    """Names of edges_*.csv files in a folder in order, without those that hold `skip`."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "edges_*.csv").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return sorted(r["name"] for r in found.collect() if not skip or skip not in r["name"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files. Lines are counted inside each block of a file and offset by the blocks before it."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.withColumn("inside", inside).join(blocks, ["file", "block"]).select("file", (F.col("inside") + F.col("ahead")).alias("line"), "value")


def read_zip_lines(spark: SparkSession, path: str, *parts: str) -> DataFrame:
    """file, line (from 1), value of those members of zip files whose names hold all parts; a task unpacks an archive as a stream of lines."""

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if all(p in n for p in parts)):
                        held, own = [], f"{archive}!{name}"
                        with z.open(name) as f:
                            for number, value in enumerate(io.TextIOWrapper(f, encoding="utf-8", errors="replace"), 1):
                                held.append((own, number, value.rstrip("\r\n")))
                                if len(held) == 20_000:
                                    yield pd.DataFrame(held, columns=["file", "line", "value"])
                                    held = []
                        if held:
                            yield pd.DataFrame(held, columns=["file", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, line long, value string")


def delimited(lines: DataFrame) -> DataFrame:
    """The rows of lines(line, value) under the header of the first line; parted by tabs if the second line holds one, else by commas."""
    top = [r["value"] for r in lines.select("line", "value").orderBy("line").limit(2).collect()]
    if not top:
        return lines.select()
    sep = "\t" if "\t" in top[-1] else ","
    names = next(csv.reader([top[0]], delimiter=sep))
    first = lines.agg(F.min("line")).first()[0]
    row = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "escape": '"'})
    return lines.where(F.col("line") > first).select(row.alias("r")).select("r.*")


def primary(names) -> str | None:
    """The data set to analyse: the pruned, the merged or the complete one, else the first at hand."""
    names = list(names)
    return next((n for n in ("pruned", "merged", "complete") if n in names), names[0] if names else None)


def conceptnet_rows(lines: DataFrame, relations=None, longest: int = 20, least: float = 0.0) -> DataFrame:
    """src, dst, weight and whatever lines(value) has besides: tab-separated assertions. English word pairs of the given relations (None: all)
    with weight over `least`."""
    f, more = F.split("value", "\t"), [c for c in lines.columns if c != "value"]
    rows = lines.where(F.size(f) >= 5).select(*more, f[1].alias("rel"), f[2].alias("a"), f[3].alias("b"), f[4].alias("meta"))
    rows = rows.where(F.col("a").startswith("/c/en/") & F.col("b").startswith("/c/en/"))
    rows = rows.where(F.col("rel").isin(*relations)) if relations else rows
    word = lambda c: F.lower(F.split(F.col(c), "/")[3])
    rows = rows.select(*more, word("a").alias("src"), word("b").alias("dst"), F.coalesce(number(F.get_json_object("meta", "$.weight")), F.lit(1.0)).alias("weight"))
    return rows.where((F.col("src") != F.col("dst")) & plain_word("src", longest) & plain_word("dst", longest) & (F.col("weight") > least))


def parse_conceptnet(lines: DataFrame, relations=None, longest: int = 20, least: float = 0.0, merge: str = "sum", enough: int | None = None, chunk: int = 250_000) -> DataFrame:
    """The edges of conceptnet_rows(); equal pairs are summed, or their maximum is taken. With `enough`, lines(line, value) are read in chunks:
    reading stops before the first line that is a multiple of `chunk` once there are that many edges."""
    rows = conceptnet_rows(lines, relations, longest, least)
    if enough is not None:
        rows = rows.withColumn("part", F.floor(F.col("line") / chunk))
        firsts = rows.groupBy("src", "dst").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
        so_far = firsts.withColumn("n", F.sum("n").over(Window.orderBy("part")))  # a row for each chunk of the file
        last = so_far.where(F.col("n") >= enough).agg(F.min("part")).first()[0]
        rows = rows if last is None else rows.where(F.col("part") <= last)
    fold = F.max("weight") if merge == "max" else F.sum("weight")
    return rows.groupBy("src", "dst").agg(fold.alias("weight"))


def parse_swow(rows: DataFrame, strengths=STRENGTH_COLUMNS, longest: int | None = 25, plain: bool = True) -> DataFrame:
    """rows with cue, response and any of the strength columns; the first non-empty one counts."""
    have = [c for c in strengths if c in rows.columns]
    strength = F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in have]) if have else F.lit(None).cast("string")
    out = rows.select(clean_word("cue").alias("src"), clean_word("response").alias("dst"), number(strength).alias("weight"))
    out = out.where("src <> '' and dst <> '' and src <> dst and weight > 0")
    return out.where(plain_word("src", longest) & plain_word("dst", longest)) if plain else out


def parse_swow_lines(lines: DataFrame, strengths=STRENGTH_COLUMNS, longest: int = 25, last_line: int | None = 50_002) -> DataFrame:
    """lines(line, value) parted by tabs, with a header, quotes around fields dropped, three fields at least; the first strength column that
    holds a number counts. Lines after last_line are not read (None: all are)."""
    top = lines.select("line", "value").orderBy("line").limit(1).collect()
    names = [x.strip('"').strip() for x in top[0]["value"].strip().split("\t")] if top else []
    rows = lines.where(F.col("line") > (top[0]["line"] if top else 0))
    rows = rows if last_line is None else rows.where(F.col("line") <= last_line)
    f = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    field = lambda n: F.regexp_replace(F.regexp_replace(F.get(f, F.lit(names.index(n))), '^"+|"+$', ""), r"^\s+|\s+$", "") if n in names else F.lit(None).cast("string")
    strength = F.coalesce(F.lit(None).cast("double"), *[number(field(c)) for c in strengths if c in names])
    out = rows.where(F.size(f) >= 3).select(F.lower(field("cue")).alias("src"), F.lower(field("response")).alias("dst"), strength.alias("weight"))
    return out.where((F.col("src") != F.col("dst")) & (F.col("weight") > 0) & plain_word("src", longest) & plain_word("dst", longest))


def parse_association_lines(lines: DataFrame, longest: int = 20, plain: bool = True) -> DataFrame:
    """lines(value): stimulus, response and frequency parted by white space; # lines, blank and short lines go."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(f) >= 3)).select(F.lower(f[0]).alias("src"), F.lower(f[1]).alias("dst"), number(f[2]).alias("weight"))
    rows = rows.where("weight > 0 and src <> dst")
    return rows.where(plain_word("src", longest) & plain_word("dst", longest)) if plain else rows


def parse_colon_lines(lines: DataFrame) -> DataFrame:
    """lines(value): `CUE: T1 f1, T2 f2` with one colon, or `cue target strength`."""
    text = F.trim("value")
    colon = F.size(F.split(text, ":")) == 2
    pairs = lines.where(colon).select(F.lower(F.trim(F.split(text, ":")[0])).alias("src"), F.explode(F.split(F.split(text, ":")[1], ",")).alias("pair"))
    f = F.split(F.trim("pair"), r"\s+")
    pairs = pairs.where(F.size(f) >= 2).select("src", F.lower(f[0]).alias("dst"), number(f[1]).alias("weight"))
    g = F.split(text, r"\s+")
    triples = lines.where(~F.contains(text, F.lit(":")) & (F.size(g) >= 3)).select(F.lower(g[0]).alias("src"), F.lower(g[1]).alias("dst"), number(g[2]).alias("weight"))
    return pairs.unionByName(triples).where("src <> '' and dst <> '' and src <> dst and weight > 0")


def _usf_edges(cues: DataFrame, longest: int) -> DataFrame:
    rows = cues.select(clean_word("_word").alias("src"), F.explode("target").alias("t")).select("src", clean_word("t._word").alias("dst"), number("t._fsg").alias("weight"))
    return rows.where(F.col("src").rlike("^[a-z]+$") & plain_word("dst", longest) & (F.col("src") != F.col("dst")) & (F.col("weight") > 0))


CUE = "_word string, target array<struct<_word: string, _fsg: string>>"


def read_usf_xml(spark: SparkSession, path: str, longest: int = 25) -> DataFrame:
    """<cue word><target word fsg/></cue> by Spark's XML reader."""
    return _usf_edges(spark.read.format("xml").option("rowTag", "cue").schema(CUE).load(path), longest)


def read_usf_zip(spark: SparkSession, path: str, longest: int = 25) -> DataFrame:
    """The same from the .xml members of zip files, a member's text at a time."""
    texts = read_zip_lines(spark, path, ".xml").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"))
    cues = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<cue\b[^>]*>.*?</cue>"), F.lit(0))).alias("cue"))
    return _usf_edges(cues.select(F.from_xml("cue", CUE).alias("c")).select("c.*"), longest)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def document_edges(docs: DataFrame, least: float = 2.0, by: tuple[str, ...] = (), self_loops: bool = False) -> DataFrame:
    """Adjacent word pairs of docs(text), weight = how often; optionally one graph for each value of `by`, and with pairs of equal words."""
    words = docs.select(*by, tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = words.select(*by, F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("src"), F.slice("w", F.lit(2), F.size("w") - 1).alias("dst"))).alias("p")).select(*by, "p.src", "p.dst")
    pairs = pairs if self_loops else pairs.where("src <> dst")
    return pairs.groupBy(*by, "src", "dst").agg(F.count("*").cast("double").alias("weight")).where(F.col("weight") >= least)


def cooccurrence_edges(docs: DataFrame, window: int = 5, least: int = 2, per_source: int | None = 25) -> DataFrame:
    """Words within `window` places after each word; the strongest `per_source` targets of each source."""
    words = docs.select(tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    ahead = F.flatten(F.transform("w", lambda x, i: F.transform(F.array_distinct(F.slice("w", i + 2, F.lit(window))), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    pairs = words.select(F.explode(ahead).alias("p")).select("p.*").where("src <> dst")
    edges = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).where(F.col("weight") >= least)
    return top_per_source(edges, per_source) if per_source else edges


def top_per_source(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def event_transitions(events: DataFrame) -> DataFrame:
    """event_type -> next event_type of the same user, without self-transitions."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


_kept: dict[tuple, DataFrame] = {}


def kept_document_edges(spark: SparkSession, sf_dir: str, least: float = 2.0) -> DataFrame:
    """document_edges of a folder's documents, written once per application and content of the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, f"{sf_dir}/documents.parquet"), least)
    if key not in _kept:
        _kept[key] = written(document_edges(spark.read.parquet(f"{sf_dir}/documents.parquet"), least), "edges")
    return _kept[key]
