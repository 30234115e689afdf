"""Set-similarity join on word shingles with adaptive multi-match prefixes, reported as components.

A document's set is its distinct shingles; two documents link when 100 * |x & y| >= percent * |x | y|.

1. Shingle frequencies are counted over all documents: tasks ship sorted, delta-coded 40-bit hashes per part. The most frequent
   ones (at most ``HEAVY``, and only those of ``MIN_DF`` documents or more) form a table of fixed size that is broadcast. It steers
   the order and the cost estimates alone; any table gives the same links.
2. Each set is ordered by (frequency class, hash), rare first. With n shingles, a = ceil(percent / 100 * n) and a match count l,
   two linked sets share at least l shingles among the first n - a + l of each. Every document picks its l: the prefix is lengthened
   while the estimated cost (shuffled tokens plus verifications, of which an inverted list of c entries can cause at most c / l)
   falls. A pair must share min(l of x, l of y) prefix tokens before it is verified.
3. Equal sets are one class, represented by its smallest doc_id; only representatives go on.
4. Tokens of at most ``SMALL`` representatives are joined with themselves; pairs are counted, then held against parity bitmaps (their
   difference bounds the sets' difference from below, so no link is lost).
5. A token of more representatives (a group of near copies) never becomes pairs: each representative is verified against the
   bucket's most typical one first. Only pairs that these links leave in different components are compared, bitmap against
   bitmap in blocks of ``BLOCK_ROWS``, and only those that may link leave the block.
6. Verification shingles both whole texts again. Links and classes give components by iterated joins in the shared folder.

Cases: a null, empty or blank text has an empty set and is a component of its own; fewer words than the width make one shingle of all;
doc_id identifies a document, and repeated rows are one node and get equal rows; a null doc_id keeps a null component; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import attach, components, semi_by_key, ship, tidy, written
from .shingles import set_key, shingle_sets

#: Frequent shingles that are broadcast (12 bytes each), and documents that one must occur in.
HEAVY = 1 << 18
MIN_DF = 16
#: Representatives up to which a token's bucket is joined with itself, and rows of a block beyond that.
SMALL = 32
BLOCK_ROWS = 500
#: Pairs that one copy of a text is joined with.
PAIRS_A_TEXT = 256
#: Shingles that a counting task gathers before it ships them.
GATHER = 1 << 21
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Cost of verifying one shingle against that of shuffling one prefix token.
VERIFY_COST = 0.05


def _texts(batch, column: int):
    """A batch's (doc_id, text) column as strings, a slice at a time."""
    for i in range(0, batch.num_rows, 256):
        part = batch.slice(i, 256)
        yield part, part.column(column).to_pylist()


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash >> 24, document frequency), by hash, of the at most HEAVY most frequent shingles."""
    parts = 1 << max(4, min(20, math.ceil(math.log2(max(1, docs.select("doc_id").count()) / 2000 + 1))))
    shift = np.uint64(40 - int(math.log2(parts)))

    def pack(held):
        h = np.sort(np.concatenate(held))
        cuts = np.searchsorted(h >> shift, np.arange(parts + 1, dtype=np.uint64))
        number, data = [], []
        for k in np.flatnonzero(np.diff(cuts)):
            own = h[cuts[k] : cuts[k + 1]]
            number.append(int(k))
            data.append(np.ascontiguousarray(np.diff(own, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in _texts(batch, 0):
                for s in shingle_sets(texts, width):
                    held.append(s >> np.uint64(24))
                    size += len(s)
                if size >= GATHER:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def count(group: pa.Table) -> pa.Table:
        own = [np.cumsum(np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()) for x in group.column("data")]
        h, n = np.unique(np.concatenate(own), return_counts=True)
        keep = n >= MIN_DF
        return pa.table({"hash": h[keep].astype(np.int64), "df": n[keep].astype(np.int64)})

    packed = docs.select(F.col("text").cast("string")).mapInArrow(tidy(gather), "part int, data binary")
    counted = written(packed.groupBy("part").applyInArrow(count, "hash long, df long"), "jaccard-df")
    least = MIN_DF
    total = 0
    # a histogram over powers of two (some 40 rows) finds the frequency above which at most HEAVY shingles lie
    for level, n in sorted(counted.groupBy(F.floor(F.log2("df")).alias("level")).count().collect(), reverse=True):
        total += n
        if total > HEAVY:
            least = 1 << (level + 1)
            break
    rows = counted.where(F.col("df") >= least).toPandas().sort_values("hash")
    return rows["hash"].to_numpy(np.uint64), rows["df"].to_numpy(np.int64)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, df: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(match count l, the prefix for it) of a sorted set with the known frequencies of its shingles (0: rare)."""
    n, a = len(s), needed(len(s), percent)
    order = np.argsort(np.where(df > 0, np.frexp(df.astype(float))[1], 0), kind="stable")
    spread = np.cumsum(np.maximum(df[order] - 1, 0))
    choices = [m for m in MATCHES if m <= a]
    cost = [n - a + m + VERIFY_COST * n * spread[n - a + m - 1] / m for m in choices]
    best = choices[int(np.argmin(cost))]
    return best, s[order[: n - a + best]]


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: bit i is the number of members that fall on i, modulo 2. At least 2 bits a member, a power of two."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(b: int, size: int, to: int) -> int:
    """A bitmap of `size` bits, as an integer, folded to `to` bits."""
    while size > to:
        size //= 2
        b = (b & ((1 << size) - 1)) ^ (b >> size)
    return b


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only if sets of n and m members with these bitmaps can't link."""
    small = min(len(x), len(y)) * 8
    differ = (folded(int.from_bytes(x, "little"), len(x) * 8, small) ^ folded(int.from_bytes(y, "little"), len(y) * 8, small)).bit_count()
    return differ * (100 + percent) <= (100 - percent) * (n + m)


def described(docs: DataFrame, width: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row per document: doc_id, n, cls (key of the set), typical (share of frequent shingles), matches, prefix (its rare tokens), frequent (those of
    the table), bits."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("typical", pa.float32()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64())), ("frequent", pa.list_(pa.int64())), ("bits", pa.binary())])

    def describe(batches):
        known, df = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[known >> np.uint64(18)] = True
        for batch in batches:
            for part, texts in _texts(batch, 1):
                rows = []
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(texts, width)):
                    if not len(s):
                        rows.append((doc, 0, b"", 0.0, 0, [], [], b""))
                        continue
                    freq = np.zeros(len(s), np.int64)
                    look = np.flatnonzero(maybe[s >> np.uint64(42)])
                    if len(look):
                        own = s[look] >> np.uint64(24)
                        k = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        freq[look] = np.where(known[k] == own, df[k], 0)
                    matches, first = prefix(s, freq, percent)
                    often = freq[np.searchsorted(s, first)] > 0
                    rows.append((doc, len(s), set_key(s), float((freq > 0).mean()), matches, first[~often].view(np.int64), first[often].view(np.int64), bitmap(s)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(describe), "doc_id long, n int, cls binary, typical float, matches int, prefix array<long>, frequent array<long>, bits binary")


def with_texts(pairs: DataFrame, texts: DataFrame, side: str, into: str) -> DataFrame:
    """pairs with the text of the ids in column `side`. An id of many pairs (a star) has a copy of its text for every PAIRS_A_TEXT of them, so its
    pairs spread over tasks."""
    often = pairs.groupBy(side).agg(F.count("*").alias("held")).where(F.col("held") > PAIRS_A_TEXT)
    often = written(often.select(side, "held", F.ceil(F.col("held") / PAIRS_A_TEXT).cast("int").alias("parts")), "jaccard-often")
    laid = attach(texts.withColumnRenamed("doc_id", side), often, [side], "held")
    laid = laid.select(side, F.col("text").alias(into), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    cut = attach(pairs, often, [side], "held").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"), F.lit(0)))
    return cut.drop("held", "parts").join(laid, [side, "part"]).drop("part")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs(a, b) of doc_ids whose whole texts link."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ids")
    texts = semi_by_key(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), ids, "doc_id")
    both = with_texts(with_texts(pairs.select("a", "b"), texts, "a", "x"), texts, "b", "y")

    def check(batches):
        for batch in batches:
            keep, kept = [], {}
            for i in range(0, batch.num_rows, 64):
                a, b, x, y = (c.to_pylist() for c in batch.slice(i, 64).columns)
                new = {d: t for d, t in zip(a + b, x + y) if d not in kept}
                kept.update(zip(new, shingle_sets(list(new.values()), width)))
                for p, q in zip(a, b):
                    s, t = kept[p], kept[q]
                    same = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * same >= percent * (len(s) + len(t) - same):
                        keep.append((p, q))
                if len(kept) > 2000:
                    kept = {}
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def may_link_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose bitmaps allow a link."""
    bits = nodes.select("doc_id", "n", "bits")
    both = pairs.join(bits.toDF("a", "n", "x"), "a").join(bits.toDF("b", "m", "y"), "b")

    def check(batches):
        for batch in batches:
            a, b, n, x, m, y = (batch.column(c).to_pylist() for c in ("a", "b", "n", "x", "m", "y"))
            keep = [(p, q) for p, q, i, s, j, t in zip(a, b, n, x, m, y) if may_link(i, s, j, t, percent)]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep)], ["a", "b"])

    return both.mapInArrow(tidy(check), "a long, b long")


def block_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows(token, doc_id, n, component, bits) of one token and different components that may link.

    Sets that link lie in one band of sizes or in neighbouring ones: a group holds a band of a token's bucket and, as guests, the next one.
    A group of s * BLOCK_ROWS rows is cut in s parts by a hash of doc_id, and each pair of parts is compared in a task of its own."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * (1 + 1e-9))) if percent < 100 else F.col("n").cast("long")
    rows = rows.withColumn("band", band).withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("guest"))
    sizes = written(rows.groupBy("token", "band").agg(F.count("*").alias("held"), F.min("guest").alias("least")).where("held > 1 and least = 0").drop("least"), "jaccard-bands")
    rows = attach(rows, sizes, ["token", "band"], "held").where("held is not null")
    parts = F.ceil(F.col("held") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    cut = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def compare(group: pa.Table) -> pa.Table:
        doc, n, comp, own, guest = (group.column(c).to_numpy() for c in ("doc_id", "n", "component", "own", "guest"))
        bits = group.column("bits").to_pylist()
        cross = len(np.unique(own)) > 1
        p = own.min()
        found = []
        sizes = np.array([len(b) for b in bits])
        for size in np.unique(sizes):
            # sets that can link differ by less than a factor of two, so their bitmaps do by two at most
            here = np.flatnonzero((sizes == size) | (sizes == 2 * size))
            mine = np.array([np.frombuffer(folded(int.from_bytes(bits[i], "little"), len(bits[i]) * 8, int(size) * 8).to_bytes(int(size), "little"), np.uint64) for i in here])
            first = sizes[here] == size
            for k in np.flatnonzero(first):
                i = here[k]
                ok = (comp[here] != comp[i]) & (~first | (np.arange(len(here)) > k)) & (guest[here] + guest[i] < 2)
                if cross:
                    ok &= own[here] != own[i]
                j = np.flatnonzero(ok)
                if len(j):
                    differ = np.bitwise_count(mine[j] ^ mine[k]).sum(axis=1, dtype=np.int64)
                    j = j[differ * (100 + percent) <= (100 - percent) * (n[here[j]].astype(np.int64) + int(n[i]))]
                    found += [(min(doc[i], doc[x]), max(doc[i], doc[x])) for x in here[j]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut.select("token", "band", "p", "q", "doc_id", "n", "component", "own", "guest", "bits").groupBy("token", "band", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def shingle_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id; a row per document."""
    ship(docs.sparkSession)
    heavy = frequent_shingles(docs, width)
    rows = written(described(docs, width, percent, heavy), "jaccard-rows")
    classes = written(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "jaccard-classes")
    nodes = rows.join(classes.select("doc_id"), "doc_id", "left_semi").where("n > 0")

    star = F.struct("typical", -F.col("doc_id"))
    columns = ["token", "doc_id", "n", "matches", "size", (-F.col("star.col2")).alias("star")]
    # a token outside the table is in few sets, so its rows may meet in one task
    by_token = Window.partitionBy("token")
    rare = nodes.select("doc_id", "n", "matches", "typical", F.explode("prefix").alias("token"))
    rare = rare.withColumn("size", F.count("*").over(by_token)).withColumn("star", F.max(star).over(by_token)).where("size > 1").select(*columns)
    often = nodes.select("doc_id", "n", "matches", "typical", F.explode("frequent").alias("token"))
    buckets = written(often.groupBy("token").agg(F.count("*").alias("size"), F.max(star).alias("star")).where("size > 1"), "jaccard-buckets")
    tokens = written(rare.unionByName(attach(often, buckets, ["token"], "size").where("size is not null").select(*columns)), "jaccard-tokens")

    # large buckets: everyone against the bucket's most typical set, by the star met most often
    large = tokens.where(F.col("size") > SMALL)
    stars = large.where("doc_id <> star").groupBy("doc_id", "star").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.max(F.struct("c", "star")).alias("best"))
    star_pairs = written(stars.select(F.least("doc_id", "best.star").alias("a"), F.greatest("doc_id", "best.star").alias("b")).distinct(), "jaccard-stars")
    star_links = written(verified(star_pairs, docs, width, percent), "jaccard-star-links")
    joined = components(star_links, "jaccard-star-components")
    placed = large.join(joined.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = written(placed.groupBy("token").agg((F.min("component") < F.max("component")).alias("apart"), F.count("*").alias("held")).where("apart").select("token", "held"), "jaccard-apart")
    blocks = attach(placed, apart, ["token"], "held").where("held is not null").join(nodes.select("doc_id", "bits"), "doc_id").select("token", "doc_id", "n", "component", "bits")
    far = block_candidates(blocks, percent)

    # small buckets: pairs, counted against the match counts; tokens in large buckets count as shared
    wide = large.groupBy("doc_id").agg(F.count("*").alias("wide"))
    small = tokens.where(F.col("size") <= SMALL).join(wide, "doc_id", "left").select("token", "doc_id", "n", "matches", F.coalesce("wide", F.lit(0)).alias("wide"))
    left, right = small.toDF("token", "a", "n", "k", "v"), small.toDF("token", "b", "m", "l", "w")
    pairs = left.join(right, "token").where(f"a < b and 100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.least("k", "l")).alias("need"), F.min(F.least("v", "w")).alias("spare")).where("c + spare >= need")
    near = may_link_pairs(pairs.select("a", "b"), nodes, percent)

    candidates = written(near.unionByName(far).distinct(), "jaccard-candidates")
    links = written(star_links.unionByName(verified(candidates, docs, width, percent)), "jaccard-links")
    grouped = components(links)
    named = classes.join(grouped.toDF("doc_id", "component"), "doc_id", "left").select("cls", F.coalesce("component", "doc_id").alias("component_id"), "copies")
    named = written(named.where("copies > 1 or component_id <> doc_id").select("cls", "component_id", "copies"), "jaccard-named")
    found = attach(rows.select("doc_id", "n", "cls"), named, ["cls"], "copies")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
