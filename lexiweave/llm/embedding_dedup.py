"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

1. Rows of equal vectors are one class with a multiplicity, so copies of a vector never meet each other.
2. A random rotation (made from a seed, never shipped) turns each unit vector x into y; its code is the signs of y and its factor
   f = |y|_1 / sqrt(d), the inner product of y with its own code. For another rotated unit vector z, <code, z> / f is an unbiased estimate of
   cos(x, z) whose deviation is about sin(x, z) * sqrt((1 - f^2) / f^2 / (d - 1)), so for pairs that link at most what it is at the threshold. z itself is known to four bits a component (the sign, which is its
   code, and eight steps) and to the norm of what these leave out, which bounds the rest of the error. A pair whose estimate falls short of the
   threshold by over ``SIGMAS`` deviations and that bound is dropped; the others are undecided.
3. Pairs meet in tables: table t keys a class by the signs of `bits` further random directions. bits grows with log2 of the number of classes,
   so buckets keep their size, and the number of tables follows from the miss rate ``MISS`` allowed to a pair just at the threshold.
4. A bucket of over ``BLOCK_ROWS`` classes is cut in parts, and each pair of parts is a group. First only codes travel: a group returns the
   classes that are in any undecided pair. Only these are joined with their vectors and compared exactly in double precision, a pair only in the
   first table that its keys share, so it counts once. Groups return counts for each class and a spanning star of what they link, never the pairs.

Cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is a component of its own; vectors
of different lengths never link; repeated rows are vectors of their own that link with each other; a null vec_id takes part and is
never a component's name unless all are null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, components, ship, tidy, written

THRESHOLD = 0.95
#: Share of pairs just at the threshold that no table may bring together.
MISS = 1e-6
#: Classes in a bucket on average, and classes in a block.
BUCKET = 512
BLOCK_ROWS = 2048
SIGMAS = 6.0
SEED = 20240607


def rotation(d: int) -> np.ndarray:
    """A random orthogonal d x d matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, d])).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def directions(d: int, n: int) -> np.ndarray:
    """d x n random directions for the tables' keys, orthogonal within each run of d."""
    g = np.random.Generator(np.random.PCG64([SEED, d, 1]))
    return np.concatenate([np.linalg.qr(g.standard_normal((d, d)))[0] for _ in range(-(-n // d))], axis=1)[:, :n]


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """(tables, bits of each) for so many classes."""
    bits = max(1, min(31, round(math.log2(max(2, classes) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-together)), bits


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The key of each vector in each of the first tables."""
    sign = (x @ directions(x.shape[1], tables * bits) > 0).reshape(len(x), tables, bits)
    return (sign * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def quantised(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed, step, left): components in 16 levels, two in a byte; the width of a level; the norm of what the levels leave out.

    Levels are odd multiples of half a step, so their signs are those of y (0 counts as negative)."""
    step = np.maximum(np.abs(y).max(axis=1) / 8, 1e-30).astype(np.float32)
    level = np.where(y > 0, np.clip(np.ceil(y / step[:, None]), 1, 8) + 7, np.clip(np.floor(y / step[:, None]), -8, -1) + 8).astype(np.uint8)
    left = np.linalg.norm(y - unpacked(level, step), axis=1) + 1e-6
    level = np.pad(level, ((0, 0), (0, y.shape[1] % 2)))
    return level[:, ::2] << 4 | level[:, 1::2], step, left.astype(np.float32)


def unpacked(level: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (level.astype(np.float32) - 7.5) * step[:, None]


def keyed(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """A row per class and table: table, d, key, node, code (quantised), step, left, factor."""
    fields = [("t", pa.int32()), ("d", pa.int32()), ("key", pa.int32()), ("node", pa.int64()), ("code", pa.binary()), ("step", pa.float32()), ("left", pa.float32()), ("factor", pa.float32())]
    schema = pa.schema(fields)

    def key(batches):
        for batch in batches:
            node, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths = np.array([len(v) // 8 for v in vectors])
            for d in np.unique(lengths):
                here = np.flatnonzero(lengths == d)
                for lo in range(0, len(here), 2048):
                    own = here[lo : lo + 2048]
                    x = _unit([vectors[i] for i in own])
                    y = x @ rotation(int(d))
                    factor = (np.abs(y).sum(axis=1) / math.sqrt(d)).astype(np.float32)
                    codes, step, left = quantised(y)
                    keys = _keys(x, tables, bits)
                    n = len(own)
                    at = np.tile(np.arange(n), tables)
                    packed = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(tables, dtype=np.int32), n)), pa.array(np.full(n * tables, d, np.int32)), pa.array(keys.T.ravel()), pa.array(node[own][at]), packed, *(pa.array(v[at]) for v in (step, left, factor))], schema=schema)

    return classes.select("node", "vector").mapInArrow(tidy(key), "t int, d int, key int, node long, code binary, step float, left float, factor float")


def undecided(group: pa.Table, threshold: float) -> pa.Table:
    """t, d, key, p, q, node, own of the classes of one block that are in a pair which the codes do not rule out."""
    own = group.column("own").to_numpy()
    n, d = len(own), int(group.column("d")[0].as_py())
    raw = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(n, -1)
    level = np.stack([raw >> 4, raw & 15], axis=2).reshape(n, -1)[:, :d]
    step, left, factor = (group.column(c).to_numpy() for c in ("step", "left", "factor"))
    z, signs = unpacked(level, step), np.where(level > 7, 1, -1).astype(np.float32)
    slack = SIGMAS * math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, d - 1)) + 1e-5
    cross = len(np.unique(own)) > 1
    open_ = np.zeros(n, bool)
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        estimate = (signs[lo:hi] @ z[lo:].T) / math.sqrt(d)
        may = (estimate + left[None, lo:]) / factor[lo:hi, None] + slack[lo:hi, None] >= threshold
        may &= own[lo:hi, None] != own[None, lo:] if cross else np.arange(lo, hi)[:, None] < np.arange(lo, n)[None, :]
        open_[lo:hi] |= may.any(axis=1)
        open_[lo:] |= may.any(axis=0)
    return group.select(["t", "d", "key", "p", "q", "node", "own"]).filter(pa.array(open_))


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the smallest member's place for each place) after linking places a and b."""
    while True:
        p, q = root[a], root[b]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if (low == high).all():
            return root
        root = root.copy()
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def links_of(group: pa.Table, threshold: float, bits: int) -> pa.Table:
    """Links of one block: node, links (vectors that it links with here), root (a node it is connected with here)."""
    group = group.sort_by("node")
    node, copies, own = (group.column(c).to_numpy() for c in ("node", "copies", "own"))
    n, t = len(node), int(group.column("t")[0].as_py())
    x = _unit(group.column("vector").to_pylist())
    keys = _keys(x, t, bits) if t else np.zeros((n, 0), np.int32)
    near = x.astype(np.float32)
    cross = len(np.unique(own)) > 1
    links, root = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        i, j = np.nonzero(near[lo:hi] @ near[lo:].T >= threshold - 1e-4 - 1e-7 * x.shape[1])  # far above the error of single precision
        i, j = i + lo, j + lo
        keep = (i < j) & ((own[i] != own[j]) if cross else True)
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            if t:
                new = ~(keys[a] == keys[b]).any(axis=1)
                a, b = a[new], b[new]
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[hit], b[hit]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = joined(root, a, b)
    linked = np.flatnonzero(links)
    return pa.table({"node": pa.array(node[linked]), "links": pa.array(links[linked]), "root": pa.array(node[root[linked]])})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept; a row per vector."""
    ship(vectors.sparkSession)
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    doubles = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    # -0.0 and 0.0 are one value; the packed bytes are the class's key
    rows = doubles.select("vec_id", F.when(finite, F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))).alias("embedding"))
    rows = written(rows.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json(F.struct("embedding")), 256)).alias("cls")), "embed-rows")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min("embedding").alias("embedding"))

    def pack(batches):
        for batch in batches:
            data = [np.asarray(v, np.float64).tobytes() for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], ["cls", "node", "copies", "vector"])

    nodes = written(classes.select("cls", F.coalesce("vec_id", F.xxhash64("cls")).alias("node"), "copies", "embedding").mapInArrow(tidy(pack), "cls string, node long, copies long, vector binary"), "embed-classes")
    tables, bits = plan(nodes.count(), threshold)
    spread = keyed(nodes, tables, bits)
    sizes = written(spread.groupBy("t", "d", "key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_ROWS), "embed-large")
    cut = spread.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["t", "d", "key"], "left")
    parts = F.coalesce(F.ceil(F.col("size") / BLOCK_ROWS).cast("int"), F.lit(1))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    block = ["t", "d", "key", "p", "q"]
    left_open = cut.select(*block, "node", "own", "code", "step", "left", "factor").groupBy(*block).applyInArrow(lambda g: undecided(g, threshold), "t int, d int, key int, p int, q int, node long, own int")
    left_open = written(left_open, "embed-undecided")
    # a class stands in a block of each table at most once for each other part, so no node is hot here
    again = left_open.join(nodes.select("node", "copies", "vector"), "node")
    found = again.groupBy(*block).applyInArrow(lambda g: links_of(g, threshold, bits), "node long, links long, root long")
    found = written(found, "embed-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "embed-components")
    named = nodes.select("cls", "node", "copies").join(counts, "node", "left").join(grouped, "node", "left")
    named = named.select("cls", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    result = attach(rows.select("vec_id", "cls"), written(named.where("n_links > 0"), "embed-named"), ["cls"], "copies")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
