"""Exact dedup, near dedup of texts and of embeddings, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lexiweave.llm import embedding_dedup, exact_dedup, jaccard_join, shingles
from lexiweave.llm.shared import components

LOWER = {i: i + 32 for i in range(65, 91)}


def union(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_exact_cases(make_docs):
    rows = [(1, "Abc", "en", "a"), (2, "aBC", None, "b"), (3, "Ü", "de", "a"), (4, "ü", "de", "a"), (5, None, None, None), (6, "", "en", "a"), (7, "x" * 100_000, "en", "a"), (8, "abc ", "en", "a"), (2, "aBC", None, "b"), (None, "abc", "en", "a"), (None, "lone", "en", "a")]
    got = exact_dedup.exact_duplicates(make_docs(rows), capacity=1).collect()
    norm = lambda t: (t or "").translate(LOWER)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), str(k := max((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), i == k, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.drop_duplicates(make_docs(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "6", "7", "8", "None"]
    assert exact_dedup.exact_duplicates(make_docs([])).count() == 0


def test_directory_splits_only_full_buckets(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    slots, bits = exact_dedup.build_directory(keys, 5000, 64)
    fill = keys.withColumn("cell", exact_dedup.cell_of(keys["key"], bits)).join(slots, "cell").groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in fill) == 5000 and max(r["count"] for r in fill) <= 64 and len({r["bucket"] for r in fill}) == len(fill)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in union(nodes, [x for x in links if x[0] != x[1]]).items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_jaccard(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = union(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def test_hashed_sets_are_the_sets(texts):
    some = [*list(texts.values())[:40], None, "", " \t\n", "One", "a b c d\x0be  F", "a\x1cb a\xa0b", "é" * 70_000 + " x y z w", "w " * 90_000]
    for width in (4, 5):
        assert [len(s) for s in shingles.shingle_sets(some, width)] == [len(shingle_set(t, width)) for t in some]
    a, b = shingles.shingle_sets(["A b c D e", "x a B c d e"], 4)
    assert len(np.intersect1d(a, b)) == 2


@pytest.mark.parametrize(("small", "block"), [(jaccard_join.SMALL, jaccard_join.BLOCK_ROWS), (3, 8)])
def test_jaccard_components(make_docs, monkeypatch, small, block):
    """Near copies around the threshold, hot groups, shared passages; once with limits so low that blocks are split."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "MIN_DF", 4)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_TEXT", block)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[k] = word()
        rows.append((i, " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    rows += [(100 + i, " ".join(word() for _ in range(90)) + " " + passage) for i in range(20)]
    rows += [(300 + k, " ".join(base[:k])) for k in range(4, 121, 3)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One  two"), (204, "\t \n"), (205, " ".join(base))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(make_docs([(i, t, "en", "s") for i, t in rows]), 4, 85).collect()}
    assert got == brute_jaccard(rows, 4, 85)


def test_jaccard_small_cases(make_docs):
    assert jaccard_join.shingle_components(make_docs([])).count() == 0
    rows = [(3, "a b c", "en", "s"), (3, "a b c", "en", "s"), (2, "A B C", None, None), (None, None, "en", "s")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.shingle_components(make_docs(rows)).collect())
    assert got == [("2", 1, 2), ("3", 1, 2), ("3", 1, 2), ("None", 0, None)]


def test_prefixes_lose_no_link():
    """Two linked sets share min(l, m) tokens of their prefixes whatever frequencies steer them."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        x = np.sort(rng.choice(2**62, n, replace=False).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 6) + 1))
        y = np.sort(np.concatenate([x[drop:], rng.choice(2**62, int(rng.integers(0, 3)), replace=False).astype(np.uint64)]))
        same = len(np.intersect1d(x, y))
        if 100 * same < 85 * (len(x) + len(y) - same):
            continue
        table = {int(k): int(v) for k, v in zip(np.union1d(x, y), rng.choice([0, 0, 20, 500, 9000], len(np.union1d(x, y))))}
        (m, p), (k, q) = (jaccard_join.prefix(s, np.array([table[int(v)] for v in s]), 85) for s in (x, y))
        assert len(np.intersect1d(p, q)) >= min(m, k)
        assert jaccard_join.may_link(len(x), jaccard_join.bitmap(x), len(y), jaccard_join.bitmap(y), 85)


def brute_vectors(rows, threshold):
    ok = [(k, np.asarray(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for i, (a, x) in enumerate(ok) for b, y in ok[:i] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]
    ids = [i for i, _ in rows]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    order = {k: (ids[k], k) for k in range(len(rows))}
    found = union(range(len(rows)), links)
    least = {}
    for k in range(len(rows)):
        least[found[k]] = min(least.get(found[k], ids[k]), ids[k])
    return sorted((ids[k], n[k], least[found[k]]) for k in order)


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK_ROWS, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for _ in range(12):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((at, (centre + rng.standard_normal(24) * rng.choice([0, 0.05, 0.2, 0.33])).astype(np.float32).tolist()))
            at += 1
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, rows[0][1]), (906, [2 * x for x in rows[0][1]]), (907, [1.0, 0.0]), (908, [1.0, -0.0]), (905, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'x' as key", "2 as node")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == brute_vectors(rows, 0.95)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_within_bounds():
    rng = np.random.default_rng(9)
    d = 64
    x = rng.standard_normal((400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ embedding_dedup.rotation(d)
    factor = np.abs(y).sum(axis=1) / math.sqrt(d)
    estimate = (np.sign(y) @ y.T) / math.sqrt(d) / factor[:, None]
    off = ~np.eye(400, dtype=bool)
    error = (estimate - x @ x.T)[off]
    slack = (np.sqrt((1 - factor**2) / factor**2 / (d - 1))[:, None] * np.ones((1, 400)))[off]
    assert abs(error.mean()) < 0.005 and (np.abs(error) < embedding_dedup.SIGMAS * slack).all()


@pytest.mark.parametrize("d", [2, 7, 64, 129])
def test_levels_keep_signs_and_bounds(d):
    """The code read back from the levels is that of the rotated vector, and estimates from levels lie within the deviation and what is left."""
    rng = np.random.default_rng(d)
    x = rng.standard_normal((300, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ embedding_dedup.rotation(d)
    codes, step, left = embedding_dedup.quantised(y)
    level = np.stack([codes >> 4, codes & 15], axis=2).reshape(300, -1)[:, :d]
    z = embedding_dedup.unpacked(level, step)
    assert ((z > 0) == (y > 0)).all() and (np.linalg.norm(y - z, axis=1) <= left).all() and (np.abs(y - z) <= 0.51 * step[:, None]).all()
    estimate, near = np.sign(z) @ y.T / math.sqrt(d), np.sign(z) @ z.T / math.sqrt(d)
    assert (np.abs(estimate - near) <= left[None, :] + 1e-5).all()


@pytest.mark.parametrize("bucket", [400, 40, 3])
def test_planted_pairs_are_found(spark, monkeypatch, bucket):
    """Pairs just above the threshold, at 2, 6 and 9 bits a table, with none below it."""
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.standard_normal((800, 64))
    w -= (w * x).sum(axis=1, keepdims=True) * x
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cos = rng.uniform(0.945, 0.955, (800, 1))
    y = cos * x + np.sqrt(1 - cos**2) * w
    assert embedding_dedup.plan(1600, 0.95)[1] == round(math.log2(1600 / bucket))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    exact = (x @ y.T) >= 0.95
    want = {i: i for i in range(1600)} | {800 + int(j): int(i) for i, j in zip(*np.nonzero(exact))}
    assert exact.sum() > 300 and got == want


def test_links_join_in_blocks():
    rng = random.Random(2)
    for n in (1, 5, 60):
        root, links = np.arange(n), []
        for _ in range(4):
            part = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 4)]
            links += part
            root = embedding_dedup.joined(root, *(np.array([p[k] for p in part], np.int64) for k in (0, 1)))
        assert {i: int(r) for i, r in enumerate(root)} == union(range(n), links)
