"""Mixing against its closed form, quotation linking by hand, the pipeline's stages and the registry."""

import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from lexiweave.llm import mixing, quotations


def brute_targets(sizes, weights, factor, passes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, open_ = factor * sum(sizes.values()), {}, set(order)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > passes * sizes[s]} if total else set()
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = passes * sizes[s]
            left -= target[s]
        open_ -= over


def test_mixing(make_docs):
    rows = [(i, "w " * (i * 37 % 91), "en", None if i % 11 == 0 else f"s{min(i % 7, 4)}") for i in range(400)] + [(401, None, "en", "s1"), (402, "", None, "empty"), (5, "w " * 70, "en", "s4"), (None, "a b", "en", "s0")]
    sized = [(i, s, len((t or "").split())) for i, t, _, s in rows]
    docs = make_docs(rows).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"))
    taken, pieces = mixing.mix(docs, [3.0, 1.0, 2.0], 1.5, 2, block=16)
    got = taken.collect()
    per = defaultdict(int)
    for _, s, n in sized:
        per[s] += n
    want = brute_targets(per, [3.0, 1.0, 2.0], 1.5, 2)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for i, _, n in sized)
    found = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == per[r.source] and r.target == pytest.approx(want[r.source])
        found[r.source] += r.taken
    assert all(abs(found[s] - want[s]) <= 1 for s in per)
    parts = pieces.collect()
    assert sum(r.words for r in parts) == sum(found.values())
    slots = defaultdict(set)
    for r in parts:
        slots[r.doc_id].add(r.slot)
    # doc 5 stands twice, as two documents of one id
    assert all((r.first_slot, r.n_slots) == (min(slots[r.doc_id], default=None), len(slots[r.doc_id])) for r in got if r.doc_id not in (5, None))
    assert len({(r.slot, r.source_no) for r in parts}) == len({r.slot for r in parts})
    block = defaultdict(int)
    for r in parts:
        block[r.slot] += r.words
    last = {max(s for s, n in ((r.slot, r.source_no) for r in parts) if n == k) for k in {r.source_no for r in parts}}
    assert all(n == 16 for s, n in block.items() if s not in last) and max(block.values()) <= 16
    again, _ = mixing.mix(docs, [3.0, 1.0, 2.0], 1.5, 2, block=16)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mix_is_spread_evenly(make_docs):
    """Every stretch of the schedule holds the sources in about their shares."""
    docs = make_docs([(i, "w " * 50, "en", f"s{i % 3}") for i in range(300)]).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"))
    _, pieces = mixing.mix(docs, [3.0, 1.0, 2.0], 1.0, 2, block=10)
    slots = sorted((r.slot, r.doc_id % 3) for r in pieces.collect())
    share = Counter(s for _, s in slots)
    for lo in range(0, 1200, 200):
        part = Counter(s for n, s in slots if lo <= n < lo + 200)
        assert all(abs(part[s] / sum(part.values()) - share[s] / sum(share.values())) < 0.06 for s in share)


def test_mixing_nothing(make_docs):
    for rows in ([], [(1, None, "en", "a"), (2, "", None, None)]):
        docs = make_docs(rows).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"))
        taken, pieces = mixing.mix(docs, [3.0, 1.0], 1.5, 2)
        assert [(r.doc_id, r.taken, r.target) for r in taken.orderBy("doc_id").collect()] == [(r[0], 0, 0.0) for r in rows] and pieces.count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "u", "Hello there\nSecond line"), (1, 1, "a", "On Mon X wrote:\n> hello  THERE\n\nMy answer"), (1, 2, "u", "> My answer\n>> hello there\nok then"), (2, 0, "u", "Hello there"),
        (2, 1, "a", "> ok then\nfine"), (2, 2, "u", None), (None, None, None, "> fine"), (2, 1, "a", "> ok then\nfine"), (3, 0, "a", ">"), (3, 1, "a", "> nowhere found"), (4, 0, "u", "same"), (4, 1, "u", "same"), (4, 2, "a", "> same\nyes\r\n> one\n> Two"), (4, 3, "u", "one\ntwo"),
        (5, 0, "u", "one\ntwo\nthree"), (5, 1, "a", "> one\n> two\n> changed\nno"), (5, 2, "a", "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as body")
    got = {(r.conv_id, r.turn): r for r in quotations.reply_order(df).collect()}
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.reply_turn is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 1), (2, 1): (1, 2), (4, 2): (4, 1), (5, 1): (5, 0), (None, None): (2, 1)}
    assert (got[(1, 2)].thread, got[(1, 2)].depth, got[(1, 2)].body, got[(1, 2)].n_linked) == (0, 2, "ok then", 2)
    assert got[(1, 1)].body == "My answer" and got[(2, 2)].body == "" and got[(3, 1)].n_quoted == 1 and got[(3, 0)].n_quoted == 0
    assert quotations.reply_order(df.limit(0)).count() == 0
    assert quotations.reply_order(df).count() == len(rows)


@pytest.mark.parametrize("hot", [64, 1, 0])
def test_most_lines_are_counted(spark, monkeypatch, hot):
    """Against brute force: the message that holds most lines, whatever later or lower ones repeat single lines of it; hot: lines rare, mixed, common."""
    monkeypatch.setattr(quotations, "HOT_LINE", hot)
    rows = [(1, 0, "u", "Hello\nThe meeting is at ten\nBring the papers"), (1, 1, "a", "Hello\nok"), (1, 2, "u", "> Hello\n> The meeting is at ten\n> Bring your papers\nyes")]
    rows += [(2, 0, "u", "> far one\nand more"), (2, 1, "u", "far one\nfar two\nand so on"), (0, 5, "a", "far two\nelse"), (3, 0, "u", "> far one\n> far two\n> far three"), (4, 0, "u", "in two places"), (4, 1, "u", "what else"), (5, 7, "u", "in two places"), (4, 2, "u", "said\nin two places"), (4, -1, "u", "> in two places")]
    rng = __import__("random").Random(5)
    words = ["Hi", "Bye", *(f"line {i}" for i in range(6))]
    for k in range(60):
        own = "\n".join(rng.choices(words, [6, 6, 1, 1, 1, 1, 1, 1], k=rng.randint(1, 4)))
        quote = "\n".join(f"> {x}" for x in rng.choices([*words, f"no {k}"], k=rng.randint(2, 5)))
        rows.append((10 + k % 7, k // 7, "u", f"own {k}\n{own}" if k % 3 else f"{quote}\n\nanswer {k}"))
    plain = lambda text: [x.lower() for x in text.split("\n") if x and not x.startswith(">")]
    want = {}
    for c, t, _, text in rows:
        quote = [x[2:].lower() for x in text.split("\n") if x.startswith(">")]
        found = []
        for c2, t2, _, other in rows:
            lines, votes = plain(other), 0
            if not quote or c2 == c and t2 >= t:
                continue
            votes = sum(x in lines for x in quote)
            exact = " ".join(quote) in (" ".join(lines), *lines, *(" ".join(plain(p)) for p in other.split("\n\n")))
            if exact or 2 * votes > len(quote):
                found.append((exact, c2 == c, 0 if exact else votes, -c2, t2 if c2 == c else -t2, (c2, t2)))
        want[c, t] = max(found)[-1] if found else (None, None)
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotations.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want
    assert got[1, 2] == (1, 0) and got[3, 0] == (2, 1) and got[4, -1] == (5, 7)


def test_pipeline_stages(spark, make_docs):
    rng = __import__("random").Random(8)
    word = lambda: "".join(rng.choices("etaoinshr", k=5))
    rows = [(i, " ".join(word() for _ in range(60)), "en" if i % 5 else None, f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[3][1].upper(), "en", "s0"), (101, rows[4][1] + " tail", "en", "s0"), (102, "12 34", "en", "s0"), (103, None, "en", "s0"), (3, rows[3][1], "en", "s0")]
    docs, kept = make_docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "pack_sequences":
            assert out.columns == docs.columns
        kept[name] = Counter(r.doc_id for r in out.select("doc_id").collect())
        docs = corpus_pipeline.written(out, "test-stage")
    assert set(kept["language_id"]) == {r[0] for r in rows} - {102, 103}
    assert set(kept["exact_dedup"]) == set(kept["language_id"]) - {3} and max(kept["exact_dedup"].values()) == 1
    assert set(kept["jaccard_join"]) == set(kept["exact_dedup"]) - {101}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total, mixed = sum(size[i] for i in kept["jaccard_join"]), sum(size[i] * n for i, n in kept["mix_sources"].items())
    assert mixed == pytest.approx(1.5 * total, rel=0.05) and max(kept["mix_sources"].values()) <= 2
    assert set(kept["pack_sequences"]) == set(kept["mix_sources"])


INNER = ["_id", "_sha", "_rows", "_copies", "_copy", "_language", "_posterior", "language", "posterior", "id", "key", "one", "other", "known", "slot", "size", "kept", "cls", "bucket", "component_id", "text_sha256", "_NORM", "lang_pred", "score", "rows", "n"]


def test_extra_columns_with_inner_names(spark):
    """A column of every name that a stage uses inside passes all stages with its values."""
    rows = [(i, f"the {'abcdefghij'[i]} and of words that stand here and there " * (i + 1), "en", "s1") for i in range(10)] + [(None, "words without an id", None, None), (11, "the a and of words that stand here and there ", "en", "s2")]
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in INNER)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in INNER))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", *INNER]
        docs = corpus_pipeline.written(docs, "test-names")
        got = docs.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in INNER)
        left[name] = Counter(r.doc_id for r in got)
    assert left["exact_dedup"] == Counter([*range(1, 10), None, 11])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_pipeline_of_nothing(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_mix_comes_in_schedule_order(spark, make_docs):
    docs = make_docs([(i, "w " * (40 + i % 7), "en", f"s{i % 3}") for i in range(200)])
    taken, _ = mixing.mix(docs.select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size")), corpus_pipeline.WEIGHTS, corpus_pipeline.FACTOR, corpus_pipeline.PASSES)
    want = sorted((s, str(r.doc_id)) for r in taken.collect() for s in (r.pass_slots or [])[: int(r.taken / r["size"] + 0.5)])
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert got == [int(i) for _, i in want] and max(Counter(got).values()) == 2


def test_registry():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert set(sql) <= set(names)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_mix_sources"])
def test_query_matches_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = __spark_entry__.queries()[name](spark, data)
    r = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(map(str, (tuple(x[c] for c in cols) for x in df.collect()))) == sorted(map(str, r.fetchall()))
