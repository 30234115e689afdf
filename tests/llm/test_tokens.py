"""Encoding, packing, token files and section counts against the tokenizers library."""

import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexiweave.llm import encoding, packing, token_counts, token_files
from lexiweave.llm.shared import new_folder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [(None, None), (50, ""), (56, "x\n\n"), (51, " "), (52, "a\n\nb"), (53, "Tab\tand  two \n spaces "), (54, "é" * 3000), (55, "word " * 3000), (3, "repeat"), (3, "repeat"), (-4, "İstanbul ﬁ ́x"), (57, "a <|endoftext|> b<|startoftext|>c")]


def whole(path, text, end):
    t = Tokenizer.from_file(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_segments_give_the_same_ids(texts, path, monkeypatch):
    rng = random.Random(2)
    white = [*" \n", *encoding.RARE_ASCII, *encoding.RARE_WIDE, *encoding.SEPARATORS]
    letters = ["a", "B", "th", "'s", "é", "Ü", "1", "23", ".", ",", "̈", "!?", "<|endoftext|>", "日", "​", "İ", "Σ", "\x00", "🙂", "'", *white, *" " * 10]
    fuzz = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" + c + d + "b" for c in white for d in [*white, ""]] + [None]
    enc = encoding.Encoder(path)
    t = enc.tokenizer
    want = [e.ids for e in t.encode_batch([x or "" for x in fuzz], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(fuzz)] == want
    long = [" ".join(x for x in fuzz if x)[:20_000], *list(texts.values())[:30]]
    want = [e.ids for e in t.encode_batch(long, add_special_tokens=False)]
    for chars, keep in ((100, 500_000), (300_000, 50)):
        monkeypatch.setattr(encoding, "CHARS", chars)
        monkeypatch.setattr(encoding, "KEEP", keep)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoding.Encoder(path).encode(long)] == want


HELD = """
import ctypes, random, re, public_tokenizers, pyarrow as pa
from lexiweave.llm import encoding
rng = random.Random(5)
texts = pa.array([" ".join("".join(rng.choices("abcdefgh", k=7)) + "1" for _ in range(2000)) for _ in range(600)])
def held():
    return sum(map(int, re.findall("Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
enc = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = held()
print(max(held() for _ in enc.encode_column(texts)) - before)
"""


def test_a_worker_holds_little_besides_its_table():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert float(out.stdout) < 100  # MB, over 10 MB of words that hardly repeat


def test_binary_lengths():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        got = packing.binary_lengths(n)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 1024 for x in got)
        assert len([x for x in got if x < 1024]) == len({x for x in got if x < 1024})


def test_packing(make_docs, texts):
    rows = [(i, t, "en", "s") for i, t in [*list(texts.items())[60:90], *ODD]]
    got = packing.pack(make_docs(rows), BYTE, 0, 1024, with_ids=True).collect()
    ids = {(i, t): whole(BYTE, t, 0) for i, t, *_ in rows}
    by_doc = {}
    for r in got:
        assert r.offset == 0 and r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault((r.doc_id, r.start), []).append(r)
    assert len({r.sequence_id for r in got}) == len(got)
    assert sum(r.length for r in got) == sum(len(whole(BYTE, t, 0)) for _, t, *_ in rows)
    for (i, t), want in ids.items():
        at = 0
        while at < len(want):
            r = by_doc[(i, at)][0]
            assert r.doc_tokens == len(want) and r.ids == want[at : at + r.length].tolist()
            at += r.length
    assert len(by_doc[(3, 0)]) == 2
    assert packing.pack(make_docs([]), BYTE).count() == 0


def test_token_files(spark, make_docs, texts):
    rows = [(i, t, "en", "s") for i, t in [*list(texts.items())[100:150], *ODD]]
    folder = new_folder(spark, "test-files")
    manifest = token_files.write_files(make_docs(rows), WORD, folder, end_id=1, length=16)
    got = token_files.read_digests(manifest).orderBy("start").collect()
    at = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        want = whole(WORD, t, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    one = manifest.first()
    shard = token_files.ShardReader(one.tokens_path, one.index_path)
    flat = np.concatenate([shard.sequence(i)[shard.mask(i)] for i in range(shard.n_sequences())])
    assert len(flat) == one.n_tokens and all(len(shard.sequence(i)) == 16 for i in range(shard.n_sequences()))
    assert flat.tolist() == np.concatenate([p for *_, parts in shard.documents() for p in parts]).tolist()
    assert pa.types.is_fixed_size_list(shard.tokens.schema.field("tokens").type) and flat.dtype == np.uint16
    assert token_files.token_digests(make_docs([]), WORD).count() == 0


def test_section_counts(make_docs, texts):
    rows = [(i, t, "en", "s") for i, t in [*list(texts.items())[:40], *ODD]]
    got = token_counts.section_tokens(make_docs(rows), BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, text, *_ in rows:
        text = text or ""
        bounds, at = [0], 0
        for line in text.split("\n"):
            at += len((line + "\n").encode())
            bounds.append(min(at, len(text.encode())))
        if len(bounds) > 2 and bounds[-1] == bounds[-2]:
            bounds.pop()
        counts, crossing = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1)
        at = 0
        for piece in t.encode(text, add_special_tokens=False).tokens:
            lo, hi, at = at, at + len(piece), at + len(piece)
            share = [max(0, min(hi, b) - max(lo, a)) for a, b in zip(bounds, bounds[1:])]
            best = share.index(max(share))
            counts[best] += 1
            crossing[best] += sum(x > 0 for x in share) > 1
        want += [(i, k, bounds[k], bounds[k + 1], counts[k], crossing[k]) for k in range(len(counts))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r.n_crossing for r in got)


def test_field_counts(spark):
    rows = [(1, "A title", "some body text", None), (2, "", None, "x"), (3, "ab", "cd", "ef"), (None, "é", "ü <|endoftext|>", "")]
    df = spark.createDataFrame(rows, "doc_id long, title string, `the body` string, field string")
    got = {(r.doc_id, r.field): r for r in token_counts.field_tokens(df, ["title", "the body", "field"], BYTE, " ").collect()}
    assert len(got) == 12
    for i, *fields in rows:
        fields = [x or "" for x in fields]
        mine = [got[i, c] for c in ("title", "the body", "field")]
        assert sum(r.n_tokens for r in mine) == len(Tokenizer.from_file(BYTE).encode(" ".join(fields), add_special_tokens=False).ids)
        at = [0, len((fields[0] + " ").encode()), len(" ".join(fields[:2] + [""]).encode()), len(" ".join(fields).encode())]
        assert [(r.byte_start, r.byte_end) for r in mine] == list(zip(at, at[1:]))
    # " body" goes with what holds most of it, though its space ends the title
    assert (got[1, "title"].n_tokens, got[1, "the body"].n_tokens, got[1, "the body"].n_crossing) == (2, 4, 1)


def test_tie_goes_to_the_earlier_section():
    section, crosses = token_counts.attribute(np.array([0, 2, 6]), np.array([2, 6, 9]), np.array([0, 4, 9]))
    assert section.tolist() == [0, 0, 1] and crosses.tolist() == [False, True, False]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_tokens_as_the_library_has_them(path):
    """Texts that hold special tokens literally, against an untouched tokenizer."""
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a", "the", ".", "é", " ", "  ", "\n", "\t", "1", "'s"]
    fuzz = ["<|endoftext|>", "a <|endoftext|> b", *("".join(rng.choices(parts, k=rng.randint(1, 20))) for _ in range(2000))]
    want = [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in fuzz[:2]]
    t = Tokenizer.from_file(path)
    want += [e.ids for e in t.encode_batch(fuzz[2:], add_special_tokens=False)]
    assert len(want[0]) == 1
    assert [np.frombuffer(x, "<u4").tolist() for x in encoding.Encoder(path).encode(fuzz)] == want
