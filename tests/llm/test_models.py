"""Language ID and licence scan: held-out accuracy, calibration, edge cases."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexiweave.llm import language, licenses

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_held_out(spark, documents):
    model = language.fit(documents)
    got = {r.doc_id: r for r in language.identify(language.with_fold(documents), model).collect()}
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    held = [(i, x) for i, x in zip(t["doc_id"], t["lang"]) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    right = [got[i].lang_pred == x for i, x in held if x]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_cases(make_docs):
    rows = [(i, t, lang, None) for i in range(0, 40, 2) for t, lang in (("der die das und", "de"), ("the and of with", "en"))]
    docs = make_docs(rows)
    model = language.fit(docs)
    odd = make_docs([(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !!", "en", "s"), (4, "the", None, None), (5, "the and of " * 200_000, "de", "s"), (None, "und die", None, None), (4, "the", None, None)])
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0.5, r["size"]) for r in language.identify(odd, model).collect())
    assert got == [("1", "und", False, -1), ("2", "und", False, -1), ("3", "und", False, -1), ("4", "en", True, -1), ("4", "en", True, -1), ("5", "en", True, -1), ("None", "de", True, -1)]
    nothing = language.fit(make_docs([(1, "text", None, "s")]))
    assert [r.lang_pred for r in language.identify(make_docs([(1, "text", "en", "s")]), nothing).collect()] == ["und"]


def spelled(text):
    """The n-grams of a text, one by one: words between single marks, with a mark in front and one after the last word if anything follows it."""
    text = text.lower()
    marked = "".join(c if c.isalpha() else " " for c in text)
    if not marked.strip():
        return []
    end = " " if marked[-1] == " " else ""
    marked = " " + " ".join(marked.split()) + end
    found = []
    for n in language.ORDERS:
        for i in range(len(marked) - n + 1):
            h = 0
            for k, c in enumerate(marked[i : i + n]):
                h = ((h * 0x9E3779B1) ^ (ord(c) * 0x85EBCA6B + k + 1)) & 0xFFFFFFFF
            found.append((((h ^ (h >> 15)) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - language.BUCKET_BITS))
    return sorted(found)


@pytest.mark.parametrize("window", [400_000, 97, 7, 1])
def test_every_ngram_counts_once(monkeypatch, window):
    monkeypatch.setattr(language, "WINDOW", window)
    for text in ("the quick über fox, and so on -- " * 9, " .. ", "", "a", "İx 1 Σας", "word", "x  y", "日本 語。"):
        parts = list(language.gram_windows(text))
        assert sorted(x for h, _ in parts for x in h.tolist()) == spelled(text)
        assert sum(n for _, n in parts) == sum(c.isalpha() for c in text.lower())


def test_language_scores_by_hand(make_docs):
    """The whole model and score against naive Bayes written out over dictionaries."""
    rng = __import__("random").Random(3)
    rows = [(i, " ".join(rng.choices(w, k=rng.randint(1, 12))), lang, None) for i in range(60) for lang, w in [(("en", ["the", "and", "of", "with"]), ("de", ["der", "und", "mit", "von"]), (None, ["xx"]))[i % 3]]]
    docs = make_docs(rows)
    counts, n_docs = {}, {}
    for i, t, lang, _ in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            n_docs[lang] = n_docs.get(lang, 0) + 1
            for h in spelled(t):
                counts.setdefault(lang, {}).setdefault(h, 0)
                counts[lang][h] += 1
    size = 1 << language.BUCKET_BITS
    for r in language.identify(docs, language.fit(docs)).collect():
        grams, at = spelled(r.text), {}
        for lang in counts:
            total = sum(counts[lang].values()) + language.SMOOTH * size
            seen = sum(np.log((counts[lang].get(h, 0) + language.SMOOTH) / total) for h in grams)
            at[lang] = seen * min(1, language.EVIDENCE / len(grams)) + np.log(n_docs[lang] / sum(n_docs.values()))
        best = max(sorted(at), key=at.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(at[x] - at[best]) for x in at), rel=1e-3)


@pytest.fixture(scope="module")
def classifier(documents):
    return licenses.fit(documents)


def test_licence_families(make_docs, classifier):
    rows, want = [], {}
    for k, (family, templates) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((k, f"Some words before it stand here.\n{templates[0]}\nand more words after it.", "en", "s"))
        want[k] = family
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows), classifier).collect()}
    assert {k: r.family for k, r in got.items()} == want and all(r.confirmed and r.n_paragraphs == 3 and r.byte_start == 33 for r in got.values())


def test_licence_unknown_and_clean(make_docs, classifier):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "The weather was fine and they went to the sea.", "en", "s"), (4, "Licensed under the terms of a License that nobody knows of.", None, None), (None, "Released under the MIT License.", "en", "s"), (5, "teteber " * 50_000, "en", "s"), (6, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "en", "s")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows), classifier).collect()}
    assert [got[i].family for i in (1, 2, 3, 5)] == [None] * 4 and got[1].n_paragraphs == 0
    assert got[4].family in (None, "unknown") and not got[4].confirmed
    assert got[None].family == "MIT" and got[6].found.count("[") == 3


def test_licences_of_documents(documents, classifier):
    lines = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL", "CC BY-NC": "CC-BY-NC"}
    for r in licenses.scan(documents, classifier).join(documents.select("doc_id", "text"), "doc_id").collect():
        stated = {f for k, f in lines.items() if k in (r.text or "")}
        assert (r.family in stated) if stated else r.family in (None, "proprietary"), (r.doc_id, r.family)


WRAPPED = {
    "GPL": "Copyright (C) 2020 Some Body\n\n This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or\n (at your option) any later version.\n\nint main",
    "LGPL": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n *",
    "BSD": "Copyright (c) 2020, Some Body\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.",
    "ISC": "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in all copies.",
    "MIT": "It was fine.\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy\nof this software and associated documentation files (the \"Software\"), to\ndeal in the Software without restriction.",
}


def test_wrapped_notices(make_docs, classifier):
    """Notices over several lines, among other texts of their batch."""
    order = sorted(WRAPPED)
    rows = [(2 * k, WRAPPED[f], "en", "s") for k, f in enumerate(order)] + [(2 * k + 1, "The weather was fine\nand they went to the sea.", "en", "s") for k in range(len(order))]
    got = {r.doc_id: r for r in licenses.scan(make_docs(sorted(rows)), classifier).collect()}
    assert {f: (got[2 * k].family, got[2 * k].confirmed) for k, f in enumerate(order)} == {f: (f, True) for f in order}
    assert all(got[2 * k + 1].family is None for k in range(len(order)))
    assert {f: got[2 * k].byte_start for k, f in enumerate(order)} == {f: WRAPPED[f].index(s) for f, s in {"GPL": " This program", "LGPL": " * This", "BSD": "Redistribution and", "ISC": "# Perm", "MIT": "Permission"}.items()}


def test_windows_end_at_texts(make_docs, classifier):
    """A notice whose halves stand in two texts, or on both sides of a blank line, is none."""
    a, b = "Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"
    got = licenses.scan(make_docs([(1, a, "en", "s"), (2, b, "en", "s"), (3, f"{a}\n\n{b}", "en", "s")]).coalesce(1), classifier).collect()
    assert not any(r.confirmed for r in got)


def test_family_is_the_classifiers(make_docs, classifier):
    """Licence lines in other words keep the family that the classifier gives them, unconfirmed, with that family's probability."""
    said = {1: ("Distributed under the terms of the GNU GPL v3", "GPL"), 2: ("License: MIT", "MIT"), 3: ("Released under the MIT License.", "MIT")}
    got = {r.doc_id: r for r in licenses.scan(make_docs([(k, t, "en", "s") for k, (t, _) in said.items()]), classifier).collect()}
    assert {k: r.family for k, r in got.items()} == {k: f for k, (_, f) in said.items()}
    assert {k: r.confirmed for k, r in got.items()} == {1: False, 2: False, 3: True}
    for k, (t, f) in said.items():
        assert got[k].probability == pytest.approx(licenses.score(classifier, t.encode())[2][0, classifier.families.index(f)], abs=1e-6)


def test_template_corrects(classifier):
    p = np.full(len(classifier.families), 0.001)
    p[classifier.families.index("LGPL")] = 0.9
    assert licenses.judge(classifier, "Released under the MIT License.", p) == (True, "MIT", 0.001, 1.0)
    assert licenses.judge(classifier, "Released under the GNU LGPL version 3.", p) == (True, "LGPL", 0.9, 1.0)
    p[classifier.families.index("LGPL")] = classifier.known
    assert licenses.judge(classifier, "some other words", p)[:2] == (False, "LGPL")
    p[classifier.families.index("LGPL")] = classifier.known - 0.01
    assert licenses.judge(classifier, "some other words", p)[:2] == (False, "unknown")
