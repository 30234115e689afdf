"""Licence scan: a trained paragraph classifier with a calibrated unknown class and template confirmation.

Fit (on the driver, bounded): paragraphs made from the templates below by seeded edits, and paragraphs of about ``SAMPLE_DOCS``
documents as prose (those that share most of a template are left out). Features are hashed word 1- to 3-grams; a
multinomial logistic regression with a prose class is fitted by gradient descent. A temperature and the probability from which a paragraph
is no prose are set on edits and prose kept apart from the fit; the one under which it is ``unknown`` on notices of no family.
Score: every paragraph (line) of every whole text, and every window of consecutive lines up to the next line without words that a
template wrapped over lines can fill; hashed n-grams gather rows of the weight matrix and are summed by line and line break in numpy, windows
add up their lines. The matrix (2^15 x classes) is broadcast and does not grow with the corpus.
Confirm: the likeliest licence class of a paragraph that is not prose is its family. It is held against that family's templates by the share
of a template's word pairs that the paragraph holds; a family counts as confirmed from ``CONFIRM`` on, and a better match of another family's
template corrects it. Without a template the family stands, unconfirmed, from a probability on that is set on notices of no family.
A window is reported only where no better paragraph or window on the same lines says the same.

Cases: a null or empty text has no paragraphs and no licence; ties go to the first family by name; repeated rows get equal answers; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, tidy
from .shingles import _hash_words, mix

SAMPLE_DOCS = 400
BUCKET_BITS = 15
#: Bounds of the fit's sample: characters and lines of a document, its lines that are learned as prose and that stand in one run, and
#: paragraphs and words from which fillers are drawn.
SAMPLE_CHARS = 50_000
SAMPLE_LINES = 200
SAMPLE_PROSE = 20
SAMPLE_RUN = 40
FILLER_PARAGRAPHS = 500
FILLER_WORDS = 2000
#: Share of a template's word pairs that confirms it, and of prose paragraphs that calibration lets pass as licences.
CONFIRM = 0.6
FALSE_RATE = 0.001
#: Share of notices of no family that calibration lets pass as one.
STRANGER_RATE = 0.05
SCORE_BYTES = 1 << 17

# Names and notices by which public licences are declared.
TEMPLATES = {
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL version 3 or later.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GNU GPL version 2."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this document may be reproduced without prior written permission.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
PROSE = "prose"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # PROSE last
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    wide: float  # `least` of a window of lines
    known: float  # probability from which a family stands without its templates


def features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first line, last line of each n-gram over at most three lines, words of each line, byte starts of the lines) of a text."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    words, at = _hash_words(data.translate(_FOLD))
    line = np.searchsorted(breaks, at)
    found, first, last, h = [], [], [], np.zeros(len(words), np.uint64)
    for n in range(3):
        h = h[: len(words) - n] * np.uint64(0x9E3779B97F4A7C15) + words[n:]
        near = line[n:] - line[: len(words) - n] <= 2
        found.append((mix(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[near])
        first.append(line[: len(words) - n][near])
        last.append(line[n:][near])
    return np.concatenate(found), np.concatenate(first), np.concatenate(last), np.bincount(line, minlength=len(breaks) + 1), np.concatenate([[0], breaks + 1])


def word_pairs(text: str) -> set[tuple[str, ...]]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return set(zip(w, w[1:])) or {tuple(w)}


PAIRS = [(family, word_pairs(t)) for family, ts in TEMPLATES.items() for t in ts]
#: Words of the longest template: a notice that starts in a line ends within so many words after that line.
LONGEST = max(len(re.findall(r"[a-z0-9]+", t.lower())) for ts in TEMPLATES.values() for t in ts)


def shares(text: str) -> dict[str, tuple[float, int]]:
    """For each family (share of a template's word pairs in text, the template's pairs) of its best match; of equal ones the longest template's."""
    own = word_pairs(text)
    found: dict[str, tuple[float, int]] = {}
    for family, p in PAIRS:
        found[family] = max(found.get(family, (0.0, 0)), (len(p & own) / len(p), len(p)))
    return found


def best_template(text: str) -> tuple[str, float]:
    """(family, share of its template's word pairs in text) of the best match over all families."""
    found = shares(text)
    family = min(found, key=lambda f: (-found[f][0], -found[f][1], f))
    return family, found[family][0]


def judge(model: Classifier, text: str, p: np.ndarray) -> tuple[bool, str, float, float]:
    """(confirmed, family, probability, share) of a licence-like paragraph with class probabilities p.

    The family is the classifier's likeliest one. Its templates confirm it from CONFIRM on, a better match of another family's from CONFIRM
    on corrects it; without either it stands from model.known on and is `unknown` below. The probability is the family's own, or
    for `unknown` that of all families."""
    found = shares(text)
    top, (share, _) = max(found.items(), key=lambda x: (x[1], p[model.families.index(x[0])]))
    k = int(np.argmax(p[:-1]))
    named = model.families[k]
    if share >= CONFIRM:
        named = named if found[named] == found[top] else top
        return True, named, float(p[model.families.index(named)]), share
    if p[k] >= model.known:
        return False, named, float(p[k]), found[named][0]
    return False, "unknown", float(1 - p[-1]), share


def edits(rng: np.random.Generator, fillers: list[str], each: int) -> tuple[list[str], list[str]]:
    """Seeded variants of every template: words dropped, swapped for fillers or set beside them, case and marks changed."""
    texts, labels = [], []
    for family, templates in TEMPLATES.items():
        for t in templates:
            for _ in range(each):
                w = [x for x in t.split() if rng.random() > 0.04]
                if rng.random() < 0.5:
                    w = [*rng.choice(fillers, rng.integers(0, 6)), *w, *rng.choice(fillers, rng.integers(0, 6))]
                s = " ".join(w)
                texts.append(s.upper() if rng.random() < 0.1 else s.lower() if rng.random() < 0.1 else s)
                labels.append(family)
    return texts, labels


def strangers(rng: np.random.Generator, fillers: list[str], each: int) -> list[str]:
    """Seeded notices of no family: templates in which fillers stand for words, and for second words of pairs, that one family alone has."""
    holders: dict[tuple[str, ...], set[str]] = {}
    spelt = {t: [" ".join(re.findall(r"[a-z0-9]+", x.lower())) for x in t.split()] for ts in TEMPLATES.values() for t in ts}
    for family, ts in TEMPLATES.items():
        for t in ts:
            for a, b in zip([None, *spelt[t]], spelt[t]):
                holders.setdefault((b,), set()).add(family)
                holders.setdefault((a, b), set()).add(family)
    texts = []
    for t, words in spelt.items():
        kept, before = [], None
        for shown, w in zip(t.split(), words):
            before = w if len(holders[w,]) > 1 and (before is None or len(holders.get((before, w), ())) > 1) else None
            kept.append(before and shown)
        if None in kept and any(kept):
            texts += [" ".join(x or str(rng.choice(fillers)) for x in kept) for _ in range(each)]
    return texts


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Classifier:
    rng = np.random.default_rng(20240607)
    n = docs.select("doc_id").count()
    rows = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("licence-fit")), F.lit(1 << 30)) < int(min(1, sample / max(1, n)) * (1 << 30)))
    prose, runs = [], []
    for (text,) in rows.select(F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS)).toLocalIterator():
        lines = (text or "").split("\n")[:SAMPLE_LINES]
        prose += [x for x in lines if x.strip() and best_template(x)[1] < 0.5][:SAMPLE_PROSE]
        if best_template(" ".join(lines))[1] < 0.5:
            runs.append("\n".join(lines[:SAMPLE_RUN]).encode("utf-8", "surrogatepass"))
    prose = prose or ["no words of any licence stand here"]
    fillers = sorted({w for x in prose[:FILLER_PARAGRAPHS] for w in x.split()})[:FILLER_WORDS]
    texts, labels = edits(rng, fillers, 40)
    families = (*sorted(TEMPLATES), PROSE)
    texts, labels = texts + prose, labels + [PROSE] * len(prose)
    y = np.array([families.index(x) for x in labels])
    held = rng.random(len(texts)) < 0.25
    bag = [np.unique(features(t.replace("\n", " ").encode())[0]) for t in texts]
    row, col = np.repeat(np.arange(len(bag)), [len(b) for b in bag]), np.concatenate(bag)
    scale = 1 / np.sqrt(np.maximum(1, [len(b) for b in bag]))
    live, inverse = np.unique(col, return_inverse=True)
    w, b = np.zeros((len(live), len(families))), np.zeros(len(families))
    share = np.bincount(y[~held], minlength=len(families))
    weight = np.where(held, 0, 1 / share[y].clip(1)) / len(families)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bag])[:-1]])
    empty = np.array([not len(x) for x in bag])

    def logits():
        z = np.add.reduceat(np.vstack([w[inverse], np.zeros((1, w.shape[1]))]), starts, axis=0) if len(bag) else np.zeros((0, len(families)))
        z[empty] = 0
        return z * scale[:, None] + b

    truth = np.eye(len(families))[y]
    order = np.argsort(inverse, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(inverse))[:-1]])
    for _ in range(60):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - truth) * weight[:, None]
        w -= 60 * (np.add.reduceat((g * scale[:, None])[row[order]], cuts, axis=0) + 1e-5 * w)
        b -= 2 * g.sum(axis=0)
    z = logits()[held]
    losses = []
    for temperature in (0.25, 0.5, 1.0, 2.0):
        s = z / temperature
        s -= s.max(axis=1, keepdims=True)
        losses.append((float(-(s - np.log(np.exp(s).sum(axis=1, keepdims=True)))[np.arange(len(z)), y[held]].mean()), temperature))
    temperature = min(losses)[1]
    p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    licence = 1 - (p / p.sum(axis=1, keepdims=True))[:, -1]
    of_prose = np.sort(licence[y[held] == len(families) - 1])
    least = float(max(0.5, of_prose[int((1 - FALSE_RATE) * (len(of_prose) - 1))])) if len(of_prose) else 0.5
    full = np.zeros((1 << BUCKET_BITS, len(families)), np.float32)
    full[live] = w
    model = Classifier(families, full, b.astype(np.float32), temperature, least, least, 1.0)
    # the prose that no sample holds: the windows over the lines of sampled texts
    seen = [(1 - p[last > first, -1]) for first, last, p, _ in (score(model, x) for x in runs)]
    of_runs = np.sort(np.concatenate([np.zeros(1), *seen]))
    p = np.concatenate([score(model, x.encode("utf-8", "surrogatepass"))[2][:1] for x in strangers(rng, fillers, 8)])
    of_strangers = np.sort(np.concatenate([np.zeros(1), p[1 - p[:, -1] >= least, :-1].max(axis=1)]))
    known = float(max(0.5, of_strangers[int((1 - STRANGER_RATE) * (len(of_strangers) - 1))]))
    return dataclasses.replace(model, wide=float(max(least, of_runs[int((1 - FALSE_RATE) * (len(of_runs) - 1))])), known=known)


def _softmax(model: Classifier, z: np.ndarray, n: np.ndarray) -> np.ndarray:
    z = (z / np.sqrt(np.maximum(1, n))[:, None] + model.bias) / model.temperature
    z[n == 0, :-1] = -np.inf
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def score(model: Classifier, data: bytes, walls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, class probabilities of each paragraph and window, byte starts of the lines).

    The paragraphs (lines) come first, then the windows: two lines or more that follow each other, all with words, none but the first
    at a wall (byte where a text starts). A window ends where every template that starts in its first line has ended, at the latest.
    As in the fit, an n-gram counts once a line; one over a line break counts once a break."""
    bucket, first, last, words, starts = features(data)
    lines, width = len(starts), len(model.families)
    once = np.unique((last * 3 + last - first) << BUCKET_BITS | bucket)
    bucket, group = once & ((1 << BUCKET_BITS) - 1), once >> BUCKET_BITS
    n = np.bincount(group, minlength=3 * lines)
    z = np.zeros((3 * lines, width), np.float32)
    if len(bucket):
        z[n > 0] = np.add.reduceat(model.weights[bucket], np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0], axis=0)
    z, n = z.reshape(lines, 3, width), n.reshape(lines, 3)
    shut = words == 0
    if walls is not None:
        shut = shut.copy()
        shut[np.searchsorted(starts, walls)] = True
    at = np.flatnonzero(words > 0)
    total, count, after = z[at, 0], n[at, 0], np.zeros(len(at), np.int64)
    found = [(np.arange(lines), np.arange(lines), _softmax(model, z[:, 0], n[:, 0]))]
    more = 1
    while len(at):
        end = at + more
        on = (end < lines) & (after < LONGEST - 1)
        on[on] = ~shut[end[on]]
        at, end, total, count, after = at[on], end[on], total[on], count[on], after[on] + words[end[on]]
        for k in range(min(more, 2) + 1):  # n-grams that end in the new line and start in it, one or two lines before
            total, count = total + z[end, k], count + n[end, k]
        if len(at):
            found.append((at, end, _softmax(model, total, count)))
        more += 1
    return *map(np.concatenate, zip(*found)), starts


def distinct(found: list[tuple]) -> list[tuple]:
    """found(confirmed, family, probability, share, first, last line, ...) without those that say again what a better one says: confirmed
    ones go first, then named ones, greater shares, fewer lines, probability. A confirmed one falls to one of its family, another to any, on the same lines."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (not x[0], x[1] == "unknown", -x[3], x[5] - x[4], -x[2], x[4])):
        if not any(x[4] <= y[5] and y[4] <= x[5] and (not x[0] or x[1] == y[1]) for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[4], x[5], x[1]))


def _narrowed(lines: list[str], family: str) -> tuple[int, int]:
    """(lines off the start, lines off the end) that a window loses without holding less of its family's template."""
    held = lambda lo, hi: shares(" ".join(lines[lo:hi]))[family]
    lo, hi = 0, len(lines)
    whole = held(lo, hi)
    while hi - lo > 1 and held(lo, hi - 1) == whole:
        hi -= 1
    while hi - lo > 1 and held(lo + 1, hi) == whole:
        lo += 1
    return lo, len(lines) - hi


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_paragraphs, family, probability, similarity, confirmed, byte_start, found.

    family is that of the document's best licence paragraph (confirmed ones first, then named ones, grants before `proprietary`, then by
    probability): a family, `unknown` where none is named, or null without any; probability is the family's own; found lists all as JSON [[family, probability, similarity, byte_start], ...]."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches):
        m = shared.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out = []
            ids, texts = batch.column(0).to_pylist(), [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < SCORE_BYTES):
                    size += len(texts[end]) + 1
                    end += 1
                edges = np.cumsum([0, *[len(t) + 1 for t in texts[at:end]]])
                first, last, p, starts = score(m, b"\n".join(texts[at:end]), edges[:-1])
                cuts = np.searchsorted(starts, edges)
                # the rest of the mass against prose decides; the family is the classifier's, confirmed or corrected by the words
                likely = np.flatnonzero(1 - p[:, -1] >= np.where(last > first, m.wide, m.least))
                likely = likely[np.argsort(first[likely], kind="stable")]
                bounds = np.searchsorted(first[likely], cuts)
                for k in range(at, end):
                    text, off = texts[k], edges[k - at]
                    got = []
                    for i in likely[bounds[k - at] : bounds[k - at + 1]]:
                        a, b = int(first[i]), int(last[i])
                        stop = int(starts[b + 1] - off - 1) if b + 1 < len(starts) else len(text)
                        own = text[int(starts[a] - off) : stop].decode("utf-8", "surrogatepass").split("\n")
                        sure, family, chance, share = judge(m, " ".join(own), p[i])
                        if b > a and sure:
                            lo, hi = _narrowed(own, family)
                            a, b = a + lo, b - hi
                        got.append((sure, family, chance, share, a, b, int(starts[a] - off)))
                    got = distinct(got)
                    # a grant says more than the reservation of rights above it
                    best = max(got, key=lambda x: (x[0], x[1] != "unknown", x[1] != "proprietary", x[2], -x[6]), default=(False, None, None, None, 0, 0, None))
                    out.append((ids[k], int(cuts[k - at + 1] - cuts[k - at]) if text else 0, best[1], best[2], best[3], best[0], best[6], json.dumps([[f, round(q, 6), round(s, 6), b] for _, f, q, s, _, _, b in got])))
                at = end
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.string()]
            names = ["doc_id", "n_paragraphs", "family", "probability", "similarity", "confirmed", "byte_start", "found"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(find), "doc_id long, n_paragraphs long, family string, probability double, similarity double, confirmed boolean, byte_start long, found string")
