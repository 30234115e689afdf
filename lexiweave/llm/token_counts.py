"""Token counts of sections from one encoding of the whole document.

A whole text is encoded once; a byte-level tokenizer loses nothing, so the running sum of its tokens' byte lengths gives each
token's span in the UTF-8 text. Spans are interval-joined to the sections (sorted bounds, binary search). A token that
crosses a bound belongs to the section that holds most of its bytes, and on a tie to the earlier one; it is counted in
n_crossing of that section too. Over a document the counts add up to the whole text's tokens.

Sections are the document's paragraphs: each line with its line feed. Other cuts are a function text -> byte bounds. field_tokens()
counts by fields instead: several columns are encoded as one text, with a separator after each field but the last, which belongs to it.

Cases: a null or empty text is one empty section with 0 tokens; a text that ends in a line feed has no empty last section;
repeated rows are counted each; a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import Encoder, encoded, encoder
from .shared import ship, tidy

_lengths: dict[str, np.ndarray] = {}


def token_bytes(enc: Encoder, path: str) -> np.ndarray:
    """Bytes of text that each id stands for; a byte-level vocabulary writes each byte as one character."""
    if path not in _lengths:
        if enc.kind != "leading":
            raise ValueError("token spans need a byte-level tokenizer without a normaliser")
        n = np.zeros(enc.vocab_size, np.int64)
        for token, i in enc.tokenizer.get_vocab().items():
            n[i] = len(token)
        _lengths[path] = n
    return _lengths[path]


def lines(data: bytes) -> np.ndarray:
    """Byte bounds of the lines of data, 0 and len(data) among them."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a bound) for token spans and section bounds in bytes."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    section, crosses = first.copy(), last > first
    for i in np.flatnonzero(crosses):
        edges = bounds[first[i] : last[i] + 2].clip(starts[i], ends[i])
        section[i] = first[i] + int(np.argmax(np.diff(edges)))
    return section, crosses


def section_tokens(docs: DataFrame, tokenizer: str, cut: Callable[[bytes], np.ndarray] = lines) -> DataFrame:
    """docs(doc_id, text) -> doc_id, section, byte_start, byte_end, n_tokens, n_crossing; a row per section."""
    return _counted(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), tokenizer, cut)


def field_tokens(docs: DataFrame, fields: list[str], tokenizer: str, separator: str = "\n") -> DataFrame:
    """docs(doc_id, *fields) -> doc_id, field, byte_start, byte_end, n_tokens, n_crossing; a row per document and field, from one encoding of all its
    fields. A null field counts as empty."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    texts = [F.concat(t, F.lit(separator)) for t in texts[:-1]] + texts[-1:]
    ends = F.array(*[F.octet_length(F.concat(*texts[: k + 1])) for k in range(len(texts))])
    rows = _counted(docs.select(F.col("doc_id").cast("long"), F.concat(*texts), ends), tokenizer, None)
    return rows.select("doc_id", F.get(F.array(*map(F.lit, fields)), F.col("section")).alias("field"), "byte_start", "byte_end", "n_tokens", "n_crossing")


def _counted(rows: DataFrame, tokenizer: str, cut: Callable[[bytes], np.ndarray] | None) -> DataFrame:
    """Sections of rows(doc_id, text) by cut(text), or of rows(doc_id, text, ends) by the bytes at which they end."""
    ship(rows.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "section", "byte_start", "byte_end", "n_tokens", "n_crossing")])

    def count(batches):
        enc = encoder(tokenizer)
        width = token_bytes(enc, tokenizer)
        for batch in batches:
            held, n_rows = [], 0
            for (doc, ids), bound in zip(encoded(batch, enc), batch.column(1 if cut else 2)):
                bounds = cut((bound.as_py() or "").encode("utf-8", "surrogatepass")) if cut else np.array([0, *bound.as_py()])
                ends = np.cumsum(width[np.frombuffer(ids, "<u4")])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                section, crosses = attribute(starts, ends, bounds)
                n = len(bounds) - 1
                held.append((doc, n, bounds, np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n)))
                n_rows += n
                if n_rows >= 50_000:
                    yield _table(held, schema)
                    held, n_rows = [], 0
            if held:
                yield _table(held, schema)

    return rows.mapInArrow(tidy(count, encodes=True), "doc_id long, section long, byte_start long, byte_end long, n_tokens long, n_crossing long")


def _table(held: list, schema: pa.Schema) -> pa.RecordBatch:
    ids = pa.array([d for d, n, *_ in held for _ in range(n)], pa.int64())
    cols = [np.concatenate([np.arange(n) for _, n, *_ in held]), np.concatenate([b[:-1] for _, _, b, _, _ in held]), np.concatenate([b[1:] for _, _, b, _, _ in held]), np.concatenate([c for *_, c, _ in held]), np.concatenate([x for *_, x in held])]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int64)) for c in cols]], schema=schema)
