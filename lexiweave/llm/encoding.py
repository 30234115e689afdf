"""Exact token ids of whole texts, encoding each distinct segment of text once per Python worker.

Both families of tokenizer files handled here split a text at white space before any merge, so the ids of a
text are the ids of its segments one after another:

* ``leading``: byte-level BPE without a normaliser. A segment is a run of white space with the run of other characters
  after it; a cut falls only before white space that follows something else, which no pre-token spans.
* ``bare``: BPE behind NFC, white space collapsing and lower-casing that drops white space. A segment is a run
  of other characters.
* any other file: no segments, whole texts are encoded as they are.

Arrow cuts a batch of texts into segments and numbers the distinct ones; their ids come from a bounded table of segments met before (the
ones met most often stay), the rest from the tokenizers library, and one gather lays the ids of the batch end to end. A segment
of plain letters with plain punctuation after it is two pre-tokens, which go to the tokenizer's model one by one and are kept
for other segments; every other segment goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import hand_back

#: Unicode White_Space, as character-class text.
WHITE = "\t-\r \x85\xa0  -     　"
#: White space besides space and line feed, and what str.split() takes for white space though it is none.
RARE_ASCII = ("\t", "\x0b", "\x0c", "\r")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
RARE_WIDE = tuple("\x85\xa0                　")
LEADING = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BARE = re.compile(f"[^{WHITE}]+")
CUT = re.compile(f"(?<=[^{WHITE}])[ \n](?=[^{WHITE}])")

#: Regular texts have no white space but single spaces and line feeds (``leading``), or but spaces and line feeds (``bare``).
_ODD = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in ("\x00", *RARE_ASCII, *SEPARATORS, *RARE_WIDE)) + "]"
IRREGULAR = {"leading": _ODD + "|  |\n\n| \n|\n ", "bare": _ODD}
#: Letters (of every Unicode version, each one code point under NFC) and then punctuation without the apostrophe. AS_IS marks segments that no space leads.
AS_IS = "\x00"
PLAIN = re.compile(f"([{AS_IS}\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{{-~]*)")

#: Segments that a worker keeps, pre-tokens of letters that it keeps, and bytes of text (characters of a long text) that it cuts at a time.
KEEP = 250_000
KEEP_WORDS = 100_000
CHARS = 2_000_000


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary. Printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of every (s, n), end to end."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class _Known:
    """A bounded table segment -> ids in flat arrays; the segments met most often stay when it is full."""

    def __init__(self):
        self.keys = pa.array([], pa.string())
        self.starts = self.lengths = self.met = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def look_up(self, segments: pa.Array, counts: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, lengths) of distinct segments, `counts` times met in the batch; encode() gives the ids of new ones as bytes."""
        found = pc.index_in(segments, value_set=self.keys)
        fresh = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if fresh.any():
            new = segments.filter(found.is_null())
            ids = encode(new.to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at[fresh] = len(self.keys) + np.arange(len(ids))
            self.keys = pa.concat_arrays([self.keys, new])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
            self.met = np.concatenate([self.met, np.zeros(len(ids), np.int64)])
        self.met[at] += counts
        out = self.flat, self.starts[at], self.lengths[at]
        if len(self.keys) > KEEP:
            self._keep(np.sort(np.argpartition(-self.met, KEEP // 2)[: KEEP // 2]))
        return out

    def _keep(self, which: np.ndarray) -> None:
        self.keys = self.keys.take(pa.array(which))
        self.flat = _gather(self.flat, self.starts[which], self.lengths[which])
        self.lengths, self.met = self.lengths[which], self.met[which]
        self.starts = np.cumsum(self.lengths) - self.lengths


class Encoder:
    """encode(texts) yields the ids of each text as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        self.vocab_size = self.tokenizer.get_vocab_size()
        if self.kind:
            self.tokenizer.model = self._model(spec["model"])
            self.model = self.tokenizer.model
        self.known, self.words, self.tails = _Known(), {}, {}
        self.to_bytes, self.space = str.maketrans({chr(b): c for b, c in _byte_characters().items()}), _byte_characters()[0x20]

    @staticmethod
    def _model(spec: dict):
        """The file's model without the library's own cache, which is slower than encoding a new word."""
        from tokenizers.models import BPE

        extra = {k: spec[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if spec.get(k)}
        return BPE(spec["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["merges"]], cache_capacity=0, **extra)

    @staticmethod
    def _kind(spec: dict) -> str | None:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("dropout"):
            return None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "leading"
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        splits = [x.get("type") for x in pre.get("pretokenizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]:
            return "bare"
        return None

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token: letters, or a space and letters."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= KEEP_WORDS:
                self.words.clear()
            written = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.to_bytes)
            self.words[word] = ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            if len(self.tails) >= KEEP_WORDS:
                self.tails.clear()
            self.tails[tail] = ids = next(self._ids([tail]))
        return ids

    def _encode_new(self, segments: list[str]) -> list[bytes]:
        lead = " " if self.kind == "leading" else ""
        out, odd = [b""] * len(segments), []
        for i, s in enumerate(segments):
            if m := PLAIN.fullmatch(s):
                mark, word, tail = m.groups()
                word = (word if mark else lead + word) if lead else word.lower()
                out[i] = (self._tail(mark) if mark == "\n" and lead else b"") + self._word(word) + (self._tail(tail) if tail else b"")
            else:
                odd.append(i)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for i, ids in zip(part, self._ids([s[1:] if (s := segments[i])[:1] == AS_IS else s if s[:1] == "\n" else lead + s for i in part])):
                out[i] = ids
        return out

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The segments of regular texts."""
        if self.kind == "bare":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        texts = pc.replace_substring(texts, "\n", " \n")  # the space that leads a segment goes with the cut
        spaced = pc.starts_with(texts, " ")
        return pc.split_pattern(pc.if_else(spaced, pc.utf8_slice_codeunits(texts, 1), pc.binary_join_element_wise(AS_IS, texts, "")), " ")

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        if self.kind is None:
            ids = list(self._ids(texts.to_pylist()))
            return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        odd = pc.match_substring_regex(texts, IRREGULAR[self.kind])
        cuts = [self._cut(texts.filter(pc.invert(odd)))]
        if any_odd := pc.any(odd).as_py():
            find = (BARE if self.kind == "bare" else LEADING).findall
            cuts.append(pa.array([[AS_IS + s for s in find(t)] for t in texts.filter(odd).to_pylist()], pa.list_(pa.string())))
        segments = pa.concat_arrays([c.flatten() for c in cuts]).dictionary_encode()
        codes = segments.indices.to_numpy()
        flat, starts, lengths = self.known.look_up(segments.dictionary, np.bincount(codes, minlength=len(segments.dictionary)), self._encode_new)
        sizes = lengths[codes]
        ids = _gather(flat, starts[codes], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.concatenate([pc.list_value_length(c).to_numpy() for c in cuts]))]
        counts = np.diff(ends, prepend=0)
        if any_odd:  # back into the order of the texts
            mask = odd.to_numpy(zero_copy_only=False)
            order = np.empty(len(texts), np.int64)
            order[np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)])] = np.arange(len(texts))
            ids, counts = _gather(ids, (ends - counts)[order], counts[order]), counts[order]
        return ids, counts

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts of some CHARS characters, cut where a segment ends."""
        at = 0
        while self.kind and len(text) - at > CHARS and (m := CUT.search(text, at + CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, their ids end to end, number of ids of each) for some CHARS bytes of texts at a time; null counts as empty.
        Between them the worker keeps its table alone: what a part took goes back to the machine."""
        texts = texts.cast(pa.string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHARS, side="right")))
            if to == at + 1 and ends[at] - before > CHARS:
                ids = np.concatenate([self._batch(pa.array([p], pa.string()))[0] for p in self._parts(texts[at].as_py())])
                yield at, to, ids, np.array([len(ids)])
            else:
                yield at, to, *self._batch(texts.slice(at, to - at))
            at = to
            hand_back()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in order."""
        for _, _, ids, counts in self.encode_column(pa.array(texts, pa.string())):
            data, ends = ids.tobytes(), 4 * np.cumsum(counts)
            yield from (data[b - 4 * n : b] for b, n in zip(ends.tolist(), counts.tolist()))


def encoded(batch, enc: Encoder) -> Iterator[tuple]:
    """(doc_id, ids as bytes) of each row of an Arrow batch of (doc_id, text)."""
    for a, b, ids, counts in enc.encode_column(batch.column(1)):
        data, ends = memoryview(ids.tobytes()), 4 * np.cumsum(counts)
        yield from ((d, data[e - 4 * n : e]) for d, e, n in zip(batch.column(0).slice(a, b - a).to_pylist(), ends.tolist(), counts.tolist()))


_encoders: dict[str, Encoder] = {}


def forget_encoders() -> None:
    _encoders.clear()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its table lives until the worker takes a task that encodes nothing."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
