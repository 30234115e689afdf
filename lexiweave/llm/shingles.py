"""Sets of word shingles as sorted 64-bit hashes, computed with numpy over many documents at once.

Words are runs of bytes other than space and \\t-\\r after lower-casing A-Z; a shingle is `width` consecutive words, and a
shorter text is one shingle of all its words. A hash stands for its shingle (two of n distinct ones meet with
probability n^2 / 2^65).
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a word longer than this still stays whole.
BLOCK = 1 << 17
_R = 0xD6E8FEB86659FD93
_R_INVERSE = pow(_R, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _R_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of data."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def _blocks(data: bytes):
    """data in parts of at least BLOCK bytes that end where a word ends."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def _of_words(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each shingle, in order, with repeats."""
    n = len(words)
    if not n:
        return words
    take = min(width, n)
    h = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        h += words[k : n - take + 1 + k] * _PLACES[k]
    return mix(h + np.uint64(take))


def _distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(texts: list[str | None], width: int):
    """Yields the sorted distinct shingle hashes of each text; null counts as empty."""
    held: list[bytes] = []
    size = 0

    def flush():
        if not held:
            return
        words, starts = _hash_words(b"\n".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield _distinct(_of_words(words[lo:hi], width))
        held.clear()

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if len(data) > BLOCK:
            yield from flush()
            size = 0
            yield _distinct(_of_words(np.concatenate([_hash_words(x)[0] for x in _blocks(data)]), width))
            continue
        held.append(data)
        size += len(data) + 1
        if size >= BLOCK:
            yield from flush()
            size = 0
    yield from flush()


def set_key(s: np.ndarray) -> bytes:
    """128-bit key of a set of shingles, whatever their order: two sums of unlike mixes."""
    sums = [np.sum(mix(s ^ np.uint64(salt)), dtype=np.uint64) + np.uint64(len(s)) for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9F3B)]
    return mix(np.asarray(sums, np.uint64)).tobytes()
