"""Words of texts and hashes of words and word spans, as NumPy arrays (workers only).

Texts are handled many at a time, as the byte buffer and offsets that Arrow holds them in: no object is made per text or word.
A word's hash is a polynomial of its bytes, a span's one of its words' hashes, both modulo 2^64 and mixed, so that any span takes
three operations. Words of over LONG bytes, for which such polynomials are known to collide by design, are hashed by xxh3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BASE, LETTER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LONG = 256
#: Texts are gathered up to so many bytes at a time, which the processor's cache holds; a longer text is one step.
STEP = 1 << 18
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0, base^1, ... (of its inverse modulo 2^64)."""
    key = base, inverse
    if len(_powers.get(key, ())) < n:
        steps = np.full(1 << max(10, n.bit_length()), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def prefixes(hashes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, from which any span's hash takes three operations."""
    return _sums(hashes, BASE)


def spans(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of each span [start, stop); equal sequences have equal hashes wherever they stand."""
    x = prefix[stop] - prefix[start]
    x *= powers(base, len(prefix), True)[start]
    x += (stop - start).astype(np.uint64)
    return mixed(x)


def windows(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of `size` words."""
    n = len(prefix) - 1
    if n < size:
        return np.empty(0, dtype=np.uint64)
    x = prefix[size:] - prefix[:-size]
    x *= powers(BASE, len(prefix), True)[: n - size + 1]
    x += np.uint64(size)
    return mixed(x)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: h (hashes), first (each text's first word, and the end)."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, lower: bool = False):
        """data: the texts' bytes one after the other; edges: their offsets, and the end. lower: A-Z as a-z."""
        if lower:
            data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
        solid = (data != 32) & (data - np.uint8(9) > 4)
        inner = edges[(edges > 0) & (edges < len(data))]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[inner] = solid[inner]
        ends[:-1] &= ~solid[1:]
        ends[inner - 1] = solid[inner - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.h = spans(_sums(data.astype(np.uint64), LETTER), b, e, LETTER)
        for k in np.flatnonzero(e - b > LONG):
            self.h[k] = xxhash.xxh3_64_intdigest(data[b[k] : e[k]].tobytes())
        self.first = np.searchsorted(b, edges)

    def prefix(self) -> np.ndarray:
        return prefixes(self.h)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null has none."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)), at


def steps(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from, to, Words) of rows [from, to), about STEP bytes at a time."""
    data, at = buffer(texts)
    k = 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(at, at[k] + STEP, side="right")) - 1)
        yield k, to, Words(data[at[k] : at[to]], at[k : to + 1] - at[k], lower)
        k = to
