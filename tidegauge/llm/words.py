"""Word hashes of whole Arrow text batches in numpy, for the operators that compare word sequences.

A word is a maximal run of ASCII letters, digits, underscore and non-ASCII characters, in lower case unless told otherwise;
with ``marks`` a run of other visible characters is a token too. A batch is walked in slices of a few megabytes, so the
working memory follows the slice (or the one longest text), not the batch. Hashes are polynomial (Karp-Rabin) prefix
differences modulo 2**64 with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def _kinds() -> np.ndarray:
    kind = np.full(256, 2, np.uint8)
    kind[[0x20, *range(0x09, 0x0E), 0x00]] = 0
    kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    return kind


_KIND = _kinds()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _PIECE), np.uint64(base), np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= _PIECE:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds behave as different hash functions."""
    y = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0xA0761D6478BD642F) % (1 << 64))
    y = (y ^ (y >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    y = (y ^ (y >> np.uint64(29))) * np.uint64(0x8EBC6AF09C88C6E3)
    return y ^ (y >> np.uint64(32))


class Words(NamedTuple):
    """Tokens of several texts: ``hashes[bounds[i]:bounds[i + 1]]`` belong to text i; ``spans`` are byte offsets in ``data``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    marks: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, hi - lo), out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (prefix[e] - prefix[s]) * _powers(_INV, hi - lo)[s]
        i = j
    return mix(out)


def split(texts: pa.Array, marks: bool = False, lower: bool = True) -> Words:
    """Tokens of the texts of one slice; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.utf8_lower(texts) if lower else texts
    _, offs, body = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    if not marks:
        kind = (kind == 1).astype(np.uint8)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none, data, none.astype(bool))
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    keep = kind[begin] != 0
    begin, end = begin[keep], end[keep]
    return Words(_hash_runs(data, begin, end), np.searchsorted(begin, offsets), begin, end, data, kind[begin] == 2)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens that begin at each position; empty for fewer than n tokens."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashes[j : j + len(out)]
    return mix(out, n)
