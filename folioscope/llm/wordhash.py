"""Hashes of the words of many texts at once, with numpy on Arrow's own buffers.

A batch's UTF-8 bytes are read as one array.  A word's hash is the difference of two prefix
sums of byte * B^position (mod 2^64), moved to position 0 by the inverse power of B, so one
pass serves all words; a finaliser mixes the bits.  Work goes in pieces of a bounded number
of bytes that end at a separator, so a very long text needs no more memory than a short one
(a single word longer than a piece makes that piece longer).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII white space.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII characters other than letters and digits.
PUNCTUATION = np.array([c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _hash_piece(b: np.ndarray, doc_at: np.ndarray, doc: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b: lower-cased bytes; doc_at: where texts begin in b; doc: their numbers."""
    gap = sep[b]
    inside = ~gap
    opens = inside.copy()
    opens[1:] &= gap[:-1]
    firsts = doc_at[doc_at < len(b)]
    opens[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= gap[1:] | opens[1:]
    at, end = np.nonzero(opens)[0], np.nonzero(closes)[0] + 1
    n = max(PIECE, 1 << (len(b) - 1).bit_length())
    powers, inverse = _powers(n)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=sums[1:])
    h = mix((sums[end] - sums[at]) * inverse[at] + (end - at).astype(np.uint64))
    return h, doc[np.searchsorted(doc_at, at, side="right") - 1]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts); null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), at


def word_hashes(texts: pa.Array, sep: np.ndarray = SPACES):
    """Yields (first text, end text, hashes, text numbers): the words of a few whole texts at a time."""
    data, at = text_buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, side="right")) - 1)
        lo, hi = int(at[first]), int(at[end])
        if hi - lo <= PIECE:
            b = LOWER[data[lo:hi]]
            own = (at[first:end] - lo).astype(np.int64)
            yield (first, end, *(_hash_piece(b, own, np.arange(first, end), sep) if len(b) else _none()))
        else:
            parts, zero, who = [], np.zeros(1, np.int64), np.array([first])
            while lo < hi:
                stop = min(lo + PIECE, hi)
                if stop < hi:
                    gaps = np.nonzero(sep[data[lo:stop]])[0]
                    while not len(gaps) and stop < hi:
                        stop = min(stop + PIECE, hi)
                        gaps = np.nonzero(sep[data[lo:stop]])[0]
                    if len(gaps) and stop < hi:
                        stop = lo + int(gaps[-1]) + 1
                parts.append(_hash_piece(LOWER[data[lo:stop]], zero, who, sep))
                lo = stop
            yield first, end, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first = end


def _none() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)
