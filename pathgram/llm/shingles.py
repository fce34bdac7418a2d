"""Word shingles of Arrow string arrays, as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the working memory whatever the length of a text.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, size: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < size:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.multiply.accumulate(steps)
    return known


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case) in order, and the first word's place for each text, and the end."""
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    opens, closes = inside.copy(), inside.copy()
    cuts = offs[(offs > 0) & (offs < len(raw))]
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[cuts] = True
    opens[1:] &= ~inside[:-1] | breaks[1:-1]
    closes[:-1] &= ~inside[1:] | breaks[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        a, b = starts[first], ends[last - 1]
        part = raw[a:b]
        low = part + np.uint8(32) * ((part >= 65) & (part <= 90))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, b - a)[: b - a], out=sums[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        out[first:last] = (sums[e] - sums[s]) * _power("down", _BACK, b - a)[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out), np.searchsorted(starts, offs, "left")


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    words, places = word_hashes(texts)
    keys = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    for a, b in zip(places[:-1], places[1:], strict=True):
        n = b - a
        if n == 0:
            yield np.zeros(0, np.uint64)
            continue
        k = min(width, n)
        total = np.full(n - k + 1, np.uint64(k if n < width else 0), np.uint64)
        for j in range(k):
            total += words[a + j : a + j + n - k + 1] * keys[j]
        yield np.unique(mix(total))
