"""Word shingles of whole texts as 64-bit hashes, computed over many texts at a time.

Words are maximal runs of bytes other than blank and 0x09-0x0D, A-Z lower-cased. A text of fewer words
than a shingle has is one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]


def word_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts in order, and where each text's words start (one more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACES[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = inside[edges]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    first = np.flatnonzero(opens[at])
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _STEP)]))
    hashes = mix(np.add.reduceat(_BYTES[data[at]] * powers[place], first) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.LargeStringArray, size: int) -> list[np.ndarray]:
    """Of each text, the hashes of its shingles in order, repeats included."""
    words, at = word_hashes(texts)
    hashes = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            hashes = hashes * _STEP + words[j : j + len(hashes)]
        hashes = mix(hashes)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(hashes[a : b - size + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = whole * _STEP + w
                out.append(mix(np.array([whole])))
            else:
                out.append(hashes[:0])
    return out


def shingle_sets(texts: pa.LargeStringArray, size: int) -> list[np.ndarray]:
    """Of each text, its distinct shingle hashes, ascending."""
    return [np.unique(x) for x in shingle_hashes(texts, size)]
