"""Re-Pair grammar compression of one shard of token ids, with random access by expansion lengths.

Each round counts all adjacent pairs, gives every frequent one a nonterminal (most frequent first)
and replaces its occurrences; rounds go on until no pair is frequent or a round gains next to nothing. A shard stores its rules (left
and right symbol), how many ids each rule expands to, and the remaining sequence. To read a part of
the shard, running sums of expansion lengths find the symbols that cover it, and only those expand.
"""

from __future__ import annotations

import struct

import numpy as np


#: Fixed values of the file format: a mark, then base symbol, numbers of rules, symbols, documents, ids.
MAGIC = b"RPG1"
HEADER = struct.Struct("<4sIIIII")
#: A pair needs this many occurrences to earn a rule.
MIN_COUNT = 16
#: A round also takes the pairs down to this share of its most frequent one.
ROUND_SHARE = 8
#: Rounds end after one that shortens the sequence by less than this part of it: later ones save less than they cost.
LEAST_GAIN = 64
#: Buckets in which pairs are counted before the exact count of the frequent ones.
BUCKETS = 1 << 18


def _frequent(pairs: np.ndarray, min_count: int) -> np.ndarray:
    """Priority of each position's pair (0 for the most frequent), len(pairs) where it isn't frequent."""
    none = len(pairs)
    rank = np.full(none, none, dtype=np.int32)
    bucket = ((pairs * np.int64(-7046029254386353131)) >> np.int64(40)) & np.int64(BUCKETS - 1)
    crowd = np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(crowd[bucket] >= min_count)  # a pair is at most as frequent as its bucket
    if len(at):
        values, which, counts = np.unique(pairs[at], return_inverse=True, return_counts=True)
        kept = np.flatnonzero(counts >= max(min_count, counts.max() // ROUND_SHARE))
        if len(kept) and counts.max() >= min_count:
            order = np.full(len(values), none, dtype=np.int32)
            order[kept[np.argsort(-counts[kept], kind="stable")]] = np.arange(len(kept), dtype=np.int32)
            rank[at] = order[which]
    return rank


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), expansion lengths (n) and the sequence; symbol base + i stands for rule i."""
    sequence, rules, lengths = ids.astype(np.int64), [], np.ones(base, dtype=np.int64)
    top = base
    while len(sequence) > 1:
        rank = _frequent((sequence[:-1] << 32) | sequence[1:], min_count)
        near = np.flatnonzero(rank < len(rank))  # only pairs with a priority matter from here on
        value = rank[near]
        touch = np.diff(near) == 1
        same = np.concatenate([[False], touch & (value[1:] == value[:-1])])
        place = np.arange(len(near))
        run = place - np.maximum.accumulate(np.where(same, 0, place))
        better = np.concatenate([[True], ~touch | (value[:-1] > value[1:])])
        chosen = np.where(same, run % 2 == 0, better[: len(near)])  # of overlapping pairs the better, of a run every other
        chosen[:-1] &= ~touch | (value[:-1] <= value[1:])
        at = near[chosen]
        used = np.bincount(rank[at]) if len(at) else np.zeros(0, dtype=np.int64)
        earned = used >= max(2, min_count // 2)
        if not earned.any():
            break
        at = at[earned[rank[at]]]
        symbol = top + np.cumsum(earned) - 1
        example = np.zeros(len(used), dtype=np.int64)
        example[rank[at]] = at
        left, right = sequence[example[earned]], sequence[example[earned] + 1]
        rules.append(np.stack([left, right], axis=1))
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        top += len(left)
        sequence[at] = symbol[rank[at]]
        keep = np.ones(len(sequence), dtype=bool)
        keep[at + 1] = False
        before, sequence = len(sequence), sequence[keep]
        if before - len(sequence) < before // LEAST_GAIN:
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return table, lengths[base:], sequence


def expand(sequence: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for; one pass a level of the grammar."""
    sequence = sequence.astype(np.int64)
    while len(at := np.flatnonzero(sequence >= base)):
        copies = np.ones(len(sequence), dtype=np.int64)
        copies[at] = 2
        out = np.repeat(sequence, copies)
        first = at + np.arange(len(at))
        out[first], out[first + 1] = rules[sequence[at] - base].T
        sequence = out
    return sequence.astype(np.uint32)


class Shard:
    """One compressed shard as it is stored: ids of whole documents one after another."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray):
        self.base, self.rules, self.lengths, self.sequence, self.doc_ids, self.doc_lengths = base, rules, lengths, sequence, doc_ids, doc_lengths

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray, min_count: int = MIN_COUNT) -> Shard:
        base = int(ids.max()) + 1 if len(ids) else 1
        return cls(base, *compress(ids, base, min_count), doc_ids, doc_lengths)

    def to_bytes(self) -> bytes:
        head = HEADER.pack(MAGIC, self.base, len(self.rules), len(self.sequence), len(self.doc_ids), int(self.doc_lengths.sum()))
        wide = np.uint16 if self.base + len(self.rules) <= 1 << 16 else np.uint32
        symbols = np.concatenate([self.rules.ravel(), self.sequence]).astype(wide).tobytes()
        return b"".join([head, self.doc_ids.astype("<i8").tobytes(), self.doc_lengths.astype("<u4").tobytes(), self.lengths.astype("<u4").tobytes(), symbols])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, base, n_rules, n_symbols, n_docs, _ = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        doc_lengths = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs)
        lengths = np.frombuffer(data, "<u4", n_rules, at := at + 4 * n_docs)
        symbols = np.frombuffer(data, "<u2" if base + n_rules <= 1 << 16 else "<u4", 2 * n_rules + n_symbols, at + 4 * n_rules).astype(np.int64)
        return cls(base, symbols[: 2 * n_rules].reshape(-1, 2), lengths, symbols[2 * n_rules :], doc_ids, doc_lengths)

    def ids(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.base)

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of the shard; expands only the symbols that cover them."""
        if length <= 0:
            return np.zeros(0, dtype=np.uint32)
        if not hasattr(self, "ends"):
            sizes = np.concatenate([np.ones(self.base, dtype=np.int64), self.lengths.astype(np.int64)])
            self.ends = np.cumsum(sizes[self.sequence])
        a = int(np.searchsorted(self.ends, start, side="right"))
        b = int(np.searchsorted(self.ends, start + length, side="left")) + 1
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.sequence[a:b], self.rules, self.base)[start - before : start - before + length]


def shard_starts(doc_lengths: np.ndarray, limit: int) -> np.ndarray:
    """Where new shards begin among documents, each shard holding about ``limit`` ids, never part of a document."""
    group = (np.cumsum(doc_lengths) - doc_lengths) // limit
    return np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if len(doc_lengths) else np.zeros(0, dtype=np.int64)


