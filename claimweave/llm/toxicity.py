"""Operator 8: toxic spans by a linear-chain conditional random field, summed up to document scores.

Tokens are runs of letters (lower-cased), chains are sentences. Each token has hashed features: the
word, its prefixes of 3, 4 and 5 bytes, and the 4-byte prefixes of its neighbours.

1. All documents that may be learned from are counted: per hashed word and prefix, in how many toxic
   and in how many clean documents it occurs (two histograms of constant size).
2. In a sample of labelled documents bounded by ``sample_docs``, a token of a toxic document is
   labelled toxic if its word or one of its prefixes is far more frequent in toxic documents; all
   other tokens are labelled clean.
3. The field is trained on these tokens by gradient ascent on the likelihood (forward-backward), from
   weights that the whole counts suggest, so a word no sampled document has still counts.
4. Forward-backward marginals of every token of every document give the expected number of toxic
   tokens and the surest one; a logistic model over them, fitted on the same sample with the weights
   of the whole table, gives the score. Tokens with a marginal of a half or more make the spans.

Null or empty texts have no token; their score is what the logistic model says without evidence (0 if
nothing was labelled). Null labels and null ids are not learned from. Repeated rows get equal answers;
repeated label rows of an id count once, toxic if any says so. Very long texts, with or without
sentence ends, take time in proportion to their length. Ties don't arise (a half counts as toxic). Empty
tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.batches import text_slices, texts_of
from claimweave.llm.shingles import mix

BITS = 18
CHUNKS = 16
FEATURES = 6
#: Labelled documents, half of them toxic, that the field is trained on.
SAMPLE_DOCS = 1200
#: A feature marks tokens as toxic from this log ratio of rates on, if chance hardly explains it: the log
#: likelihood it gains must exceed what the luckiest of all features would gain.
LEAST_RATIO = 3.0
#: Tokens of a chain that are walked through one by one.
BLOCK = 256
#: The weight that a marked feature has before training, for a log ratio of one, and up to which ratio it grows.
PRIOR_WEIGHT, PRIOR_RATIO = 0.5, 4.0
LEAST_GAIN = BITS * np.log(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Tokens:
    """Tokens of several texts: byte offsets (into each lower-cased text), text and chain of each, hashed features."""

    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    chain: np.ndarray
    feature: np.ndarray  # (tokens, FEATURES), the last two of the neighbours; 0 where there is none
    texts: int


def tokens_of(texts: pa.Array) -> Tokens:
    lower = pc.utf8_lower(texts)
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = _LETTER[data]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = letter[edges]
    starts = np.flatnonzero(opens)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return Tokens(none, none, none, none, np.zeros((0, FEATURES), dtype=np.int32), len(lower))
    inner = np.flatnonzero(letter)
    first = np.flatnonzero(opens[inner])
    length = np.diff(np.append(first, len(inner)))
    value = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)[data[inner]]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _STEP)]))
    place = np.arange(len(inner)) - np.repeat(first, length)
    value = value * powers[place]
    feature = np.zeros((len(starts), FEATURES), dtype=np.int32)

    def hashed(total, salt):
        return (mix(total + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)

    feature[:, 0] = hashed(np.add.reduceat(value, first), 1)
    running = np.zeros(len(starts), dtype=np.uint64)
    for i in range(5):
        has = length > i
        running[has] += value[first[has] + i]
        if i >= 2:
            feature[:, i - 1] = hashed(running, 1 + i)
    text = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(stops) != 0)
    side = hashed(feature[:, 2].astype(np.uint64), 11)
    other = hashed(feature[:, 2].astype(np.uint64), 13)
    feature[1:, 4] = np.where(new[1:], 0, side[:-1])
    feature[:-1, 5] = np.where(new[1:], 0, other[1:])
    return Tokens(starts - offsets[text], length, text, np.cumsum(new) - 1, feature, len(lower))


def marginals(score: np.ndarray, chain: np.ndarray, bonds: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Chance that each token is toxic, and expected numbers of the four kinds of neighbours (from, to).

    score: how much more toxic than clean each token looks by itself; bonds: log weights (from, to).
    Chains are cut into blocks that run side by side, the longest first. What a block does to the state
    before it is a 2 x 2 matrix; these carry the state from block to block, so cutting changes nothing
    and the longest chain costs as many steps as a block has tokens, and one for each of its blocks.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    opens = np.diff(chain, prepend=-1) != 0
    place = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    first = np.flatnonzero(place % block == 0)
    length = np.diff(np.append(first, n))
    nth = place[first] // block  # of its chain
    last = np.append(nth[1:] == 0, True)
    order = np.argsort(-length, kind="stable")
    start, size = first[order], length[order]
    running = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    weight = np.exp(bonds)
    local = np.stack([1 / (1 + np.exp(np.clip(score, -30, 30))), 1 / (1 + np.exp(-np.clip(score, -30, 30)))], axis=1)
    before, after = np.ones((len(first), 2)), np.ones((len(first), 2))
    if not last.all() or nth.any():
        long = order[np.isin(np.cumsum(nth == 0)[order], np.cumsum(nth == 0)[nth > 0])]
        acts = np.zeros((len(first), 2, 2))
        # the first token of a chain has no bond before it
        bond = np.where((nth[long] == 0)[:, None, None], np.eye(2)[None], weight[None])
        acts[long] = bond * local[first[long]][:, None, :]
        for t in range(1, int(size[0])):
            long = long[: np.searchsorted(-length[long], -(t + 1), side="right")]
            step = (acts[long] @ weight) * local[first[long] + t][:, None, :]
            acts[long] = step / step.sum(axis=(1, 2), keepdims=True)
        for k in range(1, int(nth.max()) + 1):
            at = np.flatnonzero(nth == k)
            step = np.einsum("bi,bij->bj", before[at - 1], acts[at - 1])
            before[at] = step / step.sum(axis=1, keepdims=True)
        for k in range(int(nth.max()) - 1, -1, -1):
            at = np.flatnonzero((nth == k) & ~last)
            step = np.einsum("bij,bj->bi", acts[at + 1], after[at + 1])
            after[at] = step / step.sum(axis=1, keepdims=True)
    forward, backward = local.copy(), np.ones((n, 2))
    carried = nth > 0
    forward[first[carried]] = (before[carried] @ weight) * local[first[carried]]
    forward[first] /= forward[first].sum(axis=1, keepdims=True)
    for t in range(1, int(size[0])):
        at = start[: running[t]] + t
        step = (forward[at - 1] @ weight) * local[at]
        forward[at] = step / step.sum(axis=1, keepdims=True)
    backward[first + length - 1] = after
    for t in range(int(size[0]) - 2, -1, -1):
        at = start[: running[t + 1]] + t
        step = (backward[at + 1] * local[at + 1]) @ weight.T
        backward[at] = step / step.sum(axis=1, keepdims=True)
    both = forward * backward
    inner = np.flatnonzero(np.diff(chain) == 0)
    pairs = forward[inner][:, :, None] * weight[None] * (local[inner + 1] * backward[inner + 1])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), pairs.sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bonds: np.ndarray
    final: np.ndarray  # logistic weights: constant, log of likely toxic tokens, surest token, share

    def tag(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the tokens, and one row of evidence a text."""
        chance, _ = marginals(sum(self.weights[t.feature[:, i]] for i in range(FEATURES)) + self.bias, t.chain, self.bonds)
        total = np.bincount(t.text, weights=chance * chance, minlength=t.texts)  # many doubtful tokens don't add up to a sure one
        count = np.bincount(t.text, minlength=t.texts)
        surest = np.zeros(t.texts)
        np.maximum.at(surest, t.text, chance)
        return chance, np.column_stack([np.ones(t.texts), np.log1p(total), surest, total / np.maximum(count, 1)])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.final, -40, 40)))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of each hashed word or prefix, toxic and clean, and all documents of either kind."""

    def count(batches):
        seen, docs = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in text_slices(batches):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            t = tokens_of(texts_of(batch))
            key = np.unique((np.repeat(t.text, 4).astype(np.int64) << BITS) | t.feature[:, :4].ravel())
            for kind in (0, 1):
                seen[kind] += np.bincount(key[toxic[key >> BITS] == kind] & ((1 << BITS) - 1), minlength=1 << BITS)
            docs += np.bincount(toxic, minlength=2)
        for i, part in enumerate(np.split(seen, CHUNKS, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.ascontiguousarray(part).tobytes()]), pa.array([int(docs[0])]), pa.array([int(docs[1])])], names=["chunk", "seen", "clean", "toxic"])

    def add(table):
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("seen").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "seen": pa.array([total.tobytes()]), "clean": pa.array([pc.sum(table.column("clean")).as_py()]), "toxic": pa.array([pc.sum(table.column("toxic")).as_py()])})

    schema = "chunk long, seen binary, clean long, toxic long"
    found = sorted(rows.mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect())  # always CHUNKS small rows
    if not found:
        return np.zeros(1 << BITS), np.zeros(1 << BITS), 0, 0
    seen = np.concatenate([np.frombuffer(r["seen"], dtype=np.int64).reshape(2, -1) for r in found], axis=1)
    return seen[1], seen[0], found[0]["toxic"], found[0]["clean"]


def _train_field(t: Tokens, gold: np.ndarray, rounds: int, prior: np.ndarray, penalty: float = 0.05) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and bonds that make the labelled tokens likely (gradient ascent with a step size for each weight).

    Weights start from ``prior`` and are drawn back to it, so a feature no sampled document has keeps it.
    """
    weights, bonds = prior.copy(), np.zeros((2, 2))
    bias = float(np.log((gold.sum() + 1) / (len(gold) + 1)))
    inner = np.flatnonzero(np.diff(t.chain) == 0)
    actual = np.zeros((2, 2))
    np.add.at(actual, (gold[inner], gold[inner + 1]), 1)
    used = np.unique(t.feature)
    flat = np.searchsorted(used, t.feature).astype(np.int32)
    own, mean, spread = prior[used], np.zeros(len(used) + 4), np.zeros(len(used) + 4)
    for k in range(1, rounds + 1):
        chance, expected = marginals(sum(own[flat[:, i]] for i in range(FEATURES)) + bias, t.chain, bonds)
        slope = sum(np.bincount(flat[:, i], weights=gold - chance, minlength=len(used)) for i in range(FEATURES)) - penalty * (own - prior[used])
        slope = np.concatenate([slope, (actual - expected).ravel() - penalty * bonds.ravel()])
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope * slope
        step = 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 0.1)
        own += step[:-4]
        bonds += 0.2 * step[-4:].reshape(2, 2)
    weights[used] = own
    weights[0] = 0.0  # stands for a missing neighbour
    return weights, bias, bonds


def _train_final(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic weights by Newton steps with a small penalty."""
    final = np.zeros(evidence.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(evidence @ final, -30, 30)))
        slope = evidence.T @ (weight * (toxic - p)) - 0.01 * final
        curve = (evidence * (weight * p * (1 - p))[:, None]).T @ evidence + 0.01 * np.eye(len(final))
        final += np.clip(np.linalg.solve(curve, slope), -3, 3)
    return final


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = 40) -> Model | None:
    """Learn from documents (doc_id, text) that have a label (doc_id, toxic 0/1, one row an id); None if they don't show both kinds."""
    labels = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    toxic_seen, clean_seen, n_toxic, n_clean = _counts(docs.join(labels.hint("merge"), "doc_id").select("text", "toxic"))  # the same way at any size
    if not n_toxic or not n_clean:
        return None
    ratio = np.log((toxic_seen + 0.5) / (n_toxic + 1)) - np.log((clean_seen + 0.5) / (n_clean + 1))
    part, base = toxic_seen / np.maximum(toxic_seen + clean_seen, 1), n_toxic / (n_toxic + n_clean)
    gain = toxic_seen * np.log(np.maximum(part, 1e-12) / base) + clean_seen * np.log(np.maximum(1 - part, 1e-12) / (1 - base))
    marked = (ratio >= LEAST_RATIO) & (gain >= LEAST_GAIN)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.when(F.col("toxic") == 1, int(min(1.0, sample_docs / 2 / n_toxic) * (1 << 30))).otherwise(int(min(1.0, sample_docs / 2 / n_clean) * (1 << 30)))
    drawn = F.broadcast(labels.filter(draw < bound))  # about sample_docs rows, whatever the table
    sample = docs.join(drawn, "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    texts = pc.fill_null(sample.column("text").cast(pa.large_string()), "").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    toxic = sample.column("toxic").to_numpy()
    t = tokens_of(texts)
    gold = (marked[t.feature[:, :4]].any(axis=1) & (toxic[t.text] == 1)).astype(np.int64)
    prior = np.where(marked, PRIOR_WEIGHT * np.minimum(ratio, PRIOR_RATIO), 0.0)
    prior[0] = 0.0
    model = Model(*_train_field(t, gold, rounds, prior), np.zeros(4))
    _, evidence = model.tag(t)
    share = np.where(toxic == 1, n_toxic / max(1, (toxic == 1).sum()), n_clean / max(1, (toxic == 0).sum()))
    model.final = _train_final(evidence, toxic, share)
    return model


def _code_points(texts: pa.Array, t: Tokens, at: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of tokens in code points of their text; one running count over all the bytes."""
    lower = pc.utf8_lower(texts)
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    opened = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = (offsets - offsets[0])[t.text[at]]
    start = base + t.start[at]
    return (opened[start] - opened[base]).tolist(), (opened[start + t.length[at]] - opened[base]).tolist()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, spans): spans as (start, end) in code points of the tokens that are likelier toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two constant-size arrays

    def run(batches):
        field = shared.value
        for batch in text_slices(batches):
            texts = texts_of(batch)
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            if field is not None:
                t = tokens_of(texts)
                chance, evidence = field.tag(t)
                scores = field.score(evidence)
                at = np.flatnonzero(chance >= 0.5)
                for i, a, b in zip(t.text[at].tolist(), *_code_points(texts, t, at), strict=True):
                    spans[i].append({"start": a, "end": b})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def judge(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_spans, spans): learned from labels of documents whose remainder by 5 is not 0."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).filter((remainder != 0) & F.col("toxic").isin(0, 1))
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(rows.filter(remainder != 0), told, sample_docs)
    found = score(rows, model)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
