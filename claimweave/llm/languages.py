"""Operator 2: language of whole texts, by family first and one-versus-one linear SVMs within the family.

Features are hashed byte 1- to 4-grams of the lower-cased text (everything but letters is one blank),
square-rooted counts of unit length. One linear SVM a family separates it from the others; within the
best family, one SVM for every two of its languages votes. SVMs are trained by dual coordinate descent
on a sample of labelled rows bounded by ``sample_rows`` (a hash of the id decides, evenly by language).

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
labelled. The language, source and id of a row never enter its prediction. Rows with a null id are
predicted, never learned from. Very long texts count whole, in a row of fixed size. Ties of margins and
votes go to the name that comes first. Repeated rows get equal answers; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.llm.batches import give_back, text_slices, texts_of

#: ISO 639-1 codes by family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indo-aryan": "hi ur bn pa gu mr ne si".split(),
    "semitic": "ar he mt am".split(),
    "celtic": "ga gd cy br".split(),
    "sinitic": "zh yue".split(),
}
UNDECIDED = "und"
DIMENSIONS = 4096
#: Labelled rows to learn from.
SAMPLE_ROWS = 2000
SLICE_ROWS = 250

_LETTER = np.full(256, 0x20, dtype=np.uint32)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def features(texts: pa.Array) -> np.ndarray:
    """One unit row a text."""
    lower = pc.utf8_lower(texts).combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.utf8_lower(texts)
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = _LETTER[np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(len(lower)), np.diff(offsets))
    out = np.zeros(len(lower) * DIMENSIONS)
    gram = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, 5):
        gram = gram[: len(data) - n + 1] * np.uint32(263) + data[n - 1 :]
        if not len(gram):
            break
        inside = row[: len(gram)] == row[n - 1 :]
        cell = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
        out += np.bincount(row[: len(gram)][inside] * DIMENSIONS + cell[inside], minlength=len(out))
    out = np.sqrt(out).astype(np.float32).reshape(len(lower), DIMENSIONS)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def train_svm(x: np.ndarray, positive: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; the last column of x is 1."""
    y = np.where(positive, 1.0, -1.0)
    weights, alpha = np.zeros(x.shape[1], dtype=np.float64), np.zeros(len(x))
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ weights) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Model:
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        names = np.array(labels, dtype=object)
        known = sorted(set(labels))
        model = cls(sorted({family_of(k) for k in known}))
        home = np.array([family_of(k) for k in labels], dtype=object)
        model.languages = {f: [k for k in known if family_of(k) == f] for f in model.families}
        model.family_weights = np.stack([train_svm(x, home == f) for f in model.families]) if len(model.families) > 1 else None
        for f, own in model.languages.items():
            model.pairs[f] = []
            for i in range(len(own)):
                for j in range(i + 1, len(own)):
                    among = (names == own[i]) | (names == own[j])
                    model.pairs[f].append((i, j, train_svm(x[among], names[among] == own[i])))
        return model

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row."""
        names, scores = np.full(len(x), UNDECIDED, dtype=object), np.zeros(len(x))
        if not self.families:
            return names, scores
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        sure = np.ones(len(x))
        best = np.zeros(len(x), dtype=int)
        if self.family_weights is not None:
            margin = x @ self.family_weights.T
            best = margin.argmax(axis=1)
            odds = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
            sure = 1 / odds.sum(axis=1)
        for f, family in enumerate(self.families):
            at, own = np.flatnonzero(best == f), self.languages[family]
            votes, trust = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
            for i, j, weights in self.pairs[family]:
                chance = 1 / (1 + np.exp(-np.clip(3 * (x[at] @ weights), -50, 50)))
                votes[:, i] += chance >= 0.5
                votes[:, j] += chance < 0.5
                trust[:, i] += chance
                trust[:, j] += 1 - chance
            winner = (votes + trust / (len(own) + 1)).argmax(axis=1)
            names[at] = np.array(own, dtype=object)[winner]
            scores[at] = sure[at] * (trust[np.arange(len(at)), winner] / max(1, len(own) - 1) if len(own) > 1 else 1)
        return names, np.clip(scores, 0, 1)


def _slices(batches):
    for batch in text_slices(batches):
        for a in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(a, SLICE_ROWS)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from rows (doc_id, text, lang); about ``sample_rows`` of them, whole texts, enter the model."""
    rows = labelled.filter("doc_id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return Model()
    each = sample_rows / len(counts)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, each / n) * (1 << 30))))])

    def vectors(batches):
        for batch in _slices(batches):
            x = features(texts_of(batch)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([r.tobytes() for r in x])], names=["doc_id", "lang", "x"])

    picked = rows.filter(draw < bound[F.col("lang")]).select("doc_id", "lang", "text")
    table = picked.mapInArrow(vectors, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    labels = table.column("lang").to_pylist()
    del table
    model = Model.fit(x, labels)
    del x
    give_back()
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of the rows, with the language and its score under the names given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight vector a language pair
    names = [f"c{i}" for i in range(len(keep))]
    inner = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), *([] if "text" in keep else [F.col("text").alias("text")]))
    text = names[keep.index("text")] if "text" in keep else "text"

    def run(batches):
        for whole in text_slices(batches, text):
            for a in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(a, SLICE_ROWS)
                texts = texts_of(part, text)
                languages, scores = shared.value.predict(features(texts))
                lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                languages[~lettered], scores[~lettered] = UNDECIDED, 0.0
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(languages, pa.string()), pa.array(scores)], names=[*names, "found", "sure"])

    schema = T.StructType([*inner.select(*names).schema, T.StructField("found", T.StringType()), T.StructField("sure", T.DoubleType())])
    out = inner.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("found").alias(named[0]), F.col("sure").alias(named[1]))


def remainder(modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from labelled rows whose remainder by 4 is not 2."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.filter(remainder(4) != 2), sample_rows)
    return predict(rows, model, ["doc_id"]).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
