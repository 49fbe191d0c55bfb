"""Operator 11: fill-in-the-middle texts by rotating blocks of a byte buffer in place, and the way back.

Per text the cuts are scanned as byte positions of code points, the marks are put in front of the three
parts in one buffer, and blocks change places by three reversals (each block, then both together).
``restore`` finds the marks, turns the same rotation back and takes the marks out.

* plain:  the text as it is (empty, holding a mark, or not chosen)
* psm:    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm:    ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

Cuts and form come from a hash of the id alone, so reruns and retries agree. A null text counts as
empty; a null id hashes as an empty number; rows that repeat give repeated rows; other columns are not
read. Very long texts are handled one at a time, in about three times their size. Cuts may coincide:
parts of no length are kept as such. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.batches import text_slices, texts_of

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHOSEN_PERCENT, SPM_PERCENT = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"

FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
RESTORED = "doc_id long, restored string"


def rotate(buffer: np.ndarray, start: int, border: int, end: int) -> None:
    """Blocks [start, border) and [border, end) change places inside the buffer, by three reversals."""
    for a, b in ((start, border), (border, end), (start, end)):
        buffer[a:b] = buffer[a:b][::-1]


def _starts(data: np.ndarray) -> np.ndarray:
    """Byte position of every code point of UTF-8 text."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def draws(doc_id: int | None) -> list[int]:
    """h1 to h4 of an id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(text: bytes, h: list[int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    at = _starts(np.frombuffer(text, dtype=np.uint8))
    n = len(at)
    if not n or h[2] % 100 >= CHOSEN_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = (int(at[k]) if k < n else len(text) for k in (low, high))
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle = len(PREFIX) + first
    suffix = len(PREFIX) + second + len(MIDDLE)
    form = SPM if h[3] % 100 < SPM_PERCENT else PSM
    rotate(np.frombuffer(buffer, dtype=np.uint8), 0 if form == SPM else middle, suffix, len(buffer))
    return n, form, low, high - low, bytes(buffer)


def rebuild(output: bytes, form: str | None) -> bytes:
    """The text behind an output."""
    if form not in (PSM, SPM):
        return output
    buffer = bytearray(output)
    start, end = (0, buffer.index(PREFIX)) if form == SPM else (buffer.index(SUFFIX), buffer.index(MIDDLE))
    rotate(np.frombuffer(buffer, dtype=np.uint8), start, end, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        found = buffer.index(mark)
        del buffer[found : found + len(mark)]
    return bytes(buffer)


def _bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return texts_of(batch, column).cast(pa.large_binary()).to_pylist()


def _strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row with columns doc_id and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [arrange(text, draws(doc_id)) for doc_id, text in zip(ids, _bytes_of(batch, "text"), strict=True)]
            n, form, prefix, middle, output = (list(c) for c in zip(*rows, strict=True))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(output)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, FORMS)


def restore(rows: DataFrame) -> DataFrame:
    """All columns of rows (with form and output) and ``restored``, the text behind each output."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "output"):
            pairs = zip(_bytes_of(batch, "output"), batch.column("form").to_pylist(), strict=True)
            yield batch.append_column("restored", _strings([rebuild(output, form) for output, form in pairs]))

    return rows.mapInArrow(run, rows.withColumn("restored", F.lit("")).schema)
