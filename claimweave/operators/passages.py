"""Which of many passages stand in which of many texts, up to blanks, quote marks, stop width and case.

Texts and passages meet on few hashes instead of pairwise. A text is winnowed: of every ``window``
neighbouring hashes of ``size`` characters (of its comparison form) the least is an anchor. Every window
of a passage is a window of each text that holds it, so all anchors of a passage of ``size + window - 1``
characters or more are anchors of such a text: the rarest alone finds every candidate. Shorter passages
are looked up by their rarest run of ``SHORT`` characters, and those too short for a loose match by runs
of the text as it stands; texts are cut into such runs only if passages ask for them. Candidates are
verified, and located, like stored quotes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.checkpoints import cut
from claimweave.functions.text import match_normalize, trim_space
from claimweave.operators.grounding import MIN_NORMALIZED, locate

SIZE, WINDOW = 8, 9
#: Characters of the runs that shorter passages are looked up by.
SHORT = MIN_NORMALIZED
#: Hashes that a task gathers before it gives them out (a text's own may be more).
HELD = 1 << 17
_STEP = 0x9E3779B97F4A7C15


def _runs(text: str | None, size: int) -> np.ndarray:
    """A hash of every run of so many characters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ points[j : j + n]) * np.uint64(_STEP)
            out ^= out >> np.uint64(29)
    return out


def _anchors(value: str | None, size: int, window: int) -> np.ndarray:
    """Least hash of every ``window`` neighbouring runs, each once."""
    hashes = _runs(value, size)
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = hashes[: len(hashes) - window + 1]
    for j in range(1, window):
        least = np.minimum(least, hashes[j : j + len(least)])
    return np.unique(least).view(np.int64)


def _keyed(df: DataFrame, item: str, hashes: Callable[[str | None], np.ndarray]) -> DataFrame:
    """(item, key): the hashes of every ``form``, given out after some texts, so a task holds few beside its batch."""

    def run(batches):
        for batch in batches:
            ids, found, held = [], [], 0
            for i, value in enumerate(batch.column("form")):
                found.append(hashes(value.as_py()))
                ids.append(np.full(len(found[-1]), i))
                held += len(found[-1])
                if held >= HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(item).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(found))], names=[item, "key"])
                    ids, found, held = [], [], 0

    kind = df.schema[item].dataType.simpleString()
    return df.select(item, "form").mapInArrow(run, f"{item} {kind}, key long")


def anchored(df: DataFrame, item: str, size: int = SIZE, window: int = WINDOW) -> DataFrame:
    return _keyed(df, item, lambda v: _anchors(v, size, window))


def cut_up(df: DataFrame, item: str, *sizes: int) -> DataFrame:
    """(item, key): hashes of all runs of the given sizes, each once."""
    return _keyed(df, item, lambda v: np.unique(np.concatenate([_runs(v, s) for s in sizes])).view(np.int64))


def _candidates(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id) of texts that hold the rarest key of a passage, from (item_id, key) and (doc_id, key)."""
    asked = cut(asked)
    held = cut(texts.join(asked.select("key").distinct(), "key"))
    spread = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(spread, "key", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "key")).alias("r"))
    return rarest.select("item_id", F.col("r.key").alias("key")).join(held, "key").select("item_id", "doc_id").distinct()


def passages_in_texts(passages: DataFrame, texts: DataFrame, size: int = SIZE, window: int = WINDOW) -> DataFrame:
    """(item_id, doc_id, method, char_start, char_end) of every passage (item_id, text) in every text (doc_id, text).

    Null and blank passages stand nowhere; ids are taken as unique on both sides. Of several places the
    first counts.
    """
    quoted = passages.select("item_id", F.col("text").alias("quote"), trim_space(F.col("text")).alias("q")).filter("q <> ''")
    quoted = cut(quoted.withColumn("form", match_normalize(F.col("q"))))
    kept = texts.filter(F.col("text").isNotNull()).select("doc_id", "text")
    form = match_normalize(F.col("text"))
    chars = F.length("form")
    least = size + window - 1
    forms = kept.select("doc_id", form.alias("form"))
    found = _candidates(anchored(quoted.filter(chars >= least), "item_id", size, window), anchored(forms, "doc_id", size, window))
    short = quoted.filter((chars < least) & (chars >= SHORT))
    if not short.isEmpty():
        found = found.unionByName(_candidates(cut_up(short, "item_id", SHORT), cut_up(forms, "doc_id", SHORT)))
    tiny = quoted.filter(chars < SHORT)
    if not tiny.isEmpty():
        # the longest runs of up to three characters that the passage has; exact matches only
        own = tiny.select("item_id", F.col("q").alias("form"))
        n = F.length("form")
        asked = cut_up(own.filter(n >= 3), "item_id", 3).unionByName(cut_up(own.filter(n == 2), "item_id", 2)).unionByName(cut_up(own.filter(n < 2), "item_id", 1))
        found = found.unionByName(_candidates(asked, cut_up(kept.select("doc_id", F.col("text").alias("form")), "doc_id", 1, 2, 3)))
    pairs = found.join(quoted.select("item_id", "quote"), "item_id").join(kept, "doc_id")
    return locate(pairs).filter("ok").select("item_id", "doc_id", "method", "char_start", "char_end")
