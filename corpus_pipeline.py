"""A corpus pipeline over the table ``documents``: each stage works on all that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns the pieces of the
packed token sequences. Between stages the rows are written as Parquet to the shared folder and read
again.

Null and empty texts and texts without a letter are in no language and go at the first stage. Repeated
rows are near duplicates: one stays. Rows with null ids stay rows of their own unless their texts are
alike. Other nulls are kept (a null source is a source of its own in the mix, a null language is filled
in). Ties go to the smaller id, among null ids to the smaller hash of the text. Very long texts pass
whole. Further columns, whatever their names, go along to the last stage. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.checkpoints import new_folder
from claimweave.llm import jaccard_join, languages, mixing, packing, secrets
from claimweave.llm.queries import byte_bpe, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in no language (none, or no letter) go; a missing language is filled in."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = languages.fit(rows.filter(languages.remainder(4) != 2))
    free = "_" * (1 + max(map(len, docs.columns)))  # no column has these names
    judged = languages.predict(docs, model, docs.columns, (free + "l", free + "s"))
    kept = judged.filter(F.col(free + "l") != languages.UNDECIDED)
    return kept.withColumn("lang", F.coalesce("lang", free + "l")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 80 % or more, the document with the smallest id stays."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by their kind in angle brackets."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words, to the nearest whole copy (none if less than half)."""
    return mixing.copies(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # after four stages the workers and the JVM already hold much of an executor, so fewer words are kept here
    return packing.pack(docs, byte_bpe(), keep_words=250_000)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: Learned models and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
