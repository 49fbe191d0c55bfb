"""The pipeline's stages on whole small tables."""

import re

import corpus_pipeline
from claimweave.checkpoints import new_folder
from claimweave.llm import secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "test-stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs
        if name != "pack_windows":
            assert docs.columns == columns and docs.schema == before.schema
        if name == "language_id":
            assert docs.count() == sum(bool(re.search(r"[^\W\d_]", r["text"])) for r in before.collect())
        if name == "near_duplicates":
            assert 0 < docs.count() < before.count() and docs.select("doc_id").distinct().count() == docs.count()
        if name == "secret_scan":
            assert docs.count() == before.count() and secrets.scan(docs).filter("size(spans) > 0").count() == 0
        if name == "mix_sources":
            assert 0.8 < docs.count() / before.count() < 1.3
    assert seen["pack_windows"].select("doc_id").distinct().count() == seen["mix_sources"].select("doc_id").distinct().count()


def test_odd_rows(spark, odd_docs, no_docs):
    """Texts in no language go, of repeated rows and copies one stays, all else comes through with all its columns."""
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    docs, seen = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "test-stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = seen[name] = spark.read.parquet(path)
        assert name == "pack_windows" or docs.columns == odd_docs.columns
    known = lambda *x: sorted([*x, None, None], key=repr)
    assert ids(seen["language_id"]) == known(1, 2, 6, 8, 8)
    assert ids(seen["near_duplicates"]) == ids(seen["secret_scan"]) == known(1, 6, 8)
    (eight,) = [r["text"] for r in seen["secret_scan"].collect() if r["doc_id"] == 8]
    assert "AKIA" not in eight and "<access>" in eight and eight.startswith("été")
    assert set(ids(seen["mix_sources"])) <= set(known(1, 6, 8)) and 6 in ids(seen["mix_sources"])
    assert set(ids(seen["pack_windows"])) == set(ids(seen["mix_sources"]))
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "test-stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0
