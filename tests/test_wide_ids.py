"""Order keys so large that evidence ids no longer fit a long: scores and conflicts stay as with small ones."""

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimweave.plans.canonical import BIND, wide_stances
from claimweave.plans.registry import BASE, Tables

FOLDER = "/root/testdata/sf0.001"
SHIFT = 54_000_000
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver data not present")


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    for name in BASE:
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        for key in {"l_orderkey", "o_orderkey"} & set(df.columns):
            df = df.withColumn(key, F.col(key) + SHIFT)
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(spark, folder, name, shift=0):
    ids = {"claim_id", "opponent", "claim_a", "claim_b"} if name in ("value_conflicts", "conflict_open") else set()
    df = entry.queries()[name](spark, folder)
    return sorted((tuple(int(r[c]) - shift if c in ids else r[c] for c in df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["value_conflicts", "conflict_open", "score_facts", "score_breakdown", "rescore_disputed", "incremental_scores"])
def test_wide_ids_change_no_result(spark, shifted, name):
    want = rows(spark, FOLDER, name)
    assert want and rows(spark, shifted, name, SHIFT * 10**12) == want


def test_ids_are_long_where_they_fit(spark, shifted):
    assert wide_stances(Tables(spark, FOLDER)) == BIND["stances"]
    assert dict(Tables(spark, FOLDER).evidence.dtypes)["evidence_id"] == "bigint"
    top = Tables(spark, shifted).evidence.agg(F.max("evidence_id")).first()[0]
    assert isinstance(top, Decimal) and top > 2**63
