"""Every registered query beside its SQL check on the smallest data; CHECK_ONLY=name,name runs some."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from claimweave.plans.catalog import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in QUERIES if not os.environ.get("CHECK_ONLY") or n in os.environ["CHECK_ONLY"].split(",")]


def test_every_query_has_a_check():
    assert set(QUERIES) == set(entry.oracle_sql()) & set(QUERIES)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    from compare import compare

    assert compare(spark, FOLDER, name).startswith("ok")


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver data not present")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
