"""Registry of named queries, and the canonical tables built from the driver's Parquet.

``BIND`` holds the canonical tables as SQL that both engines read alike; ``{name}`` refers to another
canonical table or to a driver table. Spark sees them as views, the SQL check as WITH clauses.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
BIND: dict[str, str] = {}
#: Canonical tables whose text for Spark depends on the data; the check always has that of ``BIND``.
READ: dict[str, Callable[[Tables], str]] = {}
BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
_REF = re.compile(r"\{([a-z][a-z0-9_]*)\}")
AS_OF = "2001-12-31 00:00:00"


TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


#: Session setting: partitions to hash text tables into, for small files of one split; unset, tables stay as read.
SPREAD = "spark.claimweave.textPartitions"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    asked = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(asked), *keys) if asked else df


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


class Tables:
    """Driver tables and canonical tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._open(name)
        return self._seen[name]

    def _open(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df
        return self.sql(READ[name](self) if name in READ else BIND[name])

    def sql(self, text: str) -> DataFrame:
        for ref in sorted(set(_REF.findall(text))):
            self[ref].createOrReplaceTempView(f"cw_{ref}")
        return self.spark.sql(_REF.sub(lambda m: f"cw_{m[1]}", text))


def check_sql(text: str) -> str:
    """Expand canonical tables into WITH clauses for the SQL check."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for ref in _REF.findall(sql):
            if ref in BIND and ref not in order:
                visit(BIND[ref])
                order.append(ref)

    visit(text)
    plain = lambda s: _counts(_REF.sub(lambda m: m[1], s))
    ctes = ", ".join(f"{n} AS ({plain(BIND[n])})" for n in order)
    body = plain(text).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[len('WITH'):].lstrip()}"
    return f"WITH {ctes} {body}"


def _counts(sql: str) -> str:
    """Write count_if(x) as a filtered count, which stays a 64-bit integer."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9:end - 1]}){sql[end:]}"
    return sql
