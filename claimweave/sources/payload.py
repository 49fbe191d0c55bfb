"""Nested JSON payloads of unknown shape.

Finding objects at unknown depth is the one thing here that column expressions cannot say, so a small
Arrow-batched helper walks each payload; everything around it stays in Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType


LD_JSON = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def _walk(root) -> Iterator:
    """Every object of a payload, parents before children, in document order."""
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            yield node
            todo.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            todo.extend(reversed(node))


def _load(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _dump(node) -> str:
    return json.dumps(node, ensure_ascii=False, separators=(",", ":"))


def objects_with_key(c: Column, key: str) -> Column:
    """JSON texts of the objects that hold ``key`` anywhere in the payload."""

    @F.pandas_udf(ArrayType(StringType()))
    def find(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: [_dump(o) for o in _walk(_load(p)) if key in o] if p and key in p else [])

    return find(c)


def array_with_key(c: Column, key: str) -> Column:
    """JSON texts of the items of the first array whose first item holds ``key``; NULL if there is none."""

    @F.pandas_udf(ArrayType(StringType()))
    def find(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: _first_array(_load(p), key))

    return find(c)


def _first_array(root, key: str):
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            if node and isinstance(node[0], dict) and key in node[0]:
                return [_dump(o) for o in node]
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            todo.extend(reversed(list(node.values())))
    return None


def json_ld_rating(pages: DataFrame) -> DataFrame:
    """Aggregate rating of each page from its embedded JSON-LD: first block, first object that has one."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(LD_JSON), F.lit(1))).alias("block", "body"))
    rated = blocks.select("page_id", "block", F.posexplode(objects_with_key(F.col("body"), "aggregateRating")).alias("pos", "obj"))
    rated = rated.filter(F.expr("schema_of_variant(try_variant_get(try_parse_json(obj), '$.aggregateRating', 'variant'))").startswith("OBJECT"))
    first = rated.groupBy("page_id").agg(F.min_by("obj", F.struct("block", "pos")).alias("obj"))
    v = F.try_parse_json("obj")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    genres = F.coalesce(F.array_join(get("$.genre", "array<string>"), "、"), get("$.genre"))
    return first.select(
        "page_id",
        get("$.name").alias("name"),
        get("$.aggregateRating.ratingValue").alias("rating_value"),
        F.coalesce(get("$.aggregateRating.bestRating"), F.lit("10")).alias("best_rating"),
        F.coalesce(get("$.aggregateRating.ratingCount"), F.lit("0")).alias("rating_count"),
        genres.alias("genre"),
    ).filter(F.col("rating_value").isNotNull() & ~F.col("rating_value").isin("0", ""))


def rating_record(rated: DataFrame, project_name: str = "name") -> DataFrame:
    """Labelled text lines of an aggregate rating, ready for fact extraction."""
    shown = F.coalesce(F.col("name"), F.col(project_name))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("游戏名称: "), shown),
        F.concat(F.lit("TapTap评分: "), "rating_value", F.lit("/"), "best_rating", F.lit("（"), "rating_count", F.lit("个评分）")),
        F.when(F.coalesce("genre", F.lit("")) != "", F.concat(F.lit("类型: "), "genre")),
    )
    return rated.withColumns(
        {
            "text": text,
            "source_type": F.lit("store_metadata"),
            "owner_key": F.lit("taptap:aggregate"),
            "authority_prior": F.lit(0.75),
            "doc_type": F.lit("api_record"),
        }
    )
