"""Lenient JSON reads: bad text gives the fallback instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Strings of any length; the parser's own limit of 20 million characters would give NULL for the whole text.
WHOLE = {"maxStringLen": "2147483647"}


def parse_json(c: Column, as_type: str = "variant") -> Column:
    """Parsed JSON however long its strings are; NULL where it is not JSON or not of the type."""
    return F.from_json(c, as_type, WHOLE)


def json_get(c: Column, path: str, as_type: str, fallback: Column | None = None) -> Column:
    got = F.try_variant_get(F.try_parse_json(c), path, as_type)
    return F.coalesce(got, fallback) if fallback is not None else got
