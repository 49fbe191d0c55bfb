"""Scoring arithmetic and date helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def logit(p: Column) -> Column:
    """Log-odds with the probability held inside [0.02, 0.98]."""
    c = clamp(p, 0.02, 0.98)
    return F.log(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def round_half_up(x: Column, digits: int = 3) -> Column:
    """Round with halves going toward plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def wilson_lower(positive: Column, n: Column, z: float = 1.96) -> Column:
    """Lower Wilson bound of a share; 0 where there is no sample."""
    n = n.cast("double")
    m = F.when(n > 0, n)
    p = positive / m
    z2 = z * z
    low = (p + z2 / (2 * m) - z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    return F.coalesce(low, F.lit(0.0))


def age_days(ts: Column, as_of: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(as_of) - micros(ts)) / F.lit(86_400_000_000.0)


def log2(x: Column) -> Column:
    return F.log(x) / math.log(2)


def parse_time(c: Column) -> Column:
    """Free-form time text to a timestamp, NULL when unreadable.

    ISO forms go through the cast; the other form is the weekday-month-day-clock-zone-year one.
    """
    rfc = F.regexp_replace(c, r"^[A-Za-z]{3},?\s+", "")
    return F.coalesce(
        c.try_cast("timestamp"),
        F.try_to_timestamp(rfc, F.lit("MMM dd HH:mm:ss Z yyyy")),
        F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss Z")),
    )
