"""Rates, intervals, grades, similarities and time arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Two-sided and one-sided normal quantiles at 95 %.
Z_TWO, Z_ONE = 1.959963984540054, 1.6449


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def percent(part, whole) -> Column:
    """Percent with 2 decimals; 0 of nothing is 0."""
    return F.coalesce(F.round(100.0 * F.try_divide(_c(part).cast("double"), _c(whole)), 2), F.lit(0.0))


def rate_or_null(part, whole) -> Column:
    """Percent with 2 decimals; null of nothing."""
    return F.round(100.0 * F.try_divide(_c(part).cast("double"), _c(whole)), 2)


def wilson(hits, n, z: float = Z_TWO) -> Column:
    """Struct (lo, hi) in percent, 2 decimals, within 0 to 100; null for n = 0."""
    p, m = F.try_divide(_c(hits).cast("double"), _c(n)), _c(n).cast("double")
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    cut = lambda x: F.round(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 2)
    return F.when(m > 0, F.struct(cut(mid - half).alias("lo"), cut(mid + half).alias("hi")))


def wilson_upper(hits, n, z: float = Z_ONE) -> Column:
    """The one-sided upper bound as a share; 1 for n = 0."""
    m = F.greatest(_c(n), F.lit(1)).cast("double")
    p = _c(hits) / m
    return F.when(_c(n) > 0, (p + z * z / (2 * m) + z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)).otherwise(F.lit(1.0))


def grade(score) -> Column:
    s = _c(score)
    return F.when(s.isNull(), "INCONCLUSIVE").when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")


def logistic(x) -> Column:
    x = _c(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def cosine_sparse(a, b) -> Column:
    """Cosine of maps from term to weight; 0 without common terms or weights."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.map_entries(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), lambda s, e: s + e["value"])
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.try_divide(dot, size(a) * size(b)), F.lit(0.0))


def cosine_dense(a, b) -> Column:
    """Cosine of arrays, each scaled by its largest component first, within -1 and 1; 0 for a zero vector."""
    plain = lambda v: F.transform(v, lambda x: x.cast("double"))
    scaled = lambda v: let(plain(v), lambda p: let(F.struct(p.alias("v"), F.array_max(F.transform(p, F.abs)).alias("most")), lambda s: F.transform(s["v"], lambda t: F.coalesce(F.try_divide(t, s["most"]), F.lit(0.0)))))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    cosine = lambda p: F.try_divide(dot(p["x"], p["y"]), F.sqrt(dot(p["x"], p["x"])) * F.sqrt(dot(p["y"], p["y"])))
    value = let(F.struct(scaled(_c(a)).alias("x"), scaled(_c(b)).alias("y")), cosine)
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), F.lit(0.0))


def jaccard(a, b) -> Column:
    """Exact Jaccard of arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))
    return F.coalesce(F.try_divide(both.cast("double"), either), F.lit(0.0))


def agreement(a, b) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, t: s + t) / F.size(_c(a))


def window_id(ts, seconds: int = 60) -> Column:
    return F.floor(F.unix_timestamp(_c(ts)) / seconds)


def retry_after(ts, seconds: int = 60) -> Column:
    return F.greatest(F.lit(seconds) - F.unix_timestamp(_c(ts)) % seconds, F.lit(1))


def month_bounds(ts, slot: int = 300) -> Column:
    """Struct (first, next, slots): the month's first day, the next month's, and its number of slots."""
    first = F.trunc(_c(ts), "month")
    after = F.add_months(first, 1)
    return F.struct(first.alias("first"), after.alias("next"), (F.datediff(after, first) * 86400 / slot).cast("long").alias("slots"))


def iso_utc(ts) -> Column:
    return F.date_format(F.date_trunc("second", _c(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_utc(text) -> Column:
    """Epoch seconds of whole-second UTC text; null for any other form."""
    t = _c(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def ordered_map(m) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(_c(m))))
