"""Policies over rows: reasons, destinations, controls, lifecycle states, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reasons(**rules: Column) -> Column:
    """The names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def ordered(names: str | Column, order: list[str]) -> Column:
    """Distinct names in a fixed order."""
    n = F.col(names) if isinstance(names, str) else names
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(n, x))


def destination_allowed(listed: str | Column, destination: str | Column) -> Column:
    """Listed destinations hold regardless of case if they begin with 0x, and exactly otherwise."""
    d = F.col(destination) if isinstance(destination, str) else destination
    a = F.col(listed) if isinstance(listed, str) else listed
    return F.exists(a, lambda x: F.when(F.lower(x).startswith("0x"), F.lower(x) == F.lower(d)).otherwise(x == d))


def lifecycle(valid: Column, revoked: Column, expired: Column) -> Column:
    return F.when(~valid, "invalid").when(revoked, "revoked").when(expired, "stale").otherwise("active")


def coverage(matched: Column, expected: Column) -> Column:
    return F.when(matched > expected, "exceeds").when(matched == expected, "complete").when(matched >= 0.99 * expected, "nearly complete").otherwise("partial")


def keep_last(df: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the highest positions; a distributed top-k."""
    return df.orderBy(F.desc(by)).limit(most)


def keep_by_class(df: DataFrame, kind: str, by: str, always: str, bounded: str, most: int, budget: int) -> DataFrame:
    """All rows of class ``always``, the last ``most`` of class ``bounded``, and the last others within the budget left."""
    sure = df.where(F.col(kind) == always)
    some = keep_last(df.where(F.col(kind) == bounded), by, most)
    left = max(0, budget - sure.count() - some.count())
    return sure.unionByName(some).unionByName(keep_last(df.where(~F.col(kind).isin(always, bounded)), by, left))


def controls(classes: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, controls): the controls of a row's classes, by priority, each once. ``table``: (class, control, priority)."""
    j = classes.join(table, "class").groupBy(key, "control").agg(F.min("priority").alias("priority"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("priority", "control"))), lambda x: x["control"])
    return j.groupBy(key).agg(listed.alias("controls"))


def last_rank(w: str, order: str) -> Column:
    return F.row_number().over(W.partitionBy(w).orderBy(F.desc(order)))
