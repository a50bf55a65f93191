"""Running sums and places over a whole table, without a window over all of its rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.sources.scratch import saved


def running(df: DataFrame, order: list[Column], sums: dict[str, str | Column]) -> DataFrame:
    """The rows with sums over all rows up to and including each, in an order that tells rows apart.

    Rows are sorted by ranges of the order and written; each range's sums are added up within it, and what stands before a
    range is added from a table of one row a range.
    """
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = saved(df.withColumns({"__range": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()}))
    each = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    whole = df.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in each.items()])
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    start = whole.select("__range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums])
    own = W.partitionBy("__range").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in each.items()}).join(F.broadcast(start), "__range")
    return out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop("__range", "__pos", *[f"__before_{n}" for n in sums])


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """The rows with their place, from 1, in an order that tells rows apart."""
    return running(df, order, {name: F.lit(1).cast("long")})
