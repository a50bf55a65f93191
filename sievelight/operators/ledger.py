"""Hash-chained logs: building, local verification, prefixes and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(*columns: str) -> Column:
    """JSON text of the columns in the order of their names, without spaces."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def entries(events: DataFrame, order: str, columns: list[str], by: str | None = None) -> DataFrame:
    """A log (seq from 1, entry) of events in an order, one log for each ``by``.

    Without ``by`` all rows pass through one window, as a single log demands; give a key where there are many logs.
    """
    w = (W.partitionBy(by) if by else W.partitionBy()).orderBy(order)
    return events.select(*([by] if by else []), F.row_number().over(w).cast("long").alias("seq"), canonical(*columns).alias("entry"))


def link(log: DataFrame, by: str | None = None) -> DataFrame:
    """prev_hash and record_hash: each entry carries the hash of the entry before it."""
    w = (W.partitionBy(by) if by else W.partitionBy()).orderBy("seq")
    h = F.sha2(F.col("entry"), 256)
    return log.withColumn("prev_hash", F.coalesce(F.lag(h).over(w), F.lit(GENESIS))).withColumn("record_hash", h)


def verify(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ok for each row (seq, entry, prev_hash): it names the hash of the row at seq - 1, or the genesis at 1.

    A join on the position instead of an ordered pass, as each row holds what it claims of the one before; so rows are
    checked in parallel even in a single log.
    """
    by = by or []
    before = log.select(*by, (F.col("seq") + 1).alias("seq"), F.sha2(F.col("entry"), 256).alias("is"))
    ok = F.when(F.col("seq") == 1, F.col("prev_hash") == GENESIS).otherwise(F.coalesce(F.col("prev_hash") == F.col("is"), F.lit(False)))
    return log.join(before, [*by, "seq"], "left").withColumn("ok", ok).drop("is")


def page(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The rows after a cursor, one more than the limit at most, to tell whether there is a next page."""
    return log.where(F.col("seq") > cursor).orderBy("seq").limit(limit + 1)
