"""Streaming forms of the stateful operators. Event time, an hour of watermark; batch forms of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATE = "1 hour"


def tumbling(events: DataFrame, scope: str, client: str, limit: int, width: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """Counts by window, scope and client, and whether they are over the limit. Works on streams and tables."""
    e = events.withWatermark(ts, LATE) if events.isStreaming else events
    g = e.groupBy(F.window(ts, width).alias("w"), scope, client).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), scope, client, "n", (F.col("n") > limit).alias("over"))


def decisions(events: DataFrame, scope: str, client: str, limit: int, seconds: int = 60, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """For each event of a table: allowed if it is among the first ``limit`` of its window, itself included."""
    n = F.row_number().over(W.partitionBy(scope, client, F.floor(F.unix_timestamp(ts) / seconds)).orderBy(order))
    return events.select(order, (n <= limit).alias("allowed"))


def rolling(events: DataFrame, by: str, seconds: int = 86400, ts: str = "ts") -> DataFrame:
    """For each event of a table the number of events of its key in the ``seconds`` up to it, both ends included, and
    the number so far; the first is null until a whole period has been seen."""
    s = F.unix_timestamp(ts)
    period = W.partitionBy(by).orderBy("s").rangeBetween(-seconds, 0)
    e = events.withColumn("s", s)
    warm = F.col("s") - F.min("s").over(W.partitionBy(by)) >= seconds
    return e.select("event_id", F.when(warm, F.count("*").over(period)).alias("recent"), F.count("*").over(W.partitionBy(by).orderBy("s", "event_id")).alias("lifetime"))


def first_only(events: DataFrame, keys: list[str], ts: str = "ts", within: str = LATE) -> DataFrame:
    """Replay protection on a stream: the first event of each key; later ones within the time are dropped."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def replays(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The same on a table: whether an event repeats its key within ``seconds`` of the one before."""
    w = W.partitionBy(*keys).orderBy(ts, order)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return events.select(order, F.coalesce(gap <= seconds, F.lit(False)).alias("replay"))


def grants(payments: DataFrame, client: str, seconds: int = 600, ts: str = "ts") -> DataFrame:
    """Spans in which a client holds a grant that each payment renews for ``seconds``: payments at most so far apart join."""
    w = W.partitionBy(client).orderBy("s")
    p = payments.select(client, F.unix_timestamp(ts).alias("s"))
    p = p.withColumn("new", F.coalesce(F.col("s") - F.lag("s").over(w) >= seconds, F.lit(True)).cast("int"))
    p = p.withColumn("span", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return p.groupBy(client, "span").agg(F.min("s").alias("from"), (F.max("s") + seconds).alias("until"))


def bindings(claims: DataFrame, host: str, key: str, order: str = "event_id") -> DataFrame:
    """Trust on first use: for each claim whether it binds, matches the bound key, or differs from it."""
    w = W.partitionBy(host).orderBy(order)
    first = F.first(key).over(w.rowsBetween(W.unboundedPreceding, 0))
    n = F.row_number().over(w)
    return claims.select(order, F.when(n == 1, "bound").when(F.col(key) == first, "match").otherwise("changed").alias("state"))


def claim_status(claims: DataFrame, claim: str, candidate: str, order: str = "event_id") -> DataFrame:
    """pending for a claim's first event, duplicate after, not_candidate where there is no claim."""
    n = F.row_number().over(W.partitionBy(claim, candidate).orderBy(order))
    return claims.select(order, F.when(~F.col(candidate), "not_candidate").when(n == 1, "pending").otherwise("duplicate").alias("status"))


def concurrent(leases: DataFrame, by: str, start: str, seconds: int) -> DataFrame:
    """The most leases of ``seconds`` that a key held at once, from running sums over starts and ends."""
    s = leases.select(by, F.unix_timestamp(start).alias("t"))
    marks = s.withColumn("d", F.lit(1)).union(s.select(by, (F.col("t") + seconds).alias("t"), F.lit(-1)))
    run = F.sum("d").over(W.partitionBy(by).orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0))
    return marks.withColumn("run", run).groupBy(by).agg(F.max("run").alias("most"))


def monitor_state(samples: DataFrame, by: str, now: int, stale: int = 600, ts: str = "ts", ok: str = "ok") -> DataFrame:
    """ready, down or stale by the last sample of each key."""
    g = samples.groupBy(by).agg(F.max_by(ok, F.struct(ts, "event_id")).alias("last"), F.max(F.unix_timestamp(ts)).alias("at"))
    return g.select(by, F.when(F.lit(now) - F.col("at") > stale, "stale").when(F.col("last"), "ready").otherwise("down").alias("state"))
