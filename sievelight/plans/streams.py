"""Batch forms of the streaming operators, and the tumbling counts run as a stream over the same rows."""

from pyspark.sql import functions as F

from sievelight.sources.scratch import place
from sievelight.streaming import rates

from .base import query, table


def _events(spark, d):
    return table(spark, d, "events")


_SEC = "cast(floor(epoch(ts)) as bigint)"


@query("sm_tumbling", f"select {_SEC} // 86400 * 86400 as start, event_type, user_id, count(*) as n, count(*) > 2 as over from events group by all".replace("as over", 'as "over"'))
def sm_tumbling(spark, d):
    t = rates.tumbling(_events(spark, d), "event_type", "user_id", 2, "1 day")
    return t.select(F.unix_timestamp("start").alias("start"), "event_type", "user_id", "n", "over")


@query("sm_tumbling_stream", f"select {_SEC} // 86400 * 86400 as start, event_type, user_id, count(*) as n from events group by all")
def sm_tumbling_stream(spark, d):
    """The same counts through Structured Streaming, to the end of the rows there are. They stay in the stream's state, which
    executors hold and which is read as a table; a table of counts in the driver grows with the number of users."""
    rows, at = _events(spark, d), place(spark)
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if _is_dir(spark, f"{d}/events.parquet") else f"{d}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    # in this mode no window leaves the state
    out = rates.tumbling(stream, "event_type", "user_id", 2, "1 day").writeStream.outputMode("complete").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start()
    out.awaitTermination()
    state = spark.read.format("statestore").load(at)
    return state.select(F.unix_timestamp("key.window.start").alias("start"), "key.event_type", "key.user_id", F.col("value.count").alias("n"))


def _is_dir(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("sm_decisions", f"select event_id, row_number() over (partition by event_type, user_id, {_SEC} // 86400 order by event_id) <= 1 as allowed from events")
def sm_decisions(spark, d):
    return rates.decisions(_events(spark, d), "event_type", "user_id", 1, 86400)


@query("sm_rolling", f"with e as (select *, {_SEC} as s from events) select event_id, case when s - min(s) over (partition by user_id) >= 86400 then count(*) over (partition by user_id order by s range between 86400 preceding and current row) end as recent, count(*) over (partition by user_id order by s, event_id) as lifetime from e")
def sm_rolling(spark, d):
    return rates.rolling(_events(spark, d), "user_id")


@query("sm_nonce", f"select event_id, coalesce({_SEC} - lag({_SEC}) over (partition by user_id, event_type order by ts, event_id) <= 3600, false) as replay from events")
def sm_nonce(spark, d):
    return rates.replays(_events(spark, d), ["user_id", "event_type"], 3600)


@query("sm_feedback_dedupe", f"select event_id, coalesce({_SEC} - lag({_SEC}) over (partition by user_id, event_type order by ts, event_id) <= 90 * 86400, false) as replay from events")
def sm_feedback_dedupe(spark, d):
    return rates.replays(_events(spark, d), ["user_id", "event_type"], 90 * 86400)


@query("sm_ttl_grant", f'with p as (select user_id, {_SEC} as s from events), n as (select *, case when s - lag(s) over (partition by user_id order by s) < 43200 then 0 else 1 end as new from p), g as (select *, sum(new) over (partition by user_id order by s rows unbounded preceding) as span from n) select user_id, cast(span as bigint) as span, min(s) as "from", max(s) + 43200 as until from g group by 1, 2')
def sm_ttl_grant(spark, d):
    return rates.grants(_events(spark, d), "user_id", 43200)


@query("sm_lease", f"with m as (select user_id, {_SEC} as t, 1 as d from events union all select user_id, {_SEC} + 86400, -1 from events) select user_id, cast(max(run) as bigint) as most from (select user_id, sum(d) over (partition by user_id order by t, d rows unbounded preceding) as run from m) group by user_id")
def sm_lease(spark, d):
    return rates.concurrent(_events(spark, d), "user_id", "ts", 86400)


@query("sm_binding", "select event_id, case when row_number() over w = 1 then 'bound' when event_type = first_value(event_type) over w then 'match' else 'changed' end as state from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def sm_binding(spark, d):
    return rates.bindings(_events(spark, d), "user_id", "event_type")


@query("sm_claim_status", "select event_id, case when value < 50 then 'not_candidate' when row_number() over (partition by user_id, event_type, value >= 50 order by event_id) = 1 then 'pending' else 'duplicate' end as status from events")
def sm_claim_status(spark, d):
    e = _events(spark, d).select("event_id", F.concat_ws("/", "user_id", "event_type").alias("claim"), (F.col("value") >= 50).alias("candidate"))
    return rates.claim_status(e, "claim", "candidate")


@query("sm_monitor_state", f"select user_id, case when 1706500000 - max({_SEC}) > 86400 then 'stale' when arg_max(value > 50, (ts, event_id)) then 'ready' else 'down' end as state from events group by user_id")
def sm_monitor_state(spark, d):
    e = _events(spark, d).withColumn("ok", F.col("value") > 50)
    return rates.monitor_state(e, "user_id", 1706500000, 86400)


@query("sm_due", f"select user_id, max({_SEC}) + 86400 as due from events group by user_id having max({_SEC}) + 86400 <= 1706500000")
def sm_due(spark, d):
    g = _events(spark, d).groupBy("user_id").agg((F.max(F.unix_timestamp("ts")) + 86400).alias("due"))
    return g.where("due <= 1706500000")


@query("sm_metrics", "select event_type, count(*) as n, round(median(value), 6) as p50 from (select *, row_number() over (partition by event_type order by event_id desc) as rn from events) where rn <= 1024 group by event_type")
def sm_metrics(spark, d):
    from pyspark.sql import Window as W

    last = _events(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("event_id")))).where("rn <= 1024")
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("p50"))


@query("sm_log_append", "select user_id, count(*) as entries from events group by user_id")
def sm_log_append(spark, d):
    from sievelight.operators import ledger

    log = ledger.link(ledger.entries(_events(spark, d), "event_id", ["event_id", "event_type"], by="user_id"), by="user_id")
    return ledger.verify(log, ["user_id"]).where("ok").groupBy("user_id").agg(F.count("*").alias("entries"))
