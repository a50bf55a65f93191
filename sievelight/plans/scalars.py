"""Queries of rates, intervals, similarities and time arithmetic."""

from pyspark.sql import functions as F

from sievelight.functions import stats as st

from .base import query, table

_BY_TYPE = "select event_type, count(*) as n, count(*) filter (where value > 50) as hits from events group by event_type union all select 'none', 0, 0"


def _by_type(spark, d):
    got = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
    return got.union(spark.sql("select 'none', 0L, 0L"))


@query("fn_window_id", "select event_id, cast(floor(epoch(ts) / 60) as bigint) as window_id from events")
def fn_window_id(spark, d):
    return table(spark, d, "events").select("event_id", st.window_id("ts").alias("window_id"))


@query("fn_retry_after", "select event_id, 60 - cast(floor(epoch(ts)) as bigint) % 60 as retry_after from events")
def fn_retry_after(spark, d):
    return table(spark, d, "events").select("event_id", st.retry_after("ts").alias("retry_after"))


@query("fn_month_bounds", "select distinct strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as first, strftime(date_trunc('month', o_orderdate) + interval 1 month, '%Y-%m-%d') as next, cast(date_diff('day', date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + interval 1 month) * 288 as bigint) as slots from orders")
def fn_month_bounds(spark, d):
    m = table(spark, d, "orders").select(st.month_bounds("o_orderdate").alias("m")).distinct()
    return m.select(F.date_format("m.first", "yyyy-MM-dd").alias("first"), F.date_format("m.next", "yyyy-MM-dd").alias("next"), "m.slots")


@query("fn_utc", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, cast(floor(epoch(ts)) as bigint) as seconds, cast(null as bigint) as bad from events")
def fn_utc(spark, d):
    e = table(spark, d, "events").select("event_id", st.iso_utc("ts").alias("utc"))
    return e.select("event_id", "utc", st.parse_utc("utc").alias("seconds"), st.parse_utc(F.concat("utc", F.lit("+1"))).alias("bad"))


@query("fn_wilson_ci", f"""with t as ({_BY_TYPE}), p as (select *, case when n > 0 then hits / cast(n as double) end as p, 1.959963984540054 as z from t where n > 0)
select event_type, round(100 * greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 2) as lo, round(100 * least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 2) as hi from p union all select 'none', null, null""".replace("z*z/n", "z*z/cast(n as double)").replace("1.959963984540054 as z", "cast(1.959963984540054 as double) as z"))
def fn_wilson_ci(spark, d):
    return _by_type(spark, d).withColumn("w", st.wilson("hits", "n")).select("event_type", "w.lo", "w.hi")


@query("fn_wilson_ub", f"with t as ({_BY_TYPE}), p as (select *, cast(1.6449 as double) as z, cast(greatest(n, 1) as double) as m from t) select event_type, round(case when n > 0 then (hits/m + z*z/(2*m) + z*sqrt(hits/m*(1-hits/m)/m + z*z/(4*m*m))) / (1 + z*z/m) else 1 end, 9) as upper from p")
def fn_wilson_ub(spark, d):
    return _by_type(spark, d).select("event_type", F.round(st.wilson_upper("hits", "n"), 9).alias("upper"))


@query("fn_percent", f"select event_type, coalesce(round(100 * cast(hits as double) / nullif(n, 0), 2), 0) as percent from ({_BY_TYPE})")
def fn_percent(spark, d):
    return _by_type(spark, d).select("event_type", st.percent("hits", "n").alias("percent"))


@query("fn_rate_null", f"select event_type, round(100 * cast(hits as double) / nullif(n, 0), 2) as rate from ({_BY_TYPE})")
def fn_rate_null(spark, d):
    return _by_type(spark, d).select("event_type", st.rate_or_null("hits", "n").alias("rate"))


_GRADE = "case when {0} is null then 'INCONCLUSIVE' when {0} >= 90 then 'A' when {0} >= 80 then 'B' when {0} >= 70 then 'C' when {0} >= 60 then 'D' else 'F' end"


@query("fn_grade", f"select event_id, {_GRADE.format('value')} as grade from events union all select -1, {_GRADE.format('cast(null as double)')}")
def fn_grade(spark, d):
    e = table(spark, d, "events").select("event_id", "value").union(spark.sql("select -1L, cast(null as double)"))
    return e.select("event_id", st.grade("value").alias("grade"))


@query("fn_logistic", "select event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) as p from events")
def fn_logistic(spark, d):
    return table(spark, d, "events").select("event_id", F.round(st.logistic((F.col("value") - 50) / 10), 9).alias("p"))


_TF = "select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents where doc_id < {}) group by doc_id, w"


def _tf(spark, d, most):
    w = table(spark, d, "documents").where(F.col("doc_id") < most).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return w.groupBy("doc_id", "w").agg(F.count("*").cast("double").alias("n"))


@query("fn_cos_sparse", f"""with i as (select item_id, w, count(*) as n from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark) group by item_id, w),
size as (select item_id, sqrt(sum(n*n)) as s from i group by item_id)
select a.item_id, b.item_id as other, round(coalesce((select sum(x.n*y.n) from i x join i y on x.w = y.w where x.item_id = a.item_id and y.item_id = b.item_id), 0) / (a.s * b.s), 9) as cosine from size a join size b on b.item_id = a.item_id + 1""")
def fn_cos_sparse(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    v = w.groupBy("item_id", "w").agg(F.count("*").cast("double").alias("n")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("v"))
    pair = v.join(v.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("v").alias("u")), "item_id")
    return pair.select("item_id", "other", F.round(st.cosine_sparse("v", "u"), 9).alias("cosine"))


@query("fn_cos_dense", "select a.vec_id, b.vec_id as other, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def fn_cos_dense(spark, d):
    e = table(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("u"))
    return e.join(o, "vec_id").select("vec_id", "other", F.round(st.cosine_dense("embedding", "u"), 9).alias("cosine"))


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query("fn_jaccard", f"with w as (select doc_id, {_WORDS} as s from documents) select a.doc_id, round(coalesce(cast(len(list_intersect(a.s, b.s)) as double) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), 0), 9) as jaccard from w a join w b on b.doc_id = a.doc_id + 1")
def fn_jaccard(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("s"))
    return w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id").select("doc_id", F.round(st.jaccard("s", "t"), 9).alias("jaccard"))


@query("fn_jaccard_est", "select a.vec_id, list_sum(list_transform(range(1, 65), lambda i: case when (a.embedding[i] > 0) = (b.embedding[i] > 0) then 1 else 0 end)) / 64.0 as agreement from embeddings a join embeddings b on b.vec_id = a.vec_id + 1".replace("/ 64.0", "/ cast(64 as double)"))
def fn_jaccard_est(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("s"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t")), "vec_id").select("vec_id", st.agreement("s", "t").alias("agreement"))


@query("fn_dedupe_order", "select user_id, string_agg(event_type, ',' order by first) as types from (select user_id, event_type, min(event_id) as first from events group by user_id, event_type) group by user_id")
def fn_dedupe_order(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("types"))


@query("fn_map_sort", "select user_id, string_agg(event_type || '=' || n, ';' order by event_type) as policy from (select user_id, lower(event_type) as event_type, count(*) as n from events group by 1, 2) group by user_id")
def fn_map_sort(spark, d):
    n = table(spark, d, "events").groupBy("user_id", F.lower("event_type").alias("t")).agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(st.ordered_map(F.map_from_entries(F.collect_list(F.struct("t", "n")))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("policy"))
