"""Queries of joins, aggregates, ordered operators, sorts and set operations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions import stats as st
from sievelight.operators import ledger, metrics
from sievelight.operators.running import numbered
from sievelight.sources.scratch import saved

from .base import query, table

# --- joins -----------------------------------------------------------------------------------------------------


@query("jn_reprobe", "select o_orderkey, c_custkey, row_number() over (order by case when o_orderkey % 7 = 0 then null else o_orderdate end nulls first, o_orderkey) as queue from orders join customer on o_custkey = c_custkey where o_orderstatus in ('O', 'P') and c_custkey % 5 <> 0")
def jn_reprobe(spark, d):
    a = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).withColumn("probed", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")))
    b = table(spark, d, "customer").where("c_custkey % 5 <> 0")
    j = a.join(b, F.col("o_custkey") == F.col("c_custkey"))
    return numbered(j.select("o_orderkey", "c_custkey", "probed"), [F.asc_nulls_first("probed"), F.asc("o_orderkey")], "queue").select("o_orderkey", "c_custkey", F.col("queue").cast("int").alias("queue"))


@query("jn_lineage", "select l_orderkey, l_linenumber, o_orderkey is null as missing, o_orderstatus from lineitem left join (select * from orders where o_orderkey % 11 <> 0) o on l_orderkey = o_orderkey")
def jn_lineage(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", F.col("o_orderkey").isNull().alias("missing"), "o_orderstatus")


@query("jn_log_binding", "select a.event_id, case when b.event_type <> a.event_type then 'event' when b.user_id <> a.user_id then 'identity' when b.ts < a.ts then 'time' else 'ok' end as binding from events a join events b on b.event_id = a.event_id + 1")
def jn_log_binding(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("t2"), F.col("user_id").alias("u2"), F.col("ts").alias("ts2"))
    how = F.when(F.col("t2") != F.col("event_type"), "event").when(F.col("u2") != F.col("user_id"), "identity").when(F.col("ts2") < F.col("ts"), "time").otherwise("ok")
    return e.join(b, "event_id").select("event_id", how.alias("binding"))


@query("jn_revocation", "select c_custkey, case when r.o_custkey is not null then 'revoked' when c_acctbal < 0 then 'stale' else 'active' end as status from customer left join (select distinct o_custkey from orders where o_orderstatus = 'P') r on r.o_custkey = c_custkey")
def jn_revocation(spark, d):
    r = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    c = table(spark, d, "customer").join(r, F.col("c_custkey") == F.col("k"), "left")
    return c.select("c_custkey", F.when(F.col("k").isNotNull(), "revoked").when(F.col("c_acctbal") < 0, "stale").otherwise("active").alias("status"))


@query("jn_key_asof", "select o_orderkey, exists(select 1 from nation where cast(n_nationkey as bigint) * 600000 >= o_orderkey * 10) as accepted from orders")
def jn_key_asof(spark, d):
    # accepted if any key lasts at least as long: the longest one decides, so one value replaces the range join
    last = table(spark, d, "nation").agg(F.max(F.col("n_nationkey").cast("long") * 600000).alias("last"))
    return table(spark, d, "orders").crossJoin(F.broadcast(last)).select("o_orderkey", F.coalesce(F.col("last") >= F.col("o_orderkey") * 10, F.lit(False)).alias("accepted"))


_HOST = "regexp_extract(lower(url), '://([^/?#]*)', 1)"


@query("jn_badges", f"with p as (select page_id, url, {_HOST} as host from pages), exact as (select a.page_id, b.page_id as badge, 2 as version from p a join p b on a.url = b.url and b.page_id % 3 = 0), host as (select a.page_id, b.page_id as badge, 1 as version from p a join p b on a.host = b.host and a.url <> b.url and b.page_id % 3 = 1) select * from exact union all select * from host")
def jn_badges(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1).alias("host"))
    b = p.toDF("badge", "url2", "host2")
    exact = p.join(b.where("badge % 3 = 0"), F.col("url") == F.col("url2")).select("page_id", "badge", F.lit(2).alias("version"))
    host = p.join(b.where("badge % 3 = 1"), (F.col("host") == F.col("host2")) & (F.col("url") != F.col("url2"))).select("page_id", "badge", F.lit(1).alias("version"))
    return exact.unionByName(host)


@query("jn_attest", f"select p.page_id, count(distinct a.c_custkey) as attestations from (select page_id, {_HOST} as host from pages) p join customer a on a.c_custkey % 250 = length(p.host) group by p.page_id")
def jn_attest(spark, d):
    """Customers are counted once for each length; one has a single length, so a page's counts add up without the pairs."""
    p = table(spark, d, "pages").select("page_id", F.length(F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1)).alias("n")).distinct()
    a = table(spark, d, "customer").select((F.col("c_custkey") % 250).alias("n"), "c_custkey")
    a = a.groupBy("n").agg(F.countDistinct("c_custkey").alias("customers"))  # 499 rows at most
    return p.join(F.broadcast(a), "n").groupBy("page_id").agg(F.sum("customers").alias("attestations"))


@query("jn_membership", "select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 300000) as audited, c_custkey in (select o_custkey from orders where o_orderstatus = 'P') as attested from customer")
def jn_membership(spark, d):
    o = table(spark, d, "orders")
    ids = lambda cond, name: o.where(cond).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn(name, F.lit(True))
    c = table(spark, d, "customer").join(ids("o_totalprice > 300000", "a"), "c_custkey", "left").join(ids("o_orderstatus = 'P'", "b"), "c_custkey", "left")
    return c.select("c_custkey", F.col("a").isNotNull().alias("audited"), F.col("b").isNotNull().alias("attested"))


_RATE = "select event_type, round(100 * cast(count(*) filter (where value > 50) as double) / count(*), 2) as rate from events where event_id % 2 = {0} and not (event_type = 'view' and {0} = 1) group by event_type"


@query("jn_delta", f"select a.event_type, a.rate as now, b.rate as before, round(a.rate - b.rate, 2) as delta from ({_RATE.format(0)}) a join ({_RATE.format(1)}) b on a.event_type = b.event_type")
def jn_delta(spark, d):
    def run(k):
        e = table(spark, d, "events").where(f"event_id % 2 = {k} and not (event_type = 'view' and {k} = 1)")
        return e.groupBy("event_type").agg(st.rate_or_null(F.count_if(F.col("value") > 50), F.count("*")).alias("rate"))

    return run(0).toDF("event_type", "now").join(run(1).toDF("event_type", "before"), "event_type").withColumn("delta", F.round(F.col("now") - F.col("before"), 2))


_CANON = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("jn_occupied", f"with r as (select doc_id, {_CANON} as c from documents), old as (select distinct c from r where doc_id % 4 = 0) select doc_id, c in (select c from old) as occupied from r where doc_id % 4 <> 0")
def jn_occupied(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("c"))
    old = r.where("doc_id % 4 = 0").select(F.col("c").alias("o")).distinct()
    return r.where("doc_id % 4 <> 0").join(old, F.col("c") == F.col("o"), "left").select("doc_id", F.col("o").isNotNull().alias("occupied"))


@query("jn_equivalence", "with w as (select doc_id % 2 as side, unnest(list_distinct(string_split(lower(text), ' '))) as form from documents) select form, count(*) as n from w where form in (select form from w where side = 0) and side = 1 group by form")
def jn_equivalence(spark, d):
    w = table(spark, d, "documents").select((F.col("doc_id") % 2).alias("side"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("form"))
    return w.where("side = 1").groupBy("form").agg(F.count("*").alias("n")).join(w.where("side = 0").select("form").distinct(), "form", "left_semi")


@query("jn_contain_text", "select d.doc_id, contains(lower(d.text), lower(substr(e.text, 3, 12))) as occurs from documents d join documents e on e.doc_id = d.doc_id - d.doc_id % 2")
def jn_contain_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    e = t.select(F.col("doc_id").alias("k"), F.substring("text", 3, 12).alias("part"))
    return t.withColumn("k", F.col("doc_id") - F.col("doc_id") % 2).join(e, "k").select("doc_id", F.contains("text", "part").alias("occurs"))


@query("jn_anchor", "with a as (select row_number() over (order by event_id) as idx, event_id as seq, sha256(cast(event_id as varchar) || event_type) as head from events where event_id % 50 = 0) select a.idx, a.seq, a.head = sha256(cast(e.event_id as varchar) || e.event_type) as matches, a.seq > coalesce(lag(a.seq) over (order by a.idx), -1) as rising from a join events e on e.event_id = a.seq")
def jn_anchor(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256).alias("is"))
    a = saved(numbered(e.where("seq % 50 = 0").select("seq", F.col("is").alias("head")), [F.asc("seq")], "idx"))
    a = a.join(a.select((F.col("idx") + 1).alias("idx"), F.col("seq").alias("last")), "idx", "left")
    rising = F.col("seq") > F.coalesce("last", F.lit(-1))
    return a.join(e, "seq").select(F.col("idx").cast("int").alias("idx"), "seq", (F.col("head") == F.col("is")).alias("matches"), rising.alias("rising"))


@query("jn_findings", "select * from (select m.event_type, e.event_id, row_number() over (partition by m.event_type order by e.event_id) as nth from (select event_type from events group by event_type having count(*) filter (where value > 90) > 10) m join events e on e.event_type = m.event_type where e.value < 20) where nth <= 5")
def jn_findings(spark, d):
    e = table(spark, d, "events")
    missed = e.groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("n")).where("n > 10").select("event_type")
    j = e.where("value < 20").join(missed, "event_type")
    return j.select("event_type", "event_id", F.row_number().over(W.partitionBy("event_type").orderBy("event_id")).alias("nth")).where("nth <= 5")


# --- aggregates ------------------------------------------------------------------------------------------------

_CASES = "select d.doc_id, d.lang as category, q.quality = 1 as attack, cast(d.n_chars % 997 as double) / 997 as score, d.source from documents d join labels q on q.doc_id = d.doc_id"


def _cases(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return j.select("doc_id", F.col("lang").alias("category"), (F.col("quality") == 1).alias("attack"), ((F.col("n_chars") % 997).cast("double") / 997).alias("score"), "source")


@query("ag_recall", f"select category, count(*) filter (where attack) as cases, count(*) filter (where attack and score >= 0.5) as detected, coalesce(round(100 * cast(count(*) filter (where attack and score >= 0.5) as double) / nullif(count(*) filter (where attack), 0), 2), 0) as recall, coalesce(string_agg(case when attack and score < 0.5 then cast(doc_id as varchar) end, ',' order by doc_id), '') as missed from ({_CASES}) group by category")
def ag_recall(spark, d):
    hit, miss = F.col("attack") & (F.col("score") >= 0.5), F.when(F.col("attack") & (F.col("score") < 0.5), F.col("doc_id"))
    g = _cases(spark, d).groupBy("category").agg(F.count_if("attack").alias("cases"), F.count_if(hit).alias("detected"), F.array_join(F.transform(F.array_sort(F.collect_list(miss)), lambda x: x.cast("string")), ",").alias("missed"))
    return g.select("category", "cases", "detected", st.percent("detected", "cases").alias("recall"), "missed")


@query("ag_recall_total", f"select category, grouping(category) as total, count(*) filter (where attack) as cases, count(*) filter (where attack and score >= 0.5) as detected from ({_CASES}) group by rollup(category)")
def ag_recall_total(spark, d):
    return _cases(spark, d).rollup("category").agg(F.grouping("category").cast("long").alias("total"), F.count_if("attack").alias("cases"), F.count_if(F.col("attack") & (F.col("score") >= 0.5)).alias("detected"))


@query("ag_depths", f"select depth, category, count(*) as cases, count(*) filter (where score >= cut) as detected from ({_CASES}), (values ('fast', cast(0.6 as double)), ('thorough', cast(0.3 as double))) v(depth, cut) group by grouping sets ((depth), (depth, category))")
def ag_depths(spark, d):
    depths = F.explode(F.array(F.struct(F.lit("fast").alias("depth"), F.lit(0.6).alias("cut")), F.struct(F.lit("thorough").alias("depth"), F.lit(0.3).alias("cut"))))
    c = _cases(spark, d).withColumn("v", depths).select("v.depth", "v.cut", "category", "score")
    g = c.groupingSets([[F.col("depth")], [F.col("depth"), F.col("category")]], "depth", "category")
    return g.agg(F.count("*").alias("cases"), F.count_if(F.col("score") >= F.col("cut")).alias("detected"))


@query("ag_fp", f"select cause, count(*) as n, round(100 * cast(count(*) as double) / (select count(*) from ({_CASES}) where not attack), 2) as share from (select unnest(case when score > 0.8 then ['high', 'any'] when score > 0.4 then ['any'] else [] end) as cause from ({_CASES}) where not attack) group by cause")
def ag_fp(spark, d):
    b = _cases(spark, d).where("not attack")
    causes = F.expr("case when score > 0.8 then array('high', 'any') when score > 0.4 then array('any') else cast(array() as array<string>) end")
    return b.select(F.explode(causes).alias("cause")).groupBy("cause").agg(F.count("*").alias("n")).crossJoin(F.broadcast(b.agg(F.count("*").alias("all")))).select("cause", "n", st.rate_or_null("n", "all").alias("share"))


@query("ag_variants", "with u as (select user_id, list_distinct(list(event_type)) as seen from events group by user_id) select user_id % 5 as class, count(*) as n, count(*) filter (where list_has_all(seen, ['click', 'view', 'purchase'])) as detected from u group by rollup(user_id % 5)")
def ag_variants(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    whole = F.size(F.array_except(F.array(*[F.lit(x) for x in ("click", "view", "purchase")]), "seen")) == 0
    return u.withColumn("class", F.col("user_id") % 5).rollup("class").agg(F.count("*").alias("n"), F.count_if(whole).alias("detected"))


@query("ag_class_findings", "select event_type, count(*) as total, count(*) filter (where value > 50) as blocked, row_number() over (order by min(event_id)) as nth from events group by event_type")
def ag_class_findings(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("blocked"), F.min("event_id").alias("first"))
    return g.select("event_type", "total", "blocked", F.row_number().over(W.orderBy("first")).alias("nth"))


_GRADE = "case when {0} is null then 'INCONCLUSIVE' when {0} >= 90 then 'A' when {0} >= 80 then 'B' when {0} >= 70 then 'C' when {0} >= 60 then 'D' else 'F' end"


@query("ag_audit_score", "with p as (select user_id, count(*) filter (where value is not null) as conclusive, count(*) filter (where value > 25) as blocked, count(*) filter (where event_type = 'view' and value > 95) = 0 as live, coalesce(string_agg(distinct case when value <= 25 then event_type end, ',' order by case when value <= 25 then event_type end), '') as missed from events group by user_id), s as (select *, case when live and conclusive > 0 then round(100 * cast(blocked as double) / conclusive, 2) end as score from p) select user_id, score, missed, " + _GRADE.format("score") + " as grade from s")
def ag_audit_score(spark, d):
    v = F.col("value")
    p = table(spark, d, "events").groupBy("user_id").agg(F.count("value").alias("conclusive"), F.count_if(v > 25).alias("blocked"), (F.count_if((F.col("event_type") == "view") & (v > 95)) == 0).alias("live"), F.array_join(F.array_sort(F.collect_set(F.when(v <= 25, F.col("event_type")))), ",").alias("missed"))
    s = p.withColumn("score", F.when(F.col("live"), st.rate_or_null("blocked", "conclusive")))
    return s.select("user_id", "score", "missed", st.grade("score").alias("grade"))


_VCLASS = "select event_type, count(*) filter (where value >= 50) as detected, count(*) filter (where value < 50 and value >= 10) as missed, count(*) filter (where value < 10) as inconclusive from events group by event_type"


def _vclass(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v >= 50).alias("detected"), F.count_if((v < 50) & (v >= 10)).alias("missed"), F.count_if(v < 10).alias("inconclusive"))


@query("ag_variant_class", f"select *, detected + missed as conclusive, round(100 * cast(detected as double) / nullif(detected + missed, 0), 2) as rate, case when inconclusive > 500 then 'INCONCLUSIVE' else {_GRADE.format('round(100 * cast(detected as double) / nullif(detected + missed, 0), 2)')} end as grade from ({_VCLASS})")
def ag_variant_class(spark, d):
    c = _vclass(spark, d).withColumn("conclusive", F.col("detected") + F.col("missed"))
    return c.withColumn("rate", st.rate_or_null("detected", "conclusive")).withColumn("grade", F.when(F.col("inconclusive") > 500, "INCONCLUSIVE").otherwise(st.grade("rate")))


@query("ag_variant_totals", f"select cast(sum(detected) as bigint) as detected, cast(sum(missed) as bigint) as missed, cast(sum(inconclusive) as bigint) as inconclusive, count(*) as classes from ({_VCLASS})")
def ag_variant_totals(spark, d):
    return _vclass(spark, d).agg(F.sum("detected").alias("detected"), F.sum("missed").alias("missed"), F.sum("inconclusive").alias("inconclusive"), F.count("*").alias("classes"))


_FIRST = "select * from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn = 1"


@query("ag_kanon", f"select event_type, value > 50 as outcome, count(*) as n from ({_FIRST}) group by 1, 2 having count(*) >= 5")
def ag_kanon(spark, d):
    e = table(spark, d, "events").withColumn("key", F.concat_ws("/", "user_id", "event_type")).withColumn("outcome", F.col("value") > 50)
    return metrics.k_anonymous(e, "key", "event_id", ["event_type", "outcome"])


@query("ag_report_gate", f"select case when count(*) >= 25 and date_diff('day', min(ts), max(ts)) >= 20 then 'ready' else 'insufficient-data' end as status, count(*) as records from ({_FIRST})")
def ag_report_gate(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("ts", "event_id").alias("ts"))
    ready = (F.count("*") >= 25) & (F.datediff(F.max("ts"), F.min("ts")) >= 20)
    return e.agg(F.when(ready, "ready").otherwise("insufficient-data").alias("status"), F.count("*").alias("records"))


@query("ag_gauntlet", "select count(*) as attempts, count(*) filter (where o_orderstatus = 'P') as pending, count(*) filter (where o_orderstatus = 'F') as confirmed from orders")
def ag_gauntlet(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count("*").alias("attempts"), F.count_if(s == "P").alias("pending"), F.count_if(s == "F").alias("confirmed"))


@query("ag_metrics", "with last as (select value from events order by event_id desc limit 1024) select (select count(*) from events) as scans, (select count(*) from events where value > 70) as blocks, (select count(distinct event_type) from events where value > 70) as classes, (select median(value) from last) as p50")
def ag_metrics(spark, d):
    e = table(spark, d, "events")
    last = e.orderBy(F.desc("event_id")).limit(1024).agg(F.median("value").alias("p50"))
    return e.agg(F.count("*").alias("scans"), F.count_if(F.col("value") > 70).alias("blocks"), F.countDistinct(F.when(F.col("value") > 70, F.col("event_type"))).alias("classes")).crossJoin(last)


@query("ag_latency", "select event_type, min(value) as least, list_sort(list(value))[cast(floor(count(*) * cast(0.5 as double)) as int) + 1] as p50, list_sort(list(value))[cast(floor(count(*) * cast(0.95 as double)) as int) + 1] as p95, list_sort(list(value))[cast(floor(count(*) * cast(0.99 as double)) as int) + 1] as p99, max(value) as most, round(avg(value), 6) as mean from events group by event_type")
def ag_latency(spark, d):
    return metrics.exact_quantiles(table(spark, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumn("mean", F.round("mean", 6))


@query("ag_gateway", "select count(*) as decisions, count(*) filter (where value >= 80) as blocks, count(*) filter (where value >= 50 and value < 80) as sanitizations, count(*) filter (where value < 1) as failures, round(sum(value), 4) as latency_sum from events")
def ag_gateway(spark, d):
    v = F.col("value")
    return table(spark, d, "events").agg(F.count("*").alias("decisions"), F.count_if(v >= 80).alias("blocks"), F.count_if((v >= 50) & (v < 80)).alias("sanitizations"), F.count_if(v < 1).alias("failures"), F.round(F.sum("value"), 4).alias("latency_sum"))


_MEASURES = "coalesce(round(cast(tp as double) / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(cast(tp as double) / nullif(tp + fn, 0), 6), 0) as recall, coalesce(round(cast(fp as double) / nullif(fp + tn, 0), 6), 0) as fpr, coalesce(round(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 6), 0) as f1"
_SWEEP = f"select threshold, tp, fp, tn, fn, {_MEASURES} from (select t.threshold, count(*) filter (where attack and score >= threshold) as tp, count(*) filter (where not attack and score >= threshold) as fp, count(*) filter (where not attack and score < threshold) as tn, count(*) filter (where attack and score < threshold) as fn from ({_CASES}), (select distinct score as threshold from ({_CASES})) t group by t.threshold)"


@query("ag_confusion", _SWEEP.replace(f"(select distinct score as threshold from ({_CASES}))", "(select cast(unnest([0.25, 0.5, 0.75]) as double) as threshold)"))
def ag_confusion(spark, d):
    return metrics.confusion(_cases(spark, d), spark.sql("select explode(array(0.25d, 0.5d, 0.75d)) as threshold"))


@query("ag_threshold", f"select * from ({_SWEEP}) where fp = 0 and tp > 0 order by recall desc, f1 desc, precision desc, threshold limit 1")
def ag_threshold(spark, d):
    return metrics.select_threshold(_cases(spark, d))


@query("ag_roc", f"select coalesce(max(recall), 0) as recall from ({_SWEEP}) where fpr <= 0.2")
def ag_roc(spark, d):
    return metrics.recall_at_fpr(_cases(spark, d), 0.2)


@query("ag_dupcounts", "select size, count(*) as clusters from (select text, count(*) as size from documents group by text) group by size")
def ag_dupcounts(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


@query("ag_agent", "select user_id, max(case when value >= 80 then 2 when value >= 40 then 1 else 0 end) as verdict, count(*) as fields, string_agg(distinct event_type, ',' order by event_type) as classes from events group by user_id")
def ag_agent(spark, d):
    rank = F.when(F.col("value") >= 80, 2).when(F.col("value") >= 40, 1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.max(rank).alias("verdict"), F.count("*").alias("fields"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("classes"))


@query("ag_market", "select count(*) as sampled, max(c_custkey) as expected, greatest(max(c_custkey) - count(*), 0) as dropped, count(*) filter (where c_acctbal > 0) as matched from customer where c_custkey % 10 <> 0")
def ag_market(spark, d):
    return table(spark, d, "customer").where("c_custkey % 10 <> 0").agg(F.count("*").alias("sampled"), F.max("c_custkey").alias("expected"), F.greatest(F.max("c_custkey") - F.count("*"), F.lit(0)).alias("dropped"), F.count_if(F.col("c_acctbal") > 0).alias("matched"))


@query("ag_sla", "with s as (select user_id % 3 as service, date_trunc('month', ts) as m, cast(floor(epoch(ts) / 300) as bigint) as slot, bool_and(value > 5) as r from events group by all) select service, strftime(m, '%Y-%m') as month, count(*) filter (where r) as ready_slots, count(*) as seen_slots, cast(date_diff('day', m, m + interval 1 month) * 288 as bigint) as expected_slots, round(100 * cast(count(*) filter (where r) as double) / (date_diff('day', m, m + interval 1 month) * 288), 4) as availability from s group by service, m")
def ag_sla(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("service"), "ts", (F.col("value") > 5).alias("ready"))
    return metrics.availability(e, "ts", "ready", ["service"])


@query("ag_labels", "select count(*) as n, count(*) filter (where quality = 1) as positive, count(*) filter (where quality = 0) as negative, count(distinct quality) = 2 as both from labels".replace("as both", "as has_both"))
def ag_labels(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"), (F.countDistinct("quality") == 2).alias("has_both"))


@query("ag_origins", "select source, count(*) as n, count(distinct lang) as groups from documents group by source")
def ag_origins(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("groups"))


# --- ordered operators -----------------------------------------------------------------------------------------


@query("wn_first", "select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def wn_first(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", "event_id").alias("event_id"))


@query("wn_last_n", "select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn <= 10")
def wn_last_n(spark, d):
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", rn).where("rn <= 10").select("event_id", "user_id")


_RR = "select event_type, event_id, row_number() over (partition by event_type order by event_id) as i from events"


@query("wn_rank_class", f"select * from (select event_type, event_id, row_number() over (order by i, event_type) as turn from ({_RR}) where i <= 25) where turn <= 60")
def wn_rank_class(spark, d):
    i = F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    k = table(spark, d, "events").withColumn("i", i).where("i <= 25")
    return k.select("event_type", "event_id", F.row_number().over(W.orderBy("i", "event_type")).alias("turn")).where("turn <= 60")


_DRIFT = "select event_id, user_id, case when value < 10 then null else floor(value / 20) end as score from events"


@query("wn_drift", f"select event_id, case when score is null then 'inconclusive' when before is null then 'initial' when score = before then 'unchanged' when score > before then 'improved' else 'regressed' end as drift from (select *, last_value(score ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from ({_DRIFT}))")
def wn_drift(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") >= 10, F.floor(F.col("value") / 20)).alias("score"))
    before = F.last("score", ignorenulls=True).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    s, b = F.col("score"), F.col("before")
    e = e.withColumn("before", before)
    return e.select("event_id", F.when(s.isNull(), "inconclusive").when(b.isNull(), "initial").when(s == b, "unchanged").when(s > b, "improved").otherwise("regressed").alias("drift"))


_ENTRY = "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}'"
_CHAIN = f"with l as (select user_id, row_number() over (partition by user_id order by event_id) as seq, {_ENTRY} as entry from events), c as (select *, coalesce(lag(sha256(entry)) over (partition by user_id order by seq), repeat('0', 64)) as prev_hash from l), t as (select user_id, seq, case when seq = 5 then entry || ' ' else entry end as entry, prev_hash from c)"


def _tampered(spark, d):
    log = ledger.link(ledger.entries(table(spark, d, "events"), "event_id", ["event_id", "event_type"], by="user_id"), by="user_id")
    return log.select("user_id", "seq", F.when(F.col("seq") == 5, F.concat("entry", F.lit(" "))).otherwise(F.col("entry")).alias("entry"), "prev_hash")


@query("wn_chain", _CHAIN + " select user_id, seq, prev_hash = coalesce(lag(sha256(entry)) over (partition by user_id order by seq), repeat('0', 64)) as ok from t")
def wn_chain(spark, d):
    return ledger.verify(_tampered(spark, d), ["user_id"]).select("user_id", "seq", "ok")


@query("wn_prefix", _CHAIN + " select c.user_id, c.seq, sha256(c.entry) = sha256(t.entry) as is_prefix from c join t on c.user_id = t.user_id and c.seq = t.seq where c.seq % 5 = 0")
def wn_prefix(spark, d):
    heads = ledger.link(ledger.entries(table(spark, d, "events"), "event_id", ["event_id", "event_type"], by="user_id"), by="user_id").where("seq % 5 = 0").select("user_id", "seq", "record_hash")
    return heads.join(_tampered(spark, d), ["user_id", "seq"]).select("user_id", "seq", (F.col("record_hash") == F.sha2("entry", 256)).alias("is_prefix"))


@query("wn_monotone", "select o_custkey, bool_and(coalesce(o_orderdate >= p, true)) as rising, count(*) as anchors from (select o_custkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as p from orders) group by o_custkey")
def wn_monotone(spark, d):
    p = F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, d, "orders").select("o_custkey", F.coalesce(F.col("o_orderdate") >= p, F.lit(True)).alias("up"))
    return o.groupBy("o_custkey").agg(F.every("up").alias("rising"), F.count("*").alias("anchors"))


@query("wn_lineage", "select o.o_custkey, o.o_orderkey, count(l_orderkey) as evidence, row_number() over (partition by o.o_custkey order by o.o_orderkey) as pos, o_orderstatus <> 'P' as accepted_as_baseline from orders o left join lineitem on l_orderkey = o_orderkey group by o.o_custkey, o.o_orderkey, o_orderstatus")
def wn_lineage(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left")
    return o.select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("evidence"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), (F.col("o_orderstatus") != "P").alias("accepted_as_baseline"))


# --- sorts, limits, pages ----------------------------------------------------------------------------------------


@query("so_agents", "select c_custkey, row_number() over (order by coalesce(case when c_custkey % 9 = 0 then null else c_acctbal end, -100000) desc, lower(c_name), c_custkey) as pos from customer")
def so_agents(spark, d):
    sold = F.coalesce(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")), F.lit(-100000.0))
    c = table(spark, d, "customer").select("c_custkey", sold.alias("sold"), F.lower("c_name").alias("name"))
    return numbered(c, [F.desc("sold"), F.asc("name"), F.asc("c_custkey")], "pos").select("c_custkey", F.col("pos").cast("int").alias("pos"))


@query("so_limit", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderkey desc limit 50")
def so_limit(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")).limit(50)


@query("so_badges", "select o_orderkey, row_number() over (order by strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') desc, o_orderkey) as pos from orders")
def so_badges(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", st.iso_utc("o_orderdate").alias("at"))
    return numbered(o, [F.desc("at"), F.asc("o_orderkey")], "pos").select("o_orderkey", F.col("pos").cast("int").alias("pos"))


@query("so_keyset", "select event_id as seq, event_type from events where event_id > 500 order by event_id limit 51")
def so_keyset(spark, d):
    return ledger.page(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 500, 50)


@query("so_nulls_first", "select c_custkey, row_number() over (order by last nulls first, c_custkey) as pos from (select c_custkey, max(o_orderdate) as last from customer left join orders on o_custkey = c_custkey group by c_custkey)")
def so_nulls_first(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    c = table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return numbered(c, [F.asc_nulls_first("last"), F.asc("c_custkey")], "pos").select("c_custkey", F.col("pos").cast("int").alias("pos"))


@query("so_topk_class", "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as rn from documents) where rn <= 5")
def so_topk_class(spark, d):
    rn = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    return table(spark, d, "documents").withColumn("rn", rn).where("rn <= 5").select("lang", "doc_id")


@query("so_browser", "select page_id, url from pages where lower(url) like '%example.net%' and url like 'https%' order by url, page_id limit 40")
def so_browser(spark, d):
    return table(spark, d, "pages").where("lower(url) like '%example.net%' and url like 'https%'").select("page_id", "url").orderBy("url", "page_id").limit(40)


@query("so_argmax", "select user_id, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn = 1")
def so_argmax(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


# --- sets --------------------------------------------------------------------------------------------------------


@query("st_union", "select doc_id, text from documents where doc_id % 2 = 0 union all select item_id, text from benchmark")
def st_union(spark, d):
    return table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "text").unionByName(table(spark, d, "benchmark").toDF("doc_id", "text"))


@query("st_intersect", "select text from documents where doc_id % 2 = 0 intersect select text from documents where doc_id % 2 = 1")
def st_intersect(spark, d):
    t = table(spark, d, "documents")
    return t.where("doc_id % 2 = 0").select("text").intersect(t.where("doc_id % 2 = 1").select("text"))


@query("st_except", "select doc_id from documents where doc_id % 2 = 0 and text not in (select text from documents where doc_id % 2 = 1)")
def st_except(spark, d):
    t = table(spark, d, "documents")
    return t.where("doc_id % 2 = 0").join(t.where("doc_id % 2 = 1").select("text"), "text", "left_anti").select("doc_id")


@query("st_subset", "select user_id, list_has_all(list_distinct(list(event_type)), ['click', 'view']) as whole from events group by user_id")
def st_subset(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return g.select("user_id", (F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "seen")) == 0).alias("whole"))


@query("st_distinct", "select distinct cast(floor(value) as bigint) as score from events")
def st_distinct(spark, d):
    return table(spark, d, "events").select(F.floor("value").alias("score")).distinct()
