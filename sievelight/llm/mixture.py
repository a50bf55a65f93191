"""Query of mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import label_weights, mix


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mix(docs.select("doc_id", "source", "text"), quality=label_weights(labels))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixing_sql(documents: str) -> str:
    """copies of each row of a table of documents without repeated rows, with the table of labels."""
    return rf"""
with recursive d as (select *, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from {documents}),
q as (select doc_id, 0.1 + 0.9 * avg(quality) as labelled from labels where doc_id is not null group by doc_id),
w as (select d.*, labelled, case when length(coalesce(text, '')) > 0 then 1 - cast(length(regexp_replace(text, '[A-Za-z\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g')) as double) / length(text) else 0.0 end as share from d left join q on q.doc_id = d.doc_id),
k as (select *, -ln((cast(cast('0x' || substr(md5('7/' || coalesce(cast(doc_id as varchar), '') || '/' || coalesce(source, '') || '/' || coalesce(text, '')), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0) / coalesce(labelled, greatest(0.05, share * share)) as key from w),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as nth from k group by source),
sw as (select *, cast(case nth % 3 when 0 then 3 when 1 then 1 else 2 end as double) as weight, 2.0 * source_size as cap, 1.5 * sum(source_size) over () as everything from s),
fill(turn, source, source_size, weight, cap, target, stopped, pool) as (
  select 0, source, source_size, weight, cap, cast(0 as double), false, cast(everything as double) from sw
  union all
  select turn + 1, source, source_size, weight, cap, case when stopped or share > cap then cap else share end, stopped or share > cap, pool
  from (select *, weight * (pool - coalesce(sum(case when stopped then cap end) over (), 0)) / nullif(sum(case when stopped then 0 else weight end) over (), 0) as share from fill) where turn < 60),
t as (select source, source_size, round(target, 6) as target, case when source_size > 0 then floor(round(target, 6) / source_size) else 0 end as whole from fill where turn = 60),
r as (select k.doc_id, k.lang, k.source, k.text, k.n_chars, k.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size as rest,
             sum(k.size) over (partition by k.source order by k.key, k.doc_id rows unbounded preceding) as run from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(whole + case when run <= rest then 1 else 0 end as bigint) * size as taken,
       cast(whole + case when run <= rest then 1 else 0 end as bigint) as copies, text, lang, source, n_chars from r
"""


QUERIES = {"op10_mixing": op10_mixing}
SQL = {"op10_mixing": f"select doc_id, size, source_size, target, taken, copies from ({mixing_sql('documents')})"}
