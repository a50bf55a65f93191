"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import decontaminate


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def contamination_sql(documents: str) -> str:
    return f"""
with iw as (select item_id, {_SPLIT} as w from benchmark),
win as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) as g,
               least(len(w), 13) as size from iw where len(w) > 0),
dw as (select doc_id, {_SPLIT} as w from {documents}),
sizes as (select distinct size from win),
dg as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as p0,
              unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i+size-1], ' '))) as g
       from dw, sizes where len(w) >= size),
hit as (select distinct dg.doc_id, dg.p0, dg.size, win.item_id from dg join win on dg.g = win.g and dg.size = win.size),
covered as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p0, p0 + size)) as p from hit) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered on covered.doc_id = dw.doc_id left join ids on ids.doc_id = dw.doc_id
"""


QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {"op4_decontamination": contamination_sql("documents")}
