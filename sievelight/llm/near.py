"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard import jaccard_components


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP3_SQL = f"""
with recursive words as (select doc_id, coalesce({_WORDS}, []) as w from documents),
cut as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                            when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
flat as (select distinct doc_id, len(s) as n, unnest(s) as g from cut),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n) + any_value(b.n) as total
          from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * shared >= 75 * (total - shared)),
reach(doc_id, c) as (select doc_id, doc_id from documents union select links.b, reach.c from reach join links on links.a = reach.doc_id)
select cut.doc_id, cast(len(s) as bigint) as n_shingles, min(reach.c) as component_id
from cut join reach on cut.doc_id = reach.doc_id group by cut.doc_id, len(s)
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL = {"op3_jaccard_join": OP3_SQL}
