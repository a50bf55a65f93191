"""Queries of sources, sinks, and releases, and of the layers of decoding."""

import tempfile
import uuid

from pyspark.sql import functions as F

from sievelight.operators import layers, links
from sievelight.sources import files

from .analysis import told
from .base import query, table
from .screening import SPIKES


def _folder(spark) -> str:
    """A new folder below the one that the cluster names for checkpoints; a temporary one where none is named, in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp()}"
    return f"{named.rstrip('/')}/release-{uuid.uuid4().hex}"


@query("src_jsonl", "select doc_id, source, sha256(text) as h from documents where text is not null")
def src_jsonl(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text")
    got = files.parse_jsonl(files.canonical_lines(docs), "doc_id long, source string, text string")
    return got.select("doc_id", "source", F.sha2("text", 256).alias("h"))


@query("src_jsonl_bounded", "select item_id, cast(length(text) as int) as n from benchmark")
def src_jsonl_bounded(spark, d):
    return files.bounded(table(spark, d, "benchmark"), "item_id", "text", length=100_000).select("item_id", F.length("text").alias("n"))


@query("snk_release", "select r.r_name, count(*) as nations from nation n join region r on n.n_regionkey = r.r_regionkey group by r.r_name")
def snk_release(spark, d):
    """Two versions of two tables; readers of the pointer see the second, whole."""
    root, both = _folder(spark), {n: table(spark, d, n) for n in ("region", "nation")}
    files.release({n: t.limit(1) for n, t in both.items()}, root)
    files.release(both, root, {"region": 1, "nation": 1})
    n, r = files.released(spark, root, "nation"), files.released(spark, root, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.count("*").alias("nations"))


@query("snk_atomic", "select count(*) as rows, sum(r_regionkey) as keys from region")
def snk_atomic(spark, d):
    """A second version that fails its check leaves the first in place."""
    root, r = _folder(spark), table(spark, d, "region")
    files.release({"region": r}, root)
    try:
        files.release({"region": r.limit(1)}, root, {"region": 1 << 40})
    except ValueError:
        pass
    return files.released(spark, root, "region").agg(F.count("*").alias("rows"), F.sum("r_regionkey").alias("keys"))


_PLANTED = "case page_id % 6 when 0 then 'http://10.1.2.' || page_id % 256 || '/x' when 1 then 'ftp://host/x' when 2 then 'http://user:pw@host.org/' when 3 then 'https://172.20.0.9:8080/a' else url end"
_HOST = r"lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*)', 1))"


@query("flt_ssrf", f"select page_id, case when u is null or not regexp_matches(lower(u), '^https?://') then 'scheme' when regexp_matches(u, '^[A-Za-z]+://[^/?#]*@') then 'credentials' when {_HOST} = '' then 'host' when regexp_matches({_HOST}, '{links.NOT_PUBLIC}') then 'blocked' end as refused from (select page_id, {_PLANTED} as u from pages)")
def flt_ssrf(spark, d):
    u = F.expr(_PLANTED.replace("page_id % 256 ||", "cast(page_id % 256 as string) ||"))
    return table(spark, d, "pages").select("page_id", links.refused(u).alias("refused"))


@query("fn_derive")
def fn_derive(spark, d):
    """Candidates of texts of which every third hides a sentence in base64."""
    hidden = F.concat(F.col("text"), F.lit(" "), F.base64(F.encode(F.lit(SPIKES[0]), "UTF-8")))
    docs = told(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, hidden).otherwise(F.col("text")).alias("text"))
    return layers.derive(docs, "doc_id").select("doc_id", "nth", "transform", F.sha2("candidate", 256).alias("h"))


@query("scan_wall")
def scan_wall(spark, d):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    hidden = F.concat(F.lit("run "), F.base64(F.encode(F.lit(SPIKES[0]), "UTF-8")))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "), hidden)).otherwise(F.col("text")).alias("text"))
    return layers.wall(docs, "doc_id").groupBy("verdict", "risk_level").agg(F.count("*").alias("n"))
