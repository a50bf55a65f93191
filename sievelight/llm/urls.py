"""URL filter with redirect equivalence, with DataFrame operations only.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's, and
the longest rule wins (by host, then by path). Redirects (meta refresh) and canonical links found in a page's html tie
its url to another; connected components of these edges are aliases of one page. A url that a rule fits has the rule's
verdict. Any other has its component's: an explicit allow among its aliases takes precedence over a block, a block over
nothing, and nothing means allow.

Urls that are null or hold no ``://`` have an empty host and path and no aliases. Null html has no edges; neither have
edges to relative addresses without a host. Very long html is searched whole. Of rules that fit with equal length none
differ, as a host and a path name one rule. Cycles and hubs are components like others. Repeated rows each get their row;
other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .work import Work

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
#: The rules of op7: (host, path, verdict).
RULES: tuple[Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: str | Column) -> Column:
    return F.translate(_part(url, r"(?s)^.*?://([^/?#]*)"), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    return _part(url, r"(?s)^.*?://[^/?#]*([^?#]*)")


def _part(url: str | Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def rule_of(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits columns host and path, as a struct (rule, verdict); null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_TAG = r"(?is)<{}\b[^>]*>"
_ATTRIBUTE = r"""(?is)\b{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name)
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def targets(html: str) -> Column:
    """The absolute addresses that canonical links and refreshes of a page lead to."""
    links = F.filter(F.regexp_extract_all(html, F.lit(_TAG.format("link")), F.lit(0)), lambda t: F.lower(_attribute(t, "rel")) == "canonical")
    meta = F.filter(F.regexp_extract_all(html, F.lit(_TAG.format("meta")), F.lit(0)), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    to = F.concat(F.transform(links, lambda t: _attribute(t, "href")), F.transform(meta, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))))
    return F.filter(F.transform(to, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u.contains("://"))


def plain(url: str | Column) -> Column:
    """A url without its fragment, with the scheme and host in lower case: the node of the graph."""
    u = F.col(url) if isinstance(url, str) else url
    head = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(head != "", F.concat(F.translate(head, _UPPER, _LOWER), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, work: Work | None = None, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and component of pages (page_id, url, html).

    ``edges`` (a, b) may name further redirects between urls. Targets that are no pages count as aliases too, with the
    rules that fit them.
    """
    work = work or Work(pages.sparkSession)
    base = pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path"), plain("url").alias("node")).withColumn("r", rule_of(rules))
    seen = pages.where("html is not null").select(plain("url").alias("a"), F.explode(targets("html")).alias("b")).select("a", plain("b").alias("b"))
    if edges is not None:
        seen = seen.union(edges.select(plain("a"), plain("b")))
    seen = work.save(seen.where("a is not null and b is not null and a <> b").distinct(), "links")
    parts = connected_components(seen, work)
    ruled = parts.select("component", host("node").alias("host"), path("node").alias("path")).select("component", rule_of(rules)["verdict"].alias("v"))
    told = ruled.where("v is not null").groupBy("component").agg(F.min("v").alias("shared"))  # allow precedes block
    aliases = parts.join(told, "component", "left")
    out = base.join(aliases, "node", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "shared", F.lit("allow")).alias("verdict"), "component")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = "regexp_extract({0}, '(?s)^(.*?://[^/?#]*)', 1)"
_PLAIN = f"case when {_NODE} <> '' then translate({_NODE}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end"
_RULE = """case when host = 'example.net' or ends_with(host, '.example.net') then case when starts_with(path, '/en/') then 'example.net/en/' when starts_with(path, '/') then 'net/' end
     when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
     when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
     when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' end"""
_VERDICT = "case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' end"
OP7_SQL = f"""
with recursive base as (select page_id, {_HOST} as host, {_PATH} as path, {_PLAIN.format('url')} as node, html from pages),
tags as (select node as a, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<link\\b[^>]*>')) as t from base),
canon as (select a, regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^\\s"''>]+)', 1) as b from tags where regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?canonical')),
metas as (select node as a, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<meta\\b[^>]*>')) as t from base),
moved as (select a, regexp_extract(t, '(?is)url\\s*=\\s*["'']?([^\\s"''>]+)', 1) as b from metas where regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh')),
raw as (select a, replace(b, '&amp;', '&') as b from canon union all select a, replace(b, '&amp;', '&') from moved),
one as (select a, {_PLAIN.format('b')} as b from raw where a is not null),
edge as (select a, b from one where b is not null and a <> b union select b, a from one where b is not null and a <> b),
reach(node, c) as (select a, a from edge union select edge.b, reach.c from reach join edge on edge.a = reach.node),
part as (select node, min(c) as component from reach group by node),
said as (select component, {_RULE} as rule from (select component, {_HOST} as host, {_PATH} as path from (select component, node as url from part))),
told as (select component, min({_VERDICT}) as shared from said where rule is not null group by component),
ruled as (select *, {_RULE} as rule from base)
select page_id, host, path, rule, coalesce({_VERDICT}, shared, 'allow') as verdict, part.component
from ruled left join part on part.node = ruled.node left join told on told.component = part.component
"""

QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": OP7_SQL}
