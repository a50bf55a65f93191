"""Queries of text functions, decoders, near copies and leakage."""

import tempfile

from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import near, variants

from .base import query, table

_ZW = "​‌‍‎‏⁠⁡⁢⁣﻿‪‫‬‭‮"
_FOLD = r"trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g'))"
_percent = variants.TRANSFORMS["encoding:percent"][1]
_FW = f"list_filter(string_split({_FOLD}, ' '), lambda w: w <> '')"


def _grams(w: str, k: int) -> str:
    return f"case when len({w}) >= {k} then list_distinct(list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i+{k - 1}], ' '))) when len({w}) > 0 then [array_to_string({w}, ' ')] else [] end"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("fn_strip_invisible", f"select doc_id, sha256(text) as h, length(text) + 2 as before from documents")
def fn_strip_invisible(spark, d):
    t = _docs(spark, d).withColumn("t", F.concat(F.lit("​"), "text", F.lit("‮")))
    return t.select("doc_id", F.sha2(tx.strip_invisible("t"), 256).alias("h"), F.length("t").cast("long").alias("before"))


@query("fn_canonical", "select doc_id, sha256(trim(regexp_replace(lower(nfc_normalize(replace(text, 'ß', 'ss'))), '\\s+', ' ', 'g'))) as key from documents")
def fn_canonical(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(tx.canonical("text"), 256).alias("key"))


@query("fn_fold_unicode")
def fn_fold_unicode(spark, d):
    disguised = F.translate(F.concat(F.lit("​Ｉgnore ﬁne "), "text"), "aeo", "аео")
    return _docs(spark, d).select("doc_id", tx.fold_unicode(disguised).alias("text"))


@query("fn_tokenize", "select doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as tokens from documents")
def fn_tokenize(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(tx.tokens("text"), " ").alias("tokens"))


@query("fn_shingle_fold", f"select doc_id, {_FOLD} as folded from documents")
def fn_shingle_fold(spark, d):
    return _docs(spark, d).select("doc_id", tx.shingle_fold("text").alias("folded"))


def _sum(name, k):
    return f"with w as (select doc_id, {_FW} as w from documents), g as (select doc_id, {_grams('w', k)} as g from w) select doc_id, len(g) as n, sha256(array_to_string(list_sort(g), '/')) as h from g"


def _gram_rows(spark, d, k):
    g = _docs(spark, d).select("doc_id", tx.grams(tx.fold_words("text"), k).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("g"), "/"), 256).alias("h"))


@query("fn_word_shingles", _sum("n", 5))
def fn_word_shingles(spark, d):
    return _gram_rows(spark, d, 5)


@query("fn_containment_grams", _sum("n", 13))
def fn_containment_grams(spark, d):
    return _gram_rows(spark, d, 13)


@query("fn_char_shingles", f"with t as (select doc_id, replace({_FOLD}, ' ', '') as t from documents), g as (select doc_id, case when length(t) >= 5 then list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) when length(t) > 0 then [t] else [] end as g from t) select doc_id, len(g) as n, sha256(array_to_string(list_sort(g), '/')) as h from g")
def fn_char_shingles(spark, d):
    g = _docs(spark, d).select("doc_id", tx.char_grams(tx.shingle_fold("text"), 5).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("g"), "/"), 256).alias("h"))


_PLAUSIBLE = r"length(text) >= 8 and len(regexp_extract_all(text, '[^\p{C}]|[\r\n\t]')) >= cast(0.9 as double) * length(text) and len(list_filter(range(1, length(text) + 1, 32), lambda i: length(regexp_replace(substr(text, i, 64), '[^\p{L}]', '', 'g')) >= cast(0.4 as double) * length(substr(text, i, 64)))) > 0"
_DECODED = "select doc_id, case when octet_length(encode(text)) >= {} and " + _PLAUSIBLE.replace("{", "{{").replace("}", "}}") + " then text end as decoded from documents"


@query("fn_dec_b64", _DECODED.format(12))
def fn_dec_b64(spark, d):
    t = _docs(spark, d).withColumn("e", F.concat(F.lit("see "), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")))
    return t.select("doc_id", F.try_element_at(tx.decode_base64("e"), F.lit(1)).alias("decoded"))


@query("fn_dec_hex", _DECODED.format(8))
def fn_dec_hex(spark, d):
    t = _docs(spark, d).withColumn("e", F.concat(F.lit("x 0x"), F.hex(F.col("text").cast("binary"))))
    return t.select("doc_id", F.try_element_at(tx.decode_hex("e"), F.lit(1)).alias("decoded"))


@query("fn_dec_xesc", _DECODED.format(4))
def fn_dec_xesc(spark, d):
    t = _docs(spark, d).withColumn("e", F.regexp_replace(F.hex(F.col("text").cast("binary")), "(..)", r"\\x$1"))
    return t.select("doc_id", F.try_element_at(tx.decode_escapes("e"), F.lit(1)).alias("decoded"))


@query("fn_dec_pct", "select doc_id, url_decode(url_encode(text) || '+') as decoded from documents where len(regexp_extract_all(url_encode(text), '%[0-9a-fA-F]{2}')) >= 3")
def fn_dec_pct(spark, d):
    e = F.concat(_percent(F.col("text")), F.lit("+"))
    return _docs(spark, d).select("doc_id", tx.decode_percent(e).alias("decoded")).where("decoded is not null")


@query("fn_dec_html")
def fn_dec_html(spark, d):
    return table(spark, d, "pages").select("page_id", tx.unescape_html(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))


_LAYER = r"^(?:(?:0x)?(?:[0-9a-fA-F]{2}){8,}|[A-Za-z0-9+/_-]{16,}={0,2}|(?:\\x[0-9a-fA-F]{2}){4,})$"


@query("fn_layer", f"with e as (select doc_id, case doc_id % 3 when 0 then hex(encode(text)) when 1 then url_encode(text) else text end as t from documents) select doc_id, length(t) >= 8 and (regexp_matches(t, '{_LAYER}') or (len(regexp_extract_all(t, '%[0-9a-fA-F]{{2}}')) >= 3 and not regexp_matches(replace(regexp_replace(t, '%[0-9a-fA-F]{{2}}', '', 'g'), 'x', ''), '%'))) as layer from (select doc_id, trim(t) as t from e)")
def fn_layer(spark, d):
    k = F.col("doc_id") % 3
    e = F.when(k == 0, F.hex(F.col("text").cast("binary"))).when(k == 1, _percent(F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", tx.encoded_layer(e).alias("layer"))


@query("fn_sha_canonical", "select o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') as h from orders")
def fn_sha_canonical(spark, d):
    from sievelight.operators.ledger import canonical

    return table(spark, d, "orders").select("o_orderkey", F.sha2(canonical("o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("h"))


@query("fn_ids", "select doc_id, substr(sha256(cast(doc_id as varchar) || chr(0) || source || chr(0) || lang), 1, 16) as id from documents")
def fn_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.short_id("doc_id", "source", "lang").alias("id"))


@query("fn_host", "select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host from pages")
def fn_host(spark, d):
    u = F.regexp_replace("url", "://([^/?#]*)", "://user@$1:443")
    return table(spark, d, "pages").select("page_id", tx.host(u).alias("host"))


@query("fn_threat_name", "select doc_id, regexp_matches(lower(text), 'idiot|moron|worthless') as named from documents")
def fn_threat_name(spark, d):
    return _docs(spark, d).select("doc_id", F.lower("text").rlike("idiot|moron|worthless").alias("named"))


@query("fn_corpus_fp", "select sha256(string_agg(replace(text, chr(13) || chr(10), chr(10)), chr(10) order by item_id)) as fingerprint from benchmark")
def fn_corpus_fp(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("t")))), lambda x: x["t"])
    return table(spark, d, "benchmark").agg(F.sha2(F.array_join(rows, "\n"), 256).alias("fingerprint"))


def _slots(name: str, source: str, key: str) -> str:
    """The signatures of a table's texts, with the pairs of ``tx.minhash``, which come from a rule."""
    pairs = "[" + ", ".join(f"{{'a': {x}::bigint, 'b': {y}::bigint}}" for x, y in tx.minhash_pairs(128)) + "]"
    h = "list_transform(g, lambda x: cast('0x' || substr(md5(x), 1, 8) as bigint) % 2147483647)"
    return f"{name} as (select k, list_transform({pairs}, lambda p: coalesce(list_min(list_transform(h, lambda x: (x * p.a + p.b) % 2147483647)), 2147483647)) as s from (select k, {h} as h from (select {key} as k, {_grams('w', 5)} as g from (select {key}, {_FW} as w from {source}))))"


@query("fn_minhash", f"with {_slots('m', 'documents', 'doc_id')} select k as doc_id, cast(unnest(range(0, 128)) as int) as pos, unnest(s) as slot from m")
def fn_minhash(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tx.minhash(tx.grams(tx.fold_words("text"), 5))).alias("pos", "slot"))


@query("fn_bands", f"with {_slots('m', 'documents', 'doc_id')}, i as (select k, s, unnest(range(0, 16)) as i from m) select k as doc_id, substr(md5(i || '/' || array_to_string(s[i * 8 + 1:i * 8 + 8], '/')), 1, 16) as band from i")
def fn_bands(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.bands(tx.minhash(tx.grams(tx.fold_words("text"), 5)))).alias("band"))


# --- leakage and near copies ---


def _sets(name: str, source: str, key: str, k: int, cond: str = "") -> str:
    return f"{name} as (select k, len(g) as n, unnest(g) as g from (select {key} as k, {_grams('w', k)} as g from (select {key}, {_FW} as w from {source}) {cond}))"


_LEAK = f"with {_sets('a', 'documents', 'doc_id', 5)}, {_sets('b', 'benchmark', 'item_id', 5)}, p as (select a.k as doc_id, b.k as item_id, any_value(a.n) as na, any_value(b.n) as nb, count(*) as m from a join b on a.g = b.g group by a.k, b.k), j as (select doc_id, item_id, cast(m as double) / (na + nb - m) as jaccard from p)"


@query("jn_leak_exact", _LEAK + " select doc_id, item_id, round(jaccard, 9) as jaccard from (select *, row_number() over (partition by doc_id order by jaccard desc, item_id) as rn from j) where rn = 1")
def jn_leak_exact(spark, d):
    return near.jaccard_leaks(_docs(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id").withColumn("jaccard", F.round("jaccard", 9))


_CONTAIN = f"with {_sets('a', 'documents', 'doc_id', 13, 'where len(w) >= 5')}, {_sets('b', 'benchmark', 'item_id', 13, 'where len(w) >= 5')}, p as (select a.k as doc_id, b.k as item_id, any_value(a.n) as na, any_value(b.n) as nb, count(*) as m from a join b on a.g = b.g group by a.k, b.k), c as (select doc_id, item_id, cast(m as double) / least(na, nb) as containment from p)"


@query("jn_leak_contain", _CONTAIN + " select doc_id, item_id, round(containment, 9) as containment from c where containment > 0.5")
def jn_leak_contain(spark, d):
    return near.containment_leaks(_docs(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id").withColumn("containment", F.round("containment", 9))


_EST = f"with {_slots('a', 'documents', 'doc_id')}, {_slots('b', 'benchmark', 'item_id')}, e as (select a.k as doc_id, b.k as item_id, cast(len(list_filter(range(1, 129), lambda i: a.s[i] = b.s[i])) as double) / 128 as estimate from a, b)"


@query("jn_leak_est", _EST + " select doc_id, item_id, estimate from (select *, row_number() over (partition by doc_id order by estimate desc, item_id) as rn from e) where rn = 1")
def jn_leak_est(spark, d):
    return near.best_estimates(_docs(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")


def _checkpoints(spark) -> None:
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp()}")


_PAIRS = f"with {_sets('a', 'documents', 'doc_id', 5)}, p as (select a.k as a, b.k as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as m from a join a b on a.g = b.g and a.k < b.k group by a.k, b.k), near as (select a, b, cast(m as double) / (na + nb - m) as jaccard from p where cast(m as double) / (na + nb - m) >= 0.8)"


@query("jn_lsh", _PAIRS + " select a, b, round(jaccard, 9) as jaccard from near")
def jn_lsh(spark, d):
    return near.similar_pairs(_docs(spark, d), "doc_id").withColumn("jaccard", F.round("jaccard", 9))


@query("ml_gate_bc", _PAIRS.replace("with ", "with recursive ", 1) + ", e as (select a, b from near union select b, a from near), r(k, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.k) select k as doc_id, min(c) as cluster from r group by k")
def ml_gate_bc(spark, d):
    _checkpoints(spark)
    return near.near_clusters(_docs(spark, d), "doc_id")


@query("wn_leaders")
def wn_leaders(spark, d):
    _checkpoints(spark)
    docs = _docs(spark, d)
    return near.leaders(near.similar_pairs(docs, "doc_id"), docs, "doc_id")


_GATE = _LEAK + ", " + _CONTAIN[5:].replace("a as (", "a2 as (", 1).replace(", b as (", ", b2 as (", 1).replace("from a join b on a.g = b.g group by a.k, b.k)", "from a2 a join b2 b on a.g = b.g group by a.k, b.k)").replace(", p as (", ", p2 as (").replace("from p)", "from p2)")


@query("ml_gate_a", _GATE + ", x as (select doc_id, max(jaccard) as j from j group by doc_id), y as (select doc_id, max(containment) as c from c group by doc_id) select coalesce(x.doc_id, y.doc_id) as doc_id, concat_ws(',', case when j >= 0.8 then 'jaccard' end, case when c > 0.5 then 'containment' end) as reasons from x full join y on x.doc_id = y.doc_id where j >= 0.8 or c > 0.5")
def ml_gate_a(spark, d):
    docs, held = _docs(spark, d), table(spark, d, "benchmark")
    j = near.jaccard_leaks(docs, held, "doc_id", "item_id").where(F.col("jaccard") >= near.LEAK_JACCARD).select("doc_id", F.lit("jaccard").alias("r"))
    c = near.containment_leaks(docs, held, "doc_id", "item_id").select("doc_id", F.lit("containment").alias("r"))
    return j.union(c).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("r"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), ",").alias("reasons"))


@query("ag_leak_report", _CONTAIN + " select count(distinct doc_id) as rejected, round(max(containment), 9) as most, (select count(*) from documents) as candidates, (select count(*) from benchmark) as held_out from c where containment > 0.5")
def ag_leak_report(spark, d):
    docs, held = _docs(spark, d), table(spark, d, "benchmark")
    c = near.containment_leaks(docs, held, "doc_id", "item_id").agg(F.countDistinct("doc_id").alias("rejected"), F.round(F.max("containment"), 9).alias("most"))
    return c.crossJoin(docs.agg(F.count("*").alias("candidates"))).crossJoin(held.agg(F.count("*").alias("held_out")))
