"""Queries of feature vectors, training rows, the fit of a linear scorer and its use: on documents with labels (toxic
stands for an attack)."""

from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators import features as ft
from sievelight.operators import learned as ln
from sievelight.sources.scratch import saved

from .base import query, table
from .screening import spiked


def _labelled(spark, d):
    """Each labelled document once; of several labels the highest counts."""
    labels = table(spark, d, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").join(labels, "doc_id")


_SCALARS = """select doc_id, round(ln(1 + length(t)), 9) as log_length, round(cast(length(regexp_replace(t, '[^0-9]', '', 'g')) as double) / greatest(length(t), 1), 9) as digit,
round(ln(1 + len(regexp_extract_all(t, '0x[0-9a-fA-F]{40}'))), 9) as addresses, 2075 as dimension from (select doc_id, text as t from documents where text is not null and regexp_matches(text, '^[\\x00-\\x7F]*$'))"""


@query("fn_features")
def fn_features(spark, d):
    """Each text's scalars, and the places and values of the largest of its hashed counts."""
    v = ft.vectors(spiked(spark, d).where("text is not null"), "text", "v")  # a condition on the vector would compute it twice
    at = lambda n: F.round(F.element_at("v", ft.DENSE.index(n) + 1), 9)
    block = lambda i: F.slice("v", len(ft.DENSE) + 1 + i * ft.BUCKETS, ft.BUCKETS)
    tops = [F.array_position(block(i), F.array_max(block(i))).alias(n) for i, n in enumerate(("top_surface", "top_bare"))]
    return v.select("doc_id", *[at(n).alias(n.replace(".", "_")) for n in ft.DENSE], *tops, F.size("v").alias("dimension"))


@query("fn_features_shape", _SCALARS)
def fn_features_shape(spark, d):
    """Four of the numbers, on texts of ASCII characters alone."""
    docs = table(spark, d, "documents").where("text is not null").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    at = lambda n: F.round(F.element_at("v", ft.DENSE.index(n) + 1), 9).alias(n)
    return ft.vectors(docs, "text", "v").select("doc_id", at("log_length"), at("digit"), at("addresses"), F.size("v").alias("dimension"))


_UP, _LOOK = ln.LOOK_ALIKES
_MADE = f"""[{{'transform': 'character-spacing', 'p': regexp_replace(text, '(\\pL)', '\\1 ', 'g')}}, {{'transform': 'punctuation-split', 'p': regexp_replace(text, '(\\pL)', '\\1.', 'g')}},
{{'transform': 'typo-deletion', 'p': regexp_replace(text, '((?:\\PL*\\pL){{6}}\\PL*)\\pL', '\\1', 'g')}}, {{'transform': 'homoglyph', 'p': translate(text, '{_UP}', '{_LOOK}')}}, {{'transform': 'whitespace-expand', 'p': replace(text, ' ', ' ' || chr(9) || ' ')}}]"""


@query("ml_evasions", f"select doc_id, x.transform as transform, sha256(x.p) as h from (select doc_id, text, unnest({_MADE}) as x from documents where text is not null) where x.p <> text")
def ml_evasions(spark, d):
    """The evasions of every text, but for upper case, which engines have in different versions of Unicode."""
    e = ln.evasions(table(spark, d, "documents"), "doc_id").where("transform <> 'uppercase'")
    return e.select("doc_id", "transform", F.sha2("payload", 256).alias("h"))


@query("ml_rows")
def ml_rows(spark, d):
    docs = saved(_labelled(spark, d))
    return ln.training_rows(docs.where("label = 1"), docs.where("label = 0"), "doc_id", digests=True)


def _fitted(spark, d):
    docs = _labelled(spark, d)
    return ln.fit(ft.vectors(docs).withColumn("group", F.xxhash64(tx.canonical_plain(F.col("text")))), key="doc_id")  # copies are one group


@query("ml_train")
def ml_train(spark, d):
    """Out-of-fold scores of all labelled documents."""
    got = _fitted(spark, d)
    return got.out_of_fold.select(F.col("key").alias("doc_id"), "label", "fold", F.round("score", 6).alias("score"), F.lit(got.strength).alias("strength"))


@query("scan_learned_fit")
def scan_learned_fit(spark, d):
    """The scorer that is fitted on the labelled documents, on all documents."""
    got = _fitted(spark, d)
    scorer = ln.Scorer(got.weights, got.bias, publish=0.5, enforce=0.9) if len(got.weights) else ln.Scorer([0.0] * ft.DIMENSION, 0.0)
    return scorer.score(spiked(spark, d)).select("doc_id", F.round("attack_probability", 6).alias("attack_probability"), "enforced")
