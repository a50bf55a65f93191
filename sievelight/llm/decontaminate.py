"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

``build_postings`` stores, for chosen terms, where they stand in which document, along with the words around. ``phrases``
looks up each phrase at its rarest term: the offset of that term in the phrase aligns the stored list with the lists of
the phrase's other terms, which are read off the stored neighbourhood, so a phrase costs one look-up at its rarest term
and no join for the others. ``proximity`` finds all terms within a span, in any order.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. A null text has no
words, nor has an empty one; very long texts are read whole. Of equally rare terms the first in the phrase is looked up,
which is of no effect on what matches. Repeated rows are each a document of their own (rows are told apart by id and text, and equal rows have equal
results). Columns beyond those named are ignored; empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work

#: A table of look-up terms of at most so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose measured size is within the bound."""
    size = df.agg(F.sum(F.octet_length("term") + F.lit(64))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def windows(items: DataFrame, size: int = 13) -> DataFrame:
    """(item_id, phrase): each run of ``size`` words of an item; all words of a shorter item; nothing without words."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
    return w.select("item_id", F.explode(F.array_distinct(each)).alias("phrase"))


def document_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` stands in all documents."""
    return docs.select(F.explode(words("text")).alias("term")).join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def build_postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """Postings (term, key, doc_id, at, around) of ``terms`` (term) in documents (doc_id, text).

    ``at`` counts words from 0; ``around`` holds the words from at - reach to at + reach, with nulls beyond the ends.
    Write it (by term) to keep an index.
    """
    pad = F.array_repeat(F.lit(None).cast("string"), reach)
    d = docs.select(_key().alias("key"), "doc_id", F.concat(pad, words("text"), pad).alias("w"))
    each = d.select("key", "doc_id", "w", F.posexplode("w").alias("p", "term")).where("term is not null")
    hit = each.join(_small(terms), "term")
    return hit.select("term", "key", "doc_id", (F.col("p") - reach).alias("at"), F.slice("w", F.col("p") - reach + 1, 2 * reach + 1).alias("around"))


def plan(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, term, offset) of phrases (phrase): the rarest term of each, by counts (term, n), and where it stands.

    Phrases with a term that no document holds are left out.
    """
    p = phrases.select("phrase").distinct()
    each = p.select("phrase", F.posexplode("phrase").alias("offset", "term")).join(counts, "term", "left")
    first = each.groupBy("phrase").agg(F.min(F.struct("n", "term", "offset")).alias("f"), F.count_if(F.col("n").isNull()).alias("absent"))
    return first.where("absent = 0").select("phrase", F.col("f.term").alias("term"), F.col("f.offset").alias("offset"))


def match_phrases(postings: DataFrame, planned: DataFrame, reach: int) -> DataFrame:
    """(key, doc_id, found): for each posting with matches, the phrases that stand there: array of (start, phrase)."""
    at_term = planned.groupBy("term").agg(F.collect_list(F.struct("phrase", "offset")).alias("tried"))
    got = postings.join(_small(at_term), "term")
    fits = lambda t: F.slice("around", F.lit(reach + 1) - t["offset"], F.size(t["phrase"])) == t["phrase"]
    found = F.transform(F.filter("tried", fits), lambda t: F.struct((F.col("at") - t["offset"]).alias("start"), t["phrase"].alias("phrase")))
    return got.select("key", "doc_id", found.alias("found")).where(F.size("found") > 0)


def phrases(docs: DataFrame, wanted: DataFrame, work: Work) -> DataFrame:
    """(key, doc_id, found) for all exact matches of phrases (phrase), by an index that is written and read again."""
    wanted = work.save(wanted.select("phrase").distinct(), "phrases")
    reach = (wanted.agg(F.max(F.size("phrase"))).first()[0] or 1) - 1
    terms = wanted.select(F.explode("phrase").alias("term")).distinct()
    counts = work.save(document_terms(docs, terms), "counts")
    planned = work.save(plan(wanted, counts), "plan")
    index = work.save(build_postings(docs, planned.select("term").distinct(), reach), "postings")
    return match_phrases(index, planned, reach)


def proximity(docs: DataFrame, wanted: DataFrame, span: int, work: Work) -> DataFrame:
    """(doc_id, at, phrase): documents in which all words of a phrase stand, in any order, within ``span`` words of a
    posting of its rarest term at ``at``."""
    wanted = work.save(wanted.select("phrase").distinct(), "wanted")
    terms = wanted.select(F.explode("phrase").alias("term")).distinct()
    counts = work.save(document_terms(docs, terms), "counts")
    planned = plan(wanted, counts)
    index = work.save(build_postings(docs, planned.select("term").distinct(), span), "postings")
    got = index.join(_small(planned.select("term", "phrase")), "term")
    return got.where(F.size(F.array_except("phrase", "around")) == 0).select("doc_id", "at", "phrase")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, work: Work | None = None) -> DataFrame:
    """For each row of documents (doc_id, text) and its matches with windows of benchmark items (item_id, text):

    doc_id, n_words, n_hit (words inside a matched window), n_items, items_sha256 (of the sorted ids of items with a
    matched window, joined by commas) and contaminated (n_hit > 0 and 20 * n_hit >= n_words). Item ids that are null
    count as none.
    """
    work = work or Work(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    cut = work.save(windows(items.select("item_id", "text"), size), "windows")
    by_phrase = cut.where("item_id is not null").groupBy("phrase").agg(F.collect_set("item_id").alias("items"))
    hits = phrases(docs, cut, work)
    flat = hits.select("key", "doc_id", F.explode("found").alias("f")).select("key", "doc_id", "f.start", "f.phrase")
    known = flat.join(F.broadcast(by_phrase) if _fits(by_phrase) else by_phrase, "phrase", "left")
    per = known.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("phrase")).alias("stop")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end")),
        lambda a: a["n"],
    )
    per = per.select("key", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").alias("ids"))
    every = docs.select(_key().alias("key"), "doc_id", F.size(words("text")).cast("long").alias("n_words"))
    out = every.join(per, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _fits(by_phrase: DataFrame) -> bool:
    n = by_phrase.agg(F.sum(F.octet_length(F.array_join("phrase", " ")) + 8 * F.size("items") + 64)).first()[0] or 0
    return n <= BROADCAST_BYTES
