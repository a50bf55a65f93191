"""Queries read whole tables, and whole texts."""

import os

from pyspark.sql import functions as F

from sievelight import plans
from sievelight.plans import screening

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_document_is_screened_whole(spark):
    raw = documents(spark)
    got = {r.doc_id: r.text for r in screening.spiked(spark, SF).collect()}
    assert got.keys() == raw.keys()
    assert all(got[k] == t if k % 3 else got[k].startswith(t + " ") for k, t in raw.items())
    assert {got[k][len(t) + 1 :] for k, t in raw.items() if k % 3 == 0} == set(screening.SPIKES)
    assert sum(r.n for r in plans.QUERIES["entry_screen"](spark, SF).collect()) == len(raw)


def test_all_events_of_a_user_count(spark):
    events = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id").collect():
        events.setdefault(r.user_id, []).append(r.event_id)
    got = {r.user_id: {(x.category, x.layer, x.confidence) for x in r.dets} for r in screening._made(spark, SF).collect()}
    assert got.keys() == events.keys()
    cats = list(screening.R.CATEGORY_CLASS)[:7]
    for k, ids in events.items():
        top = {}
        for i in ids:
            at = cats[i % 7], i % 3 + 1
            top[at] = max(top.get(at, 0), i % 41 / 40)
        assert got[k] == {(*at, c) for at, c in top.items()}


def test_whole_texts_are_decoded(spark):
    raw = documents(spark)
    for name in ("fn_dec_b64", "fn_dec_hex", "fn_dec_xesc"):
        got = {r.doc_id: r.decoded for r in plans.QUERIES[name](spark, SF).collect()}
        assert got.keys() == raw.keys()
        assert all(t is None or t == raw[k] for k, t in got.items())
        assert sum(t is not None for t in got.values()) > 0.9 * len(raw) and max(len(t) for t in got.values() if t) > 1000


def test_windows_beyond_the_first_count(spark):
    from sievelight.functions import text as tx

    text = "12345 " * 20 + "and then come letters " * 20
    e = spark.createDataFrame([(text,)], "t string").select(F.base64(F.col("t").cast("binary")).alias("e")).select(F.regexp_replace("e", r"\s", "").alias("e"))
    assert e.select(tx.decode_base64("e").alias("d")).first().d == [text]


def test_sharp_s_has_a_canonical_key(spark):
    raw = documents(spark)
    got = {r.doc_id: r.key for r in plans.QUERIES["fn_canonical"](spark, SF).collect()}
    assert got.keys() == raw.keys() and any("ß" in t for t in raw.values())


def test_forms_of_all_documents_meet(spark):
    sides = [[], []]
    for k, t in documents(spark).items():
        sides[k % 2].append(set(t.lower().split(" ")))
    known = set().union(*sides[0])
    want = {}
    for forms in sides[1]:
        for f in forms & known:
            want[f] = want.get(f, 0) + 1
    assert {r.form: r.n for r in plans.QUERIES["jn_equivalence"](spark, SF).collect()} == want
    assert any(len(f) <= 6 for f in want)
