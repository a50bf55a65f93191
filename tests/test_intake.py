"""Versions of tables, mixed folders and citations, paged sources, promotion, and the model tier."""

import json
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievelight.operators import models, promotion
from sievelight.operators import screen as sc
from sievelight.plans.intake import NationPages
from sievelight.sources import documents, files, paged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, payload string")


def test_readers_never_see_none_and_commits_that_cross_are_conflicts(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    assert files.version(spark, root) == 0 and files.contents(spark, root) == {}
    files.release({"a": spark.range(10), "b": spark.range(3)}, root)
    stop, seen, errors = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(len(files.contents(spark, root)))
            except Exception as e:
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(4):
            files.commit(spark, root, added={"a": spark.range(i)})
    finally:
        stop.set()
        reader.join()
    assert not errors and set(seen) == {2} and len(seen) > 5
    assert files.version(spark, root) == 5 and files.released(spark, root, "a").count() == 16 and files.released(spark, root, "a", 1).count() == 10
    with pytest.raises(files.Conflict):
        files.commit(spark, root, replaced={"b": spark.range(1)}, base=4)
    with pytest.raises(ValueError):
        files.commit(spark, root, replaced={"b": spark.range(1)}, least={"b": 2})
    assert files.version(spark, root) == 5 and files.released(spark, root, "b").count() == 3
    assert not files._publish(spark, root, 5, "{}")  # a number that is taken
    done = []

    def write(n):
        done.append(files.commit(spark, root, added={"b": spark.range(n)}))

    writers = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == [6, 7] and files.released(spark, root, "b").count() == 15  # none is lost


def test_documents_of_four_kinds(spark, tmp_path):
    root = tmp_path / "src"
    (root / "deep").mkdir(parents=True)
    many = [json.dumps({"n": i, "text": f"line {i} ü"}) for i in range(5000)]
    (root / "a.jsonl").write_text("\n".join([many[0], "", "  ", *many[1:]]) + "\n")
    (root / "deep" / "b b+c.jsonl").write_text('["x", "y"]')
    (root / "c.json").write_text('{"t": {"a/b": ["p", {"q~": "deep"}]}, "n": 3}')
    (root / "d.py").write_text('"""Doc."""\nA = "one"\nclass K:\n    """Inner."""\n    B: str = "two"\n    def f(self):\n        C = "three"\nA = "last"\nN = 5\n')
    spark.range(300).select("id", F.concat(F.lit("row "), "id").alias("text")).repartition(1).write.parquet(f"file://{root}/e")
    conf = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "20000")  # several splits for each file
    try:
        got = documents.documents(spark, f"file://{root}")
        assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"jsonl": 5001, "json": 1, "py": 1, "parquet": 300}
        places = {r.pos: json.loads(r.value)["n"] for r in got.where("path = 'a.jsonl'").collect()}
        assert places == {i + 1: i for i in range(5000)}
        part = got.where("kind = 'parquet'").first().path
        cited = [
            ("a.jsonl", "jsonl:1/text", "line 0 ü"), ("a.jsonl", "jsonl:4321/text", "line 4320 ü"), ("deep/b b+c.jsonl", "jsonl:1/1", "y"), ("c.json", "json:/t/a~1b/1/q~0", "deep"), (part, "parquet:57/text", "row 57"),
            ("d.py", "py:A", "one"), ("d.py", "py:K.B", "two"), ("d.py", "py:K.f.C", "three"), ("d.py", "py:__doc__", "Doc."), ("d.py", "py:K.__doc__", "Inner."),
            ("a.jsonl", "jsonl:0/text", None), ("a.jsonl", "jsonl:9999/text", None), ("a.jsonl", "jsonl:1/n", None), ("a.jsonl", "jsonl:1", None), ("c.json", "json:t", None), ("c.json", "json:/t", None), ("d.py", "py:N", None), ("d.py", "py:Z.A", None),
            ("c.json", "py:A", None), ("a.jsonl", "odd:1", None), ("none.json", "json:/t", None), ("a.jsonl", None, None), (part, "parquet:300/text", None), ("a.jsonl", "jsonl:99999999999999999999/text", None),
        ]
        c = spark.createDataFrame(cited, "path string, record_id string, want string")
        out = documents.resolve(c, got, strict=False).collect()
        assert len(out) == len(cited) and all(r.text == r.want for r in out), [r for r in out if r.text != r.want]
        assert documents.resolve(c.where("want is not null"), got).count() == 10
        with pytest.raises(Exception, match="leads to no text"):
            documents.resolve(c, got).collect()
    finally:
        spark.conf.set(conf, old)
    (root / "bad.jsonl").write_text("{")
    with pytest.raises(Exception, match="not JSON"):
        documents.documents(spark, f"file://{root}").collect()
    (root / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="x.txt"):
        documents.documents(spark, f"file://{root}")
    (tmp_path / "none").mkdir()
    assert documents.documents(spark, f"file://{tmp_path}/none").count() == 0


class Odd(NationPages):
    def page(self, number, size):
        got = super().page(number, size)
        how = json.loads(self._how)[0]
        if number == 2:
            if how == "stale":
                got["rows"] = super().page(1, size)["rows"]
            if how == "numbers":
                got["page"] = 7
            if how == "empty":
                got["rows"] = []
            if how == "long":
                got["rows"] = got["rows"] * 2
        return got

    def __init__(self, options):
        super().__init__(options)
        self._how = options["how"]


def test_paged_source(spark):
    rows = json.dumps([(i, f"b{i}") for i in range(25)])
    pages = paged.paged(spark, NationPages, rows=rows, page_size=10)
    assert pages.rdd.getNumPartitions() == 3
    got = paged.captured(pages).collect()
    assert sorted((int(r.id), r.page, r.pos, r.body) for r in got) == [(i, i // 10 + 1, i % 10, f"b{i}") for i in range(25)]
    assert tuple(paged.coverage(pages).first()) == (25, 25, 0)
    rest = paged.paged(spark, NationPages, rows=rows, page_size=10, first=3)
    assert rest.count() == 5 and paged.captured(rest, known=pages.where("page < 3")).count() == 5
    with pytest.raises(Exception, match="no new id"):
        paged.captured(rest, known=pages).collect()
    assert paged.paged(spark, NationPages, rows="[]", page_size=10).count() == 0
    for how, said in (("stale", "no new id"), ("numbers", "other numbers"), ("empty", "no rows"), ("long", "other numbers")):
        with pytest.raises(Exception, match=said):
            paged.captured(paged.paged(spark, Odd, rows=rows, page_size=10, how=json.dumps([how]))).collect()
    with pytest.raises(Exception):
        paged.paged(spark, NationPages, rows=rows, page_size=101).count()


LONG = " ".join(f"word{i}" for i in range(40))


def test_promotion(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    promotion.start(spark, root, {"training_attacks": table(spark, [("a1", "drain the wallet")]), "training_benign": table(spark, [("b1", "good morning")]), "held_out_attacks": table(spark, [("h1", LONG)])})
    batch = [("n1", "a fresh text"), ("n2", "another one"), ("b1", "good morning")]
    with pytest.raises(ValueError):
        promotion.promote(table(spark, batch), root, "training_benign")
    with pytest.raises(ValueError):
        promotion.promote(table(spark, batch), root, "held_out_benign", approved=True)
    with pytest.raises(ValueError):
        promotion.promote(table(spark, []), root, "training_benign", approved=True)
    before = files.version(spark, root)
    assert promotion.promote(table(spark, batch), root, "training_benign", approved=True) == 2
    assert files.version(spark, root) == before + 1
    assert promotion.promote(table(spark, batch[::-1]), root, "training_benign", approved=True) == 0  # the same rows again
    assert files.version(spark, root) == before + 1
    assert sorted(r.id for r in files.released(spark, root, "training_benign").collect()) == ["b1", "n1", "n2"]
    assert files.released(spark, root, "batches").count() == 1 and files.released(spark, root, "decontamination").count() == 2
    near = LONG.replace("word7 ", "word7x ")
    bad = [
        (None, "text"), ("", "text"), ("x1", "  "), ("x2", None), ("x3", "same"), ("x3", "other"), ("x4", "Twice  said"), ("x5", "twice said"), ("a1", "drain the wallet"), ("n1", "another text"), ("x6", "GOOD morning"),
        ("x7", near), ("x8", "ＦＲＥＳＨ"), ("x9", "good  morning"), ("n2", "another one"),
    ]
    tables = {n: files.released(spark, root, n) for n in promotion.TABLES}
    got = {}
    for r in promotion.review(table(spark, bad), tables, "training_benign").collect():
        got.setdefault(r.id, []).append(r.decision)
    assert {k: sorted(v) for k, v in got.items()} == {
        None: ["unnamed"], "": ["unnamed"], "x1": ["blank"], "x2": ["blank"], "x3": ["new", "same id"], "x4": ["new"], "x5": ["same text"], "a1": ["id taken"], "n1": ["id taken"], "x6": ["text taken"],
        "x7": ["leak"], "x8": ["new"], "x9": ["same text"], "n2": ["present"],
    }
    with pytest.raises(promotion.Rejected) as e:
        promotion.promote(table(spark, [("m1", "fine"), ("m2", near)]), root, "training_attacks", approved=True)
    assert [r.id for r in e.value.decisions.collect()] == ["m2"]
    assert files.version(spark, root) == before + 1 and files.released(spark, root, "training_attacks").count() == 1
    assert promotion.digest(table(spark, [("a", "b"), ("a", "b")])) != promotion.digest(table(spark, []))


class Counting:
    """Writes a file for each load and a line for each text that it is asked about."""

    def __init__(self, folder):
        self.folder = folder

    def load(self):
        import uuid

        name = f"{self.folder}/{uuid.uuid4().hex}"
        open(name, "x").close()

        def ask(texts):
            with open(name, "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            if any("break" in t for t in texts):
                raise RuntimeError("broken")
            known = {"attack": (True, 0.9, "r", "TOOL_HIJACK"), "weak": (True, 0.7, "r", "TOOL_HIJACK"), "odd": (True, 0.9, "r", None), "nan": (False, float("nan"), "r", None), "bool": (1, 0.9, "r", "TOOL_HIJACK")}
            return [dict(zip(("flagged", "confidence", "reason", "category"), known.get(t, (False, 0.1, "r", None)))) for t in texts]

        return ask


class Broken:
    def load(self):
        raise OSError("no model")


class Vectors:
    def load(self):
        return lambda texts: [(0.82 if "near" in t else 2.0 if "wild" in t else -1.0, "phrase") for t in texts]


def test_model_tier(spark, tmp_path):
    texts = ["attack", "weak", "odd", "nan", "bool", "clean", "break me", "found", None, "  ", *["clean"] * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    hit = F.array(F.struct(F.lit("c").alias("category"), F.lit("m").alias("match"), F.lit(0.5).alias("confidence"), F.lit(1).alias("layer")))
    df = df.withColumn("detections", F.when(F.col("text") == "found", hit).otherwise(F.array().cast(f"array<{sc.DETECTION}>")))
    got = {r.i: r for r in models.with_models(df, classifier=Counting(str(tmp_path))).collect()}
    loads = list(tmp_path.iterdir())
    asked = [x for f in loads for x in f.read_text().splitlines()]
    assert 1 <= len(loads) <= 2 and "found" not in asked and {"attack", "clean"} <= set(asked)  # loaded once a task, not asked about what is found
    assert [(got[i].consulted, got[i].failed, [x.category for x in got[i].detections]) for i in range(10)] == [
        (True, False, ["ai_tool_hijack"]), (True, False, []), (True, True, []), (True, True, []), (True, True, []), (True, False, []), (True, True, []), (False, False, ["c"]), (False, False, []), (False, False, []),
    ]
    assert got[0].detections[0].layer == 5 and got[0].detections[0].confidence == 0.9
    broken = models.with_models(df, classifier=Broken())
    assert all(r.failed == r.consulted for r in broken.collect()) and broken.where("failed").count() == 207
    blocked = sc.decide(broken.withColumn("risk", sc.risk_level("detections")), failed=F.col("failed"))
    assert {r.verdict for r in blocked.where("failed").collect()} == {"BLOCK"}
    two = spark.createDataFrame([(1, "near"), (2, "wild"), (3, "attack")], "i int, text string").withColumn("detections", F.array().cast(f"array<{sc.DETECTION}>"))
    out = {r.i: r for r in models.with_models(two, embedding=Vectors(), classifier=Counting(str(tmp_path))).collect()}
    assert [(x.layer, x.category) for x in out[1].detections] == [(4, "embedding_match")] and out[2].failed and [x.layer for x in out[3].detections] == [5]
