"""Queries of mixed folders and citations, paged sources, promotion, and the model tier."""

import json
import uuid

from pyspark.sql import functions as F

from sievelight.operators import models, promotion
from sievelight.operators import screen as sc
from sievelight.sources import documents as docs_
from sievelight.sources import files, paged
from sievelight.sources.scratch import shared_dir

from .base import query, table
from .screening import spiked


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"


def _mixed(spark, d) -> str:
    """The documents as JSON lines, the benchmark as Parquet, and regions as whole documents, in one folder."""
    root = _folder(spark)
    files.write_jsonl(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), f"{root}/lines")
    _rename(spark, f"{root}/lines", ".txt", ".jsonl")
    table(spark, d, "benchmark").write.parquet(f"{root}/rows")
    regions = table(spark, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value"))
    regions.repartition(1).write.option("lineSep", ",").text(f"{root}/whole")  # 5 rows
    _rename(spark, f"{root}/whole", ".txt", ".json", wrap=True)
    return root


def _rename(spark, folder: str, old: str, new: str, wrap: bool = False) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.endswith(old):
            to = spark._jvm.org.apache.hadoop.fs.Path(at, name[: -len(old)] + new)
            if wrap:  # a few rows become one JSON array
                stream = fs.open(f.getPath())
                text = bytes(x & 255 for x in stream.readAllBytes()).decode().rstrip(",")
                stream.close()
                out = fs.create(to, True)
                out.write(bytearray(f"[{text}]".encode()))
                out.close()
                fs.delete(f.getPath(), False)
            else:
                fs.rename(f.getPath(), to)


@query("src_document", "select 'jsonl' as kind, count(*) as records from documents where text is not null union all select 'parquet', count(*) from benchmark union all select 'json', 1")
def src_document(spark, d):
    return docs_.documents(spark, _mixed(spark, d)).groupBy("kind").agg(F.count("*").alias("records"))


@query("src_locator", "select 'jsonl' as kind, doc_id as id, sha256(text) as h from documents where text is not null union all select 'parquet', item_id, sha256(text) from benchmark where text is not null")
def src_locator(spark, d):
    """Every line and row is cited by its place, and the citation leads back to its text."""
    records = docs_.documents(spark, _mixed(spark, d)).where("kind <> 'json'")
    id_ = F.coalesce(F.get_json_object("value", "$.doc_id"), F.get_json_object("value", "$.item_id")).cast("long")
    cited = records.where(F.get_json_object("value", "$.text").isNotNull()).select("path", F.concat_ws("", "kind", F.lit(":"), "pos", F.lit("/text")).alias("record_id"), "kind", id_.alias("id"))
    return docs_.resolve(cited, records).select("kind", "id", F.sha2("text", 256).alias("h"))


class NationPages:
    """Pages of the rows that the options hold."""

    def __init__(self, options: dict):
        self._rows = json.loads(options["rows"])

    def page(self, number: int, size: int) -> dict:
        return {"page": number, "page_size": size, "total": len(self._rows), "rows": [(r[0], r[1]) for r in self._rows[(number - 1) * size : number * size]]}


@query("ud_adapter", "select cast(n_nationkey as varchar) as id, n_name as body, cast(row_number() over (order by n_nationkey) - 1 as int) // 10 + 1 as page, cast(row_number() over (order by n_nationkey) - 1 as int) % 10 as pos from nation")
def ud_adapter(spark, d):
    rows = [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # the 25 nations
    return paged.captured(paged.paged(spark, NationPages, rows=json.dumps(rows), page_size=10)).select("id", "body", "page", "pos")


@query("ml_promote")
def ml_promote(spark, d):
    """All documents without a label of toxicity are reviewed as harmless ones, and the new ones promoted, twice; the benchmark is held out."""
    docs = table(spark, d, "documents")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    named = lambda x, key: x.select(F.col(key).cast("string").alias("id"), F.col("text").alias("payload"))
    root = _folder(spark)
    promotion.start(spark, root, {"training_attacks": named(docs.join(toxic, "doc_id"), "doc_id"), "held_out_attacks": named(table(spark, d, "benchmark"), "item_id").withColumn("id", F.concat(F.lit("b"), "id"))})
    batch = named(docs.join(toxic, "doc_id", "left_anti"), "doc_id")
    tables = {n: files.released(spark, root, n) for n in promotion.TABLES}
    decided = promotion.saved(promotion.review(batch, tables, "training_benign"))
    fine = decided.where("decision = 'new'").select("id", "payload")
    for _ in range(2):  # the second time changes nothing
        promotion.promote(fine, root, "training_benign", approved=True)
    kept = files.released(spark, root, "training_benign").groupBy("id").agg(F.count("*").alias("rows"))
    return decided.join(kept, "id", "left").select("id", "decision", F.coalesce("rows", F.lit(0)).alias("rows"))


class WordModel:
    """Stands for a model: flags texts of two words' presence."""

    def load(self):
        return lambda texts: [{"flagged": " garden" in t, "confidence": 0.9 if " quiet " in t else 0.5, "reason": "words", "category": "PROMPT_INJECTION" if " garden" in t else None} for t in texts]


_ASKED = "select doc_id, coalesce(trim(text) <> '', false) as consulted, coalesce(trim(text) <> '' and text like '% garden%' and text like '% quiet %', false) as flagged from (select doc_id, case when doc_id % 3 = 0 then text || ' A quiet note about gardens.' else text end as text from documents) where doc_id % 2 = 0 union all select doc_id, false, false from documents where doc_id % 2 = 1"


@query("det_semantic", _ASKED)
def det_semantic(spark, d):
    """Rows of odd ids have a detection already, so the model isn't asked about them."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" A quiet note about gardens."))).otherwise(F.col("text"))
    found = F.struct(F.lit("direct_instruction").alias("category"), F.lit("x").alias("match"), F.lit(0.9).alias("confidence"), F.lit(1).alias("layer"))
    df = table(spark, d, "documents").select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 2 == 1, F.array(found)).otherwise(F.array().cast(f"array<{sc.DETECTION}>")).alias("detections"))
    out = models.with_models(df, classifier=WordModel())
    return out.select("doc_id", "consulted", F.exists("detections", lambda x: x["layer"] == 5).alias("flagged"))


@query("ud_model")
def ud_model(spark, d):
    """The model tier behind the screen: verdicts of all documents, with rows that a failing model leaves blocked."""
    out = models.with_models(sc.screen(spiked(spark, d)).drop("verdict", "risk_level", "sanitized", "risk"), classifier=WordModel())
    out = sc.decide(out.withColumn("risk", sc.risk_level("detections")), failed=F.col("failed"))
    return out.select("doc_id", "consulted", "verdict", "risk_level")
