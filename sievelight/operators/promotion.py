"""Promotion of a reviewed batch into one of the training tables of a released set, and the decisions on its rows.

The set has four tables (id string, payload string): training_attacks, training_benign, held_out_attacks and
held_out_benign; beside them, ``batches`` has the digest of each promoted batch and ``decontamination`` the measures of its
rows. A batch is promoted as a whole or not at all, by one commit that is based on the version that its rows were checked
against: a commit in between is a Conflict, and the check is made anew by calling again. The same batch again changes
nothing.

A row of a batch is: ``unnamed`` or ``blank`` (no id, no text), ``same id`` or ``same text`` as an earlier row of the batch
(in the order of ids), ``present`` (the target has it), ``id taken`` or ``text taken`` (any table or the known phrases have
it otherwise), ``leak`` (near a held-out text by Jaccard or containment), or ``new``. Texts are compared by their canonical
form. Ids are compared as strings; other columns are left out. An empty batch is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import rules as R
from sievelight.functions.text import canonical
from sievelight.sources import files
from sievelight.sources.scratch import saved

from . import near

TABLES = ("training_attacks", "training_benign", "held_out_attacks", "held_out_benign")
FINE = ("new", "present")


class Rejected(ValueError):
    """A batch that can't be promoted; ``decisions`` has its rows."""

    def __init__(self, message: str, decisions: DataFrame):
        super().__init__(message)
        self.decisions = decisions


def digest(batch: DataFrame) -> str:
    """A digest of a batch's rows, whatever their order: their number, and two combinations of hashes, of which repeated rows don't cancel."""
    h = lambda salt: F.sum(F.xxhash64("id", "payload", F.lit(salt)).cast("decimal(38,0)"))
    r = batch.agg(F.count("*").alias("n"), h("a").alias("a"), h("b").alias("b")).first()
    return f"{r.n}-{r.a}-{r.b}"


def review(batch: DataFrame, tables: dict[str, DataFrame], target: str, jaccard: float = near.LEAK_JACCARD) -> DataFrame:
    """(id, payload, decision, jaccard, containment) of every row of a batch (id, payload)."""
    rows = batch.select(F.col("id").cast("string").alias("id"), "payload").withColumn("text", canonical(F.col("payload")))
    rows = saved(rows.withColumns({"row": F.monotonically_increasing_id(), "h": F.sha2("text", 256)}))
    order = F.struct("id", "row")
    # the first row of an id and of a text, each found by one aggregation
    first_id = rows.groupBy("id").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("leads_id"))
    first_text = rows.where("trim(payload) <> ''").groupBy("h").agg(F.min_by("row", order).alias("row")).select("row", F.lit(True).alias("leads_text"))
    old = None
    for name in TABLES:
        t = tables[name].select(F.col("id").cast("string").alias("id"), F.lit(name).alias("of"), "payload")
        old = t if old is None else old.unionByName(t)
    spark = batch.sparkSession
    known = spark.createDataFrame([(None, "known phrases", p) for p in R.KNOWN_INJECTIONS], "id string, of string, payload string")  # a fixed list
    old = saved(old.unionByName(known).select("id", "of", F.sha2(canonical(F.col("payload")), 256).alias("h"), F.sha2("payload", 256).alias("exact")))
    ids = old.where("id is not null").groupBy("id").agg(F.max(F.struct((F.col("of") == target).alias("mine"), "exact")).alias("taken"))
    texts = old.groupBy("h").agg(F.lit(True).alias("text_taken"))
    held = tables["held_out_attacks"].select("id", "payload").unionByName(tables["held_out_benign"].select("id", "payload")).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("held"), F.col("payload").alias("text"))
    own = rows.select("row", F.col("payload").alias("text"))
    j = near.jaccard_leaks(own, held.withColumn("n", F.xxhash64("held", "text")).select("n", "text"), "row", "n").select("row", "jaccard")
    c = near.containment_leaks(own, held.withColumn("n", F.xxhash64("held", "text")).select("n", "text"), "row", "n").groupBy("row").agg(F.max("containment").alias("containment"))
    got = rows.join(first_id, "row", "left").join(first_text, "row", "left").join(ids, "id", "left").join(texts, "h", "left").join(j, "row", "left").join(c, "row", "left")
    there = F.col("taken.mine") & (F.col("taken.exact") == F.sha2("payload", 256))
    decision = (
        F.when(F.coalesce(F.col("id") == "", F.lit(True)), "unnamed").when(F.coalesce(F.trim("payload") == "", F.lit(True)), "blank")
        .when(F.col("leads_id").isNull(), "same id").when(F.col("leads_text").isNull(), "same text").when(F.coalesce(there, F.lit(False)), "present").when(F.col("taken").isNotNull(), "id taken")
        .when(F.col("text_taken"), "text taken").when((F.col("jaccard") >= jaccard) | F.col("containment").isNotNull(), "leak").otherwise("new")
    )
    return got.select("id", "payload", decision.alias("decision"), "jaccard", "containment")


def start(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """The first version of a set; tables that aren't given are empty."""
    none = spark.createDataFrame([], "id string, payload string")
    every = {n: tables.get(n, none).select(F.col("id").cast("string").alias("id"), "payload") for n in TABLES}
    every["batches"] = spark.createDataFrame([], "digest string, target string, rows long")
    every["decontamination"] = spark.createDataFrame([], "digest string, id string, jaccard double, containment double")
    return files.commit(spark, root, replaced=every, base=0)


def promote(batch: DataFrame, root: str, target: str, approved: bool = False) -> int:
    """Adds the batch's new rows to a training table; returns their number, 0 for a batch that was promoted before."""
    spark = batch.sparkSession
    if approved is not True:
        raise ValueError("a reviewer's approval is needed")
    if target not in TABLES[:2]:
        raise ValueError("the target is a training table")
    batch = saved(batch.select(F.col("id").cast("string").alias("id"), "payload"))
    if batch.isEmpty():
        raise ValueError("the batch is empty")
    base = files.version(spark, root)
    mark = digest(batch)
    if not files.released(spark, root, "batches", base).where((F.col("digest") == mark) & (F.col("target") == target)).isEmpty():
        return 0
    decided = saved(review(batch, {n: files.released(spark, root, n, base) for n in TABLES}, target))
    counts = {r.decision: r.n for r in decided.groupBy("decision").agg(F.count("*").alias("n")).collect()}  # a row for each decision
    bad = {k: n for k, n in counts.items() if k not in FINE}
    if bad:
        raise Rejected(f"rows can't be promoted: {bad}", decided.where(~F.col("decision").isin(*FINE)))
    new = decided.where("decision = 'new'")
    n = counts.get("new", 0)
    added = {"batches": spark.createDataFrame([(mark, target, n)], "digest string, target string, rows long"), "decontamination": new.select(F.lit(mark).alias("digest"), "id", "jaccard", "containment")}
    if n:
        added[target] = new.select("id", "payload")
    files.commit(spark, root, added=added, base=base)
    return n
