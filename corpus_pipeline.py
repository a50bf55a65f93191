"""A pipeline over documents: STAGES in order, each written as Parquet and read again as the next one's input.

1. language id: documents that are judged `und` go, that is those whose text is null or has no letter;
2. n-gram Jaccard join: of each group of linked documents one stays, the one with the least id (a null id is the
   greatest, and of several texts with that id the one with the least hash); equal rows are one;
3. decontamination: contaminated documents go;
4. mixing: each document stays as often as the mix takes it, that is 0, 1 or 2 times;
5. token ids: what is left is written as seekable token files; the rows are read back from them.

Decisions hold for rows, told apart by a hash of all their columns, so null and repeated ids do no harm. What a stage
drops is joined with the documents, not what it keeps, so few rows meet the texts. Stages 1 to 4 return the columns that
they got, whatever further ones there are. Null texts and empty ones go in stage 1. Very long texts are read whole in
each stage. Empty tables pass all stages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from sievelight.llm.decontaminate import decontaminate
from sievelight.llm.jaccard import jaccard_components
from sievelight.llm.langid import identify
from sievelight.llm.mixing import OUT, label_weights, mix
from sievelight.llm.seekable import token_rows, vocabulary
from sievelight.llm.work import Work

def _fresh(docs: DataFrame, name: str = "_") -> str:
    """A name that no column has."""
    while any(c.lower() == name for c in docs.columns):
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of their row, and its name."""
    name = _fresh(docs)
    return docs.withColumn(name, F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))])), name


def _without(docs: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """The rows whose hash isn't in ``keys`` (one column)."""
    return docs.join(keys.toDF(name), name, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    judged = identify(rows.select("doc_id", "text", "lang", F.col(key).alias("key")), keep=("key",))
    return _without(rows, key, judged.where("lang_pred = 'und'").select("key").distinct()).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Work(spark)
    rows, key = _keyed(docs)
    parts = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), work=work).groupBy("doc_id").agg(F.first("component_id").alias("part"), F.count("*").alias("n"))
    parts = parts.join(rows.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("id")).distinct(), "doc_id")
    parts = work.save(parts.select(F.col("doc_id").alias("key"), "part", "n", F.struct(F.col("id").isNull(), "id", "doc_id").alias("order")), "groups")
    first = work.save(parts.groupBy("part").agg(F.min("order").alias("least")), "first")  # written, so that a large group is split by the join
    gone = parts.join(first, "part").where("order <> least").select("key")
    kept = _without(rows, key, gone)
    twice = parts.where("n > 1").select("key")
    if not twice.isEmpty():
        once = rows.dropDuplicates([key]).join(twice.toDF(key), key, "left_semi")
        kept = _without(kept, key, twice).unionByName(_without(once, key, gone))
    return kept.drop(key)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    judged = decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, key, judged.where("contaminated").select("doc_id").distinct()).drop(key)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: _fresh(docs, f"own_{c}") for c in docs.columns if c in OUT}
    taken = mix(docs.withColumnsRenamed(own), quality=label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("copies > 0")
    nth = _fresh(docs, "nth")
    back = taken.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(nth))
    return back.drop(nth)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_rows(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmarks),
    ("mixing", mixture),
    ("token_ids", token_ids),
]

#: Language id, components of large tables and tokenizers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table of documents."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
