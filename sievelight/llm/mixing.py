"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / w, exponential with its quality weight w as rate, u being a hash of seed and row. A
source's documents in the order of their keys are a weighted sample without replacement of any length. A source that
is to give more than it holds is taken whole as often as it fits (complete epochs); the rest of its target is filled
from the front of that order, as far as the sum of sizes stays within it.

Quality weights come from ``labels`` where a document has a label: 0.1 to 1, by the mean of its labels. Other documents
have the square of the share of letters and white space among their characters, 0.05 at least.

Texts are read once for sizes and weights, by an Arrow function over their bytes. What follows works on rows of numbers;
the rows returned are joined with their decisions. A source may hold a third of all rows, so its order is never sorted
in one task: sums over 4,096 bins of the key's logarithm find the bin that the cut falls into; sums over 4,096
parts of this bin find the part, a few millionths of the key wide; only that part's documents are sorted. Sources are ranked and filled by prefix sums
over ranges, so that a source for each host does no harm.

A null source is a source, last in order. Null and empty texts have size 0 and are taken for 0 words. Very long texts
are measured whole. Equal rows are one row of the order, with their number; where the cut falls among them, as many are
taken as fit. Rows with null or equal ids differ by their texts. Ids of any kind will do. Other columns are kept; one
that is called size, source_size, target or copies is replaced. Empty tables give no rows; if all sizes are 0, all
targets are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .words import texts
from .work import Work

BINS = 4096
#: Powers of two between which keys are told apart by their places: hashes have 52 bits, weights are between 0.05 and 1.
LOW, HIGH = -56.0, 16.0
OUT = ("size", "source_size", "target", "copies")
#: Copies of one row that a task makes at a time.
COPIES = 4096
_SPACE, _ODD = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
for _c in range(128):
    _ODD[_c] = not (chr(_c).isalpha() or _SPACE[_c])


def measures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of words and the share of letters and white space; 0 and 0 for null and empty texts."""
    buf, at = texts(column)
    size, share = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
    i = 0
    while i < len(size):  # about a MB at a time, so that what is held stays small
        j = min(len(size), max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1))
        part, ends = buf[at[i] : at[j]], at[i : j + 1] - at[i]
        if len(part):
            first = ~_SPACE[part]
            word = first[ends[:-1][ends[:-1] < len(part)]]
            first[1:] &= _SPACE[part[:-1]]
            first[ends[:-1][ends[:-1] < len(part)]] = word  # a text begins anew
            total = lambda v: np.diff(np.append(np.int32(0), np.cumsum(v, dtype=np.int32))[ends])
            size[i:j] = total(first)
            n = total((part & 0xC0) != 0x80).astype(float)
            share[i:j] = np.where(n > 0, 1 - total(_ODD[part]) / np.maximum(n, 1), 0.0)
        i = j
    return size, share


def uniform(*columns: str, seed: int = 7) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of an MD5 digest."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labels (doc_id, quality): 0.1 + 0.9 times the mean; none for documents with null labels only."""
    return labels.groupBy("doc_id").agg((0.1 + 0.9 * F.avg("quality")).alias("weight")).where("weight is not null and doc_id is not null")


def _before(df: DataFrame, order: list[Column], sums: dict[str, str], work: Work) -> DataFrame:
    """The rows with sums of columns over all rows before them: within ranges of the order, and over the ranges."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = work.save(df.withColumns({"_range": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), "ranges")
    all_of = df.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])  # a row for each task
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    start = all_of.select("_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    own = W.partitionBy("_range").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).join(start, "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", "_pos", *[f"_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, work: Work | None = None) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; none gets
    more than ``most`` times its size, and what it would get beyond is shared among the others by weight, until
    nothing is above. Filling by the ratio size / weight does it in one pass: the sources with the least ratios are
    the ones that stop; the first that its share doesn't fill sets the level for itself and all after it.
    """
    work = work or Work(sizes.sparkSession)
    s = _before(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"nth": "one"}, work)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights)).cast("int") + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = _before(s, [F.col("ratio"), F.col("nth")], {"capped": "cap", "used": "weight"}, work)
    total = s.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights"))  # one row
    s = s.crossJoin(F.broadcast(total)).withColumn("level", (F.col("all") * share - F.col("capped")) / (F.col("weights") - F.col("used")))
    s = work.save(s, "levels")
    cut = s.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("ratio", "nth", "level")).alias("cut"))  # one row
    s = s.crossJoin(F.broadcast(cut))
    over = F.coalesce(F.struct("ratio", "nth") >= F.struct("cut.ratio", "cut.nth"), F.lit(False))
    return s.select("source", "source_size", F.round(F.when(over, F.col("weight") * F.col("cut.level")).otherwise(F.col("cap")), 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, quality: DataFrame | None = None, work: Work | None = None) -> DataFrame:
    """The rows of documents (doc_id, text, source, ...) with size, source_size, target, and copies: how often each is taken.

    ``quality`` has weights (doc_id, weight) over 0 of some documents, once for each id.
    """
    work = work or Work(docs.sparkSession)
    docs = docs.drop(*OUT)
    p = "_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    row = F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))])
    plan = _plan(docs.withColumn(f"{p}row", row), f"{p}row", weights, share, most, seed, quality, work)
    plan = plan.toDF(*[f"{p}{c}" for c in plan.columns])
    got = docs.withColumn(f"{p}row", row).join(plan, f"{p}row")
    c = lambda n: F.col(p + n)
    kept = lambda df, copies: df.select(*docs.columns, *[c(n).alias(n) for n in OUT[:3]], copies.alias("copies"))
    out = kept(got.where((c("more") == 0) | (c("more") == c("n"))), c("whole") + (c("more") > 0).cast("long"))
    if plan.where((c("more") > 0) & (c("more") < c("n"))).isEmpty():
        return out
    # the cut falls among equal rows, at most once for each source: they are made anew from one of them
    one = got.where((c("more") > 0) & (c("more") < c("n"))).dropDuplicates([f"{p}row"])
    runs = one.withColumn(f"{p}from", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1, F.lit(COPIES).cast("long")))).repartition(f"{p}row", f"{p}from")
    each = runs.withColumn(f"{p}i", F.explode(F.sequence(c("from"), F.least(c("from") + COPIES, c("n")) - 1)))
    return out.unionByName(kept(each, c("whole") + (c("i") < c("more")).cast("long")))


def _plan(docs: DataFrame, row: str, weights: tuple[float, ...], share: float, most: float, seed: int, quality: DataFrame | None, work: Work) -> DataFrame:
    """(row, n, size, source_size, target, whole, more) of distinct rows, n of each: ``more`` of them are taken once more than ``whole`` times."""

    def measure(batches):
        for b in batches:
            size, share = measures(b.column(4))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(size), pa.array(share)], ["row", "doc_id", "source", "u", "size", "share"])

    kinds = {n: docs.schema[n].dataType.simpleString() for n in ("doc_id", "source")}
    rows = docs.select(F.col(row).alias("row"), "doc_id", "source", uniform("doc_id", "source", "text", seed=seed).alias("u"), "text")
    rows = rows.mapInArrow(measure, f"row long, doc_id {kinds['doc_id']}, source {kinds['source']}, u double, size long, share double")
    # equal rows are one row of the order, with their number
    rows = rows.groupBy("source", "row").agg(F.first("doc_id").alias("doc_id"), F.first("u").alias("u"), F.first("size").alias("size"), F.first("share").alias("share"), F.count("*").alias("n"))
    weight = F.greatest(F.lit(0.05), F.col("share") * F.col("share"))
    if quality is not None:
        rows = rows.join(quality.select("doc_id", "weight"), "doc_id", "left")
        weight = F.coalesce("weight", weight)
    rows = rows.withColumn("key", -F.log("u") / weight).withColumn("all", F.col("size") * F.col("n"))
    # a monotone image of the key that no weight saturates: its logarithm, cut into bins and each bin into parts
    octave = (F.log2(F.greatest(F.col("key"), F.lit(2.0**LOW))) - LOW) / (HIGH - LOW)
    place = F.least(F.floor(octave * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")
    rows = work.save(rows.select("source", "row", "size", "n", "key", "all", place.alias("place")), "keyed")
    aims = targets(rows.groupBy("source").agg(F.sum("all").alias("source_size")), weights, share, most, work)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = work.save(aims.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "aims")
    bin_ = (F.col("place") / BINS).cast("int")
    first = _cut(_with(rows.groupBy("source", bin_.alias("bin")).agg(F.sum("all").alias("sum")), aims.select("source", "left")), "bin")
    first = work.save(first.withColumnRenamed("bin", "cut"), "bins")
    inside = _with(rows, first).where(bin_ == F.col("cut"))
    parts = work.save(_cut(inside.groupBy("source", "place", "left").agg(F.sum("all").alias("sum")), "place").withColumnRenamed("place", "at"), "parts")
    # in the part where the cut falls, the order itself decides; where it falls among equal rows, their number
    last = _with(rows, parts).where(F.col("place") == F.col("at"))
    before = F.coalesce(F.sum("all").over(W.partitionBy("source").orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits = F.when(F.col("size") == 0, F.col("n")).otherwise(F.floor((F.col("left") - before) / F.col("size")))
    last = work.save(last.select("source", "row", F.greatest(F.lit(0), F.least("n", F.when(before <= F.col("left"), fits).otherwise(0))).cast("long").alias("last")), "last")
    end = aims.drop("left").join(parts.select(F.col("source").alias("s"), "at"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full = _with(rows, end).join(last.withColumnRenamed("source", "s"), "row", "left").drop("s")
    more = F.when(F.col("at").isNull(), F.when(F.col("target") >= (F.col("whole") + 1) * F.col("source_size"), F.col("n")).otherwise(0))
    more = more.when(F.col("place") < F.col("at"), F.col("n")).when(F.col("place") == F.col("at"), F.coalesce("last", F.lit(0))).otherwise(0)
    return full.select("row", "n", "size", "source_size", "target", "whole", more.cast("long").alias("more"))


def _with(df: DataFrame, per_source: DataFrame) -> DataFrame:
    right = per_source.withColumnRenamed("source", "s")
    return df.join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _cut(sums: DataFrame, part: str) -> DataFrame:
    """(source, part, left): the first part, in order, at whose end the sum exceeds what is left, and what is left before it."""
    run = F.sum("sum").over(W.partitionBy("source").orderBy(part).rowsBetween(W.unboundedPreceding, 0))
    past = sums.withColumn("run", run).where(F.col("run") > F.col("left"))
    first = past.groupBy("source").agg(F.min(F.struct(part, (F.col("left") - (F.col("run") - F.col("sum"))).alias("left"))).alias("f"))
    return first.select("source", f"f.{part}", "f.left")
