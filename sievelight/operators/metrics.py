"""Detection metrics, threshold selection, k-anonymous reports and availability, over tables of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions import stats as st

from .running import running


def _zero(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole), digits), F.lit(0.0))


def confusion(cases: DataFrame, thresholds: DataFrame, score: str = "score", attack: str = "attack") -> DataFrame:
    """One row for each of ``thresholds`` (threshold): tp, fp, tn, fn, precision, recall, fpr, f1.

    Cases are first summed by score, so the join with the thresholds (which the caller bounds) meets each distinct
    score once.
    """
    by = cases.groupBy(F.col(score).alias("s")).agg(F.count_if(attack).alias("a"), F.count_if(~F.col(attack)).alias("b"))
    at = F.broadcast(thresholds).join(by, how="cross").groupBy("threshold").agg(
        F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("a")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("b")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("s") < F.col("threshold"), F.col("b")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("s") < F.col("threshold"), F.col("a")).otherwise(0)).alias("fn"),
    )
    return _measures(at)


def _measures(at: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    at = at.withColumns({"precision": _zero(tp, tp + fp), "recall": _zero(tp, tp + fn), "fpr": _zero(fp, fp + tn)})
    return at.withColumn("f1", _zero(2.0 * tp, 2 * tp + fp + fn))


def sweep(cases: DataFrame, score: str = "score", attack: str = "attack") -> DataFrame:
    """The measures at every distinct score, by running sums over scores instead of a join with all of them.

    The running sums are over the distinct scores only, by ranges of them.
    """
    by = cases.groupBy(F.col(score).alias("threshold")).agg(F.count_if(attack).alias("a"), F.count_if(~F.col(attack)).alias("b"))
    at = running(by, [F.desc("threshold")], {"tp": "a", "fp": "b"})
    all_ = cases.agg(F.count_if(attack).alias("pa"), F.count_if(~F.col(attack)).alias("pb"))  # one row
    at = at.crossJoin(F.broadcast(all_))
    return _measures(at.select("threshold", "tp", "fp", (F.col("pb") - F.col("fp")).alias("tn"), (F.col("pa") - F.col("tp")).alias("fn")))


def average_precision(cases: DataFrame, score: str, attack: Column, by: list[str]) -> DataFrame:
    """(by..., precision): of each group the sum of precisions at its distinct scores, weighted by the steps of recall; 0
    without attacks. Running sums go over all groups' distinct scores by ranges; what stands before a group is taken off."""
    s = cases.groupBy(*by, F.col(score).alias("_at")).agg(F.count_if(attack).alias("a"), F.count("*").alias("n"))
    at = running(s, [*[F.col(b) for b in by], F.desc("_at")], {"ra": "a", "rn": "n"})
    start = at.groupBy(*by).agg(F.min(F.col("ra") - F.col("a")).alias("before_a"), F.min(F.col("rn") - F.col("n")).alias("before_n"), F.sum("a").alias("all"))
    at = at.join(start, by)
    step = F.col("a") * (F.col("ra") - F.col("before_a")) / (F.col("rn") - F.col("before_n")) / F.nullif(F.col("all"), F.lit(0))
    return at.groupBy(*by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("precision"))


def select_threshold(cases: DataFrame, score: str = "score", attack: str = "attack") -> DataFrame:
    """The distinct score with no false positive and some true one that is best by recall, f1, precision, then least."""
    ok = sweep(cases, score, attack).where("fp = 0 and tp > 0")
    key = F.struct("recall", "f1", "precision", (-F.col("threshold")).alias("t"))
    return ok.agg(F.max_by(F.struct("threshold", "tp", "fp", "tn", "fn", "precision", "recall", "fpr", "f1"), key).alias("x")).where("x is not null").select("x.*")


def recall_at_fpr(cases: DataFrame, bound: float, score: str = "score", attack: str = "attack") -> DataFrame:
    return sweep(cases, score, attack).where(F.col("fpr") <= bound).agg(F.coalesce(F.max("recall"), F.lit(0.0)).alias("recall"))


def exact_quantiles(df: DataFrame, x: str, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """sorted[int(n q)] of each group, without interpolation, and min, max, mean; over counts of distinct values."""
    per = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    up = per.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy(x))).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    pick = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * q), F.col("all") - 1), F.col(x))).alias(name) for name, q in quantiles.items()]
    return up.groupBy(*by).agg(F.min(x).alias("least"), *pick, F.max(x).alias("most"), (F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias("mean"))


def k_anonymous(records: DataFrame, key: str, position: str, cells: list[str], k: int = 5) -> DataFrame:
    """Counts by cell of the first record of each key; cells of fewer than ``k`` are left out."""
    first = records.groupBy(key).agg(F.min_by(F.struct(*cells), position).alias("c"))
    return first.groupBy(*[F.col(f"c.{c}").alias(c) for c in cells]).agg(F.count("*").alias("n")).where(F.col("n") >= k)


def availability(samples: DataFrame, ts: str, ready: str, by: list[str], slot: int = 300) -> DataFrame:
    """By month: a slot is ready if all of its samples are; a slot without samples is not. Percent with 4 decimals."""
    s = samples.select(*by, st.month_bounds(ts, slot).alias("m"), F.floor(F.unix_timestamp(ts) / slot).alias("slot"), F.col(ready).alias("r"))
    slots = s.groupBy(*by, "m", "slot").agg(F.every("r").alias("r"))
    got = slots.groupBy(*by, "m").agg(F.count_if("r").alias("ready_slots"), F.count("*").alias("seen_slots"))
    return got.select(*by, F.date_format("m.first", "yyyy-MM").alias("month"), "ready_slots", "seen_slots", F.col("m.slots").alias("expected_slots"), F.round(100.0 * F.col("ready_slots") / F.col("m.slots"), 4).alias("availability"))
