"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts are enough to learn: with the class prior p, the risk of a scorer g is
p E+[l(g)] + E_u[l(-g)] - p E+[l(-g)]. The last two terms estimate the risk on negatives, which can't be below 0; where
the estimate falls below, the step goes the other way (non-negative risk). l is the sigmoid loss, g is linear in
features of the whole text: shares of kinds of characters, repetition and shape of words and lines, and hashed pairs
of bytes. No label, language, source or id is among them.

The prior is the share of positives among the labelled rows, where both labels occur; otherwise it is estimated from
the scores of positives and unlabelled texts: the least ratio, over thresholds, of an upper bound of the share of
unlabelled texts above to the share of positives above.

The classifier is fitted on a bounded sample, the rows with the least hashes: at most POSITIVES trusted and UNLABELLED
other texts. Every text is scored, whole. Null and empty texts are scored as texts without any feature. Without any
positive the score is 0.5 for all. Very long texts count whole, and a score of exactly 0.5 is predicted 1. Repeated rows
each get their row, rows with equal hashes are taken in the order of their ids; an empty table gives none. Other columns
are ignored, whatever their names, and a label of null counts as none. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .langid import held_out
from .words import blocks, texts

POSITIVES, UNLABELLED = 4000, 8000
PAIRS = 512
_KIND = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 0 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t" else 5 if _c in "\r\n\v\f" else 6 if _c in ".,;:'\"()?-" else 7 if _c in "!" else 8 if _c == "|" else 9
DENSE = 20
WIDTH = DENSE + PAIRS


def features(column: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    buf, at = texts(column)
    out = np.zeros((len(at) - 1, WIDTH), np.float32)
    for i, j, h, bounds in blocks(column):
        for r in range(i, j):
            _one(buf[at[r] : at[r + 1]], h[bounds[r - i] : bounds[r - i + 1]], out[r])
    return out


def _one(b: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
    if not len(b):
        return
    kinds = np.zeros(10)
    pairs = np.zeros(PAIRS)
    for k in range(0, len(b), 1 << 20):
        piece = b[k : k + (1 << 20) + 1]
        kinds += np.bincount(_KIND[piece[: 1 << 20]], minlength=10)
        p = piece.astype(np.int64)
        pairs += np.bincount((p[:-1] * 251 + p[1:] * 7919) % PAIRS, minlength=PAIRS)
    out[:10] = kinds / len(b)
    out[10] = np.log1p(len(b)) / 10
    if len(w):
        first = np.sort(w)
        run = np.flatnonzero(np.diff(first, prepend=first[:1] - np.uint64(1)))
        counts = np.diff(np.append(run, len(first)))
        out[11] = len(run) / len(w)
        out[12] = counts.max() / len(w)
        out[13] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
        out[14] = min(len(b) / len(w), 40) / 10
        out[15] = np.log1p(len(w)) / 10
        out[16] = len(run) / np.sqrt(len(w)) / 20
        out[17] = float(len(w) < 20)
        out[18] = kinds[6] / len(w)
        out[19] = (kinds[7] + kinds[9]) / len(w)
    out[DENSE:] = np.sqrt(pairs)
    out[DENSE:] /= max(np.linalg.norm(out[DENSE:]), 1e-12)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from scores of positives and of unlabelled texts."""
    best = 1.0
    for t in np.quantile(positive, np.linspace(0, 0.95, 40)):
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
        best = min(best, (u + slack) / max(p, 1e-9)) if p > 0.1 else best
    return float(np.clip(best, 0.01, 0.99))


class Scorer:
    """A linear scorer on standardised features."""

    def __init__(self, width: int = WIDTH):
        self.mean, self.scale, self.w, self.b = np.zeros(width), np.ones(width), np.zeros(width), 0.0

    def _x(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._x(x) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 300, rate: float = 0.02, ridge: float = 0.03) -> float:
        """Minimises the non-negative risk by Adam; returns the prior used."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        p, u = (self._x(x).astype(np.float32) for x in (positive, unlabelled))
        if prior is None:
            self._descend(p, u, 0.5, steps // 2, rate, ridge, split=True)
            prior = estimate_prior(p @ self.w + self.b, u @ self.w + self.b)
            self.w, self.b = np.zeros_like(self.w), 0.0
        self._descend(p, u, prior, steps, rate, ridge)
        return prior

    def _descend(self, p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, ridge: float, split: bool = False) -> None:
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for k in range(1, steps + 1):
            sp, su = (1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30))) for x in (p, u))
            dp, du = sp * (1 - sp), su * (1 - su)
            # loss of +: 1 - s; loss of -: s
            if split:
                gp, gu = -0.5 * dp / len(p), 0.5 * du / len(u)
            elif su.mean() - prior * sp.mean() >= 0:
                gp, gu = -2 * prior * dp / len(p), du / len(u)
            else:
                gp, gu = prior * dp / len(p), -du / len(u)
            g = np.append(gp @ p + gu @ u + ridge * self.w, gp.sum() + gu.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            self.w -= step[:-1]
            self.b -= step[-1]


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the ``most`` rows (doc_id, text) with the least hashes: ids are chosen first, then their texts are read."""
    keys = rows.select(F.xxhash64("doc_id", F.lit("sample")).alias("h"), F.col("doc_id").alias("id")).distinct().orderBy("h", "id").limit(most)
    chosen = rows.join(F.broadcast(keys.select("id")), F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")

    def cut(batches):
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    got = chosen.mapInArrow(cut, "doc_id long, x binary").toPandas().sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    return np.stack([np.frombuffer(x, np.float32) for x in got["x"]]).astype(np.float64) if len(got) else np.zeros((0, WIDTH))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer from documents (doc_id, text) and labels (doc_id, quality): label 1 is trusted, all else is unlabelled."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("ids must be integers")
    said = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    known = docs.select("doc_id", "text").join(said, F.col("doc_id") == F.col("id"), "left")
    counts = known.groupBy("quality").agg(F.count("*").alias("n")).collect()
    n = {r.quality: r.n for r in counts}
    positive = _sample(known.where("quality = 1").select("doc_id", "text"), POSITIVES)
    unlabelled = _sample(docs.select("doc_id", "text"), UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return None
    out = Scorer()
    out.fit(positive, unlabelled, (n[1] + 1) / (n[1] + n[0] + 2) if n.get(0) else None)
    return out


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents (doc_id, text, held_out)."""

    def rate(batches):
        for b in batches:
            s = scorer.score(features(b.column(2)).astype(np.float64)) if scorer is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(rate, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~F.coalesce(held_out(), F.lit(False)))
    return score(docs, learn(docs.where("not held_out"), labels))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
