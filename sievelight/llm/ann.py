"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Every tree gives each vector a long string of characters: a character is the one of 32 random directions on which the
vector's projection is largest, with its sign. A tree keeps its strings in a sorted array. A query descends to its
longest matching prefix in each tree and then ascends in all trees at once, one character a time; at each depth, every
entry that shares the prefix in a tree gets a credit there, so that an entry's credits are the sum of its matching
prefixes over all trees. The ascent ends once enough entries have 8 credits; those with the most credits are candidates,
which are ranked by the exact inner product. For vectors of different lengths, one more coordinate makes all index
vectors equally long, which turns the largest inner product into the nearest direction.

Recall at 20 of the least favourable table measured, random directions in 64 dimensions with neighbours at 60 degrees
and more, is held by a test at these parameters. There, the prefixes of length one are needed for most queries;
vectors with closer neighbours are found deeper, among fewer.

Equal vectors are one entry, which carries its least ids, as many as a query may return plus its own: no more of them
can be among the results. So a vector that a third of all rows share makes no heavy bucket. Entries are dealt into
shards of even size, each a forest of its own; queries are a stated set, sent to all shards in blocks of bounded size,
and each shard's best are merged in two steps. So work grows as queries times shards.

Vectors that are null, zero, of another length than the most common one (the least of equally common ones), or with
null or non-finite components take no part. Ids are integers; rows with a null id take no part, repeated rows count as
rows with equal ids. Other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .work import Work

#: Trees, characters of a string, and directions that a character chooses from.
TREES, DEPTH, DIRECTIONS = 144, 3, 32
#: Candidates of a shard: this share of its entries, and so many at least. Entries of a shard, queries of a block.
SHARE, LEAST, SHARD, BLOCK = 1 / 20, 512, 16384, 16384
#: Credits at which an entry counts as met.
SURE = 8


class Forest:
    """Sorted arrays of hash strings over the rows of ``x``."""

    def __init__(self, x: np.ndarray, longest: float, trees: int = TREES, depth: int = DEPTH, directions: int = DIRECTIONS, seed: int = 3):
        self.x = x
        self._trees, self._depth, self._directions, self._longest = trees, depth, directions, longest
        self._bits = (2 * directions - 1).bit_length()
        self._p = np.random.Generator(np.random.PCG64(seed)).standard_normal((trees, x.shape[1] + 1, depth * directions)).astype(np.float32)
        codes = self._codes(x, index=True)
        self._order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self._sorted = np.take_along_axis(codes, self._order, axis=1)

    def _codes(self, x: np.ndarray, index: bool) -> np.ndarray:
        """One row of strings, as numbers, for each tree."""
        rest = np.sqrt(np.maximum(0, self._longest**2 - (x * x).sum(axis=1))) if index else np.zeros(len(x))
        wide, out = np.hstack([x, rest[:, None]]).astype(np.float32), np.zeros((self._trees, len(x)), np.uint32)
        for t in range(self._trees):
            for i in range(0, len(x), 2048):
                y = (wide[i : i + 2048] @ self._p[t]).reshape(-1, self._depth, self._directions)
                at = np.abs(y).argmax(axis=2)
                sign = np.take_along_axis(y, at[:, :, None], axis=2)[:, :, 0] > 0
                for c in range(self._depth):
                    out[t, i : i + 2048] = (out[t, i : i + 2048] << np.uint32(self._bits)) | (2 * at[:, c] + sign[:, c]).astype(np.uint32)
        return out

    def candidates(self, q: np.ndarray, enough: int | None = None) -> Iterator[np.ndarray]:
        """For each query the rows with the most credits, ``enough`` of them at most."""
        enough = max(LEAST, math.ceil(SHARE * len(self.x))) if enough is None else enough
        codes = self._codes(q, index=False)
        lo, hi = (np.zeros((self._depth + 1, self._trees, len(q)), np.int64) for _ in range(2))
        for depth in range(1, self._depth + 1):
            shift = np.uint32(self._bits * (self._depth - depth))
            for t in range(self._trees):
                first = (codes[t] >> shift) << shift
                lo[depth, t] = np.searchsorted(self._sorted[t], first)
                hi[depth, t] = np.searchsorted(self._sorted[t], first | ((np.uint32(1) << shift) - np.uint32(1)), "right")
        for i in range(len(q)):
            credits = np.zeros(len(self.x), np.int64)
            for depth in range(self._depth, 0, -1):
                some = [self._order[t, a:b] for t, (a, b) in enumerate(zip(lo[depth, :, i].tolist(), hi[depth, :, i].tolist())) if a < b]
                if some:
                    credits += np.bincount(np.concatenate(some), minlength=len(credits))
                if np.count_nonzero(credits >= SURE) >= enough:
                    break
            if enough >= len(credits):  # up to the root, which all share
                yield np.arange(len(credits))
                continue
            least = np.partition(credits, len(credits) - enough)[len(credits) - enough]
            more, equal = np.flatnonzero(credits > least), np.flatnonzero(credits == least)
            yield np.sort(np.concatenate([more, equal[: enough - len(more)]]))  # of equal ones the first

    def best(self, q: np.ndarray, k: int, enough: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for v, c in zip(q, self.candidates(q, enough)):
            s = self.x[c] @ v
            if len(s) > k:  # all that tie with the k-th stay
                least = np.partition(s, len(s) - k)[len(s) - k]
                c, s = c[s >= least], s[s >= least]
            yield c, s


def usable(vector: str) -> Column:
    v = F.col(vector)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, work: Work | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) where ``queries`` holds, among all other rows."""
    spark = vectors.sparkSession
    if not isinstance(vectors.schema["vec_id"].dataType, IntegralType):
        raise TypeError("ids must be integers")
    work = work or Work(spark)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    sizes = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return none
    # -0.0 and 0.0 are one value
    v = v.where(F.size("embedding") == sizes[0].d).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    entries = work.save(_merge_ids(v, k + 1, sizes[0].n), "entries")
    stats = entries.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    shards = max(1, -(-stats.n // SHARD))
    asked = work.save(v.where(queries).withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = -(-asked.count() // BLOCK)
    found = none.select(F.lit(0).alias("shard"), "query_id", "vec_id", "score")
    for b in range(blocks):
        found = found.union(_search(entries, asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b), shards, stats.longest, k))
    # the best k of all shards, in two steps, so that no list grows with the number of shards but for its root
    for by in (["query_id", F.pmod("shard", F.lit(math.isqrt(shards) + 1)).alias("shard")], ["query_id", F.lit(0).alias("shard")]):
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
        found = found.groupBy(*by).agg(top.alias("top")).select("query_id", "shard", F.posexplode("top").alias("p", "t"))
        found = found.select("shard", "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
    return found.select("query_id", "rank", "vec_id", "score")


def _merge_ids(v: DataFrame, most: int, rows: int) -> DataFrame:
    """(embedding, ids, r): distinct vectors, told apart by two hashes, with their least ids, in order, at most so many.

    Ids are reduced in three steps, so that those of a vector shared by very many rows never meet in one list.
    """
    salts = max(1, rows // 1024)
    v = v.select(F.xxhash64("embedding").alias("r"), F.xxhash64(F.lit(1), "embedding").alias("r2"), "embedding", F.array("vec_id").alias("ids"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"))
    for by in (F.col("salt"), F.pmod("salt", F.lit(math.isqrt(salts) + 1)), F.lit(0)):
        v = v.groupBy("r", "r2", by.alias("salt")).agg(F.first("embedding").alias("embedding"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))
    return v.select("embedding", "ids", "r")


def _search(entries: DataFrame, block: DataFrame, shards: int, longest: float, k: int) -> DataFrame:
    got = block.select("vec_id", "embedding").toPandas().sort_values("vec_id", kind="stable")  # about BLOCK rows
    ids = got["vec_id"].to_numpy(np.int64)
    q = np.stack(got["embedding"].tolist()).astype(np.float64) if len(got) else np.zeros((0, 1))
    sent = entries.sparkSession.sparkContext.broadcast((ids, q))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, q = sent.value
        pdf = pdf.sort_values("r")
        x = np.stack(pdf["embedding"].tolist()).astype(np.float64)
        own = [np.asarray(i, np.int64) for i in pdf["ids"]]
        rows = []
        if len(q):
            for qid, (c, s) in zip(ids.tolist(), Forest(x, longest).best(q, k + 1)):
                vec = np.concatenate([own[i] for i in c]) if len(c) else np.zeros(0, np.int64)
                score = np.repeat(s, [len(own[i]) for i in c])
                here = vec != qid
                vec, score = vec[here], score[here]
                o = np.lexsort((vec, -score))[:k]
                rows.append((np.full(len(o), qid), vec[o], score[o]))
        out = {n: np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i, n in enumerate(("query_id", "vec_id", "score"))}
        return pd.DataFrame({"shard": np.full(len(out["score"]), pdf["shard"].iloc[0])} | out)

    dealt = entries.withColumn("shard", F.pmod("r", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(find, "shard int, query_id long, vec_id long, score double")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_nearest": op5_nearest}
SQL: dict[str, str] = {}
