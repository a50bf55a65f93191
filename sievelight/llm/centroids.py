"""Centroid clustering over integers: products in float32 screen the centroids, exact integers decide among those left.

A component x becomes floor(scale * x). The squared distances of a vector x to centroids c differ by |c|^2 - 2 x.c only.
The products x.c of a block come from one float32 matrix product. In whatever order a product of d terms is summed, with
or without fused steps, and with both factors rounded to float32 before, it is off by at most g |x| |c|, where
g = m u / (1 - m u), m = d + 3, u = 2^-24. So every centroid has an interval that surely holds its value; those whose
interval reaches below the least upper end stay. Where more than one stays, their distances are computed in integers,
and the lowest number among the least wins. Where float32 could overflow, all are computed in integers.

Each round reads the written integers once: tasks assign their vectors to the centroids, which they get as a broadcast of
k rows, and hand on one row for each cluster, component and limb of 32 bits of its sum, which Spark adds up; k * d sums
reach the driver. Sums and distances are exact at any magnitude: blocks whose values could leave 64 bits take Python's
integers; a distance or inertia beyond a long is given as the largest long.

Vectors that are null, of another length than ``size`` or hold null or non-finite components take no part. Rows with a
null id are clustered, but begin as a centroid only after all others; equal ids begin in the order of their vectors.
Repeated rows count each time. With fewer vectors than k there are as many centroids as vectors. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Work

#: Vectors of a matrix product.
BLOCK = 4096
_U, _LONG, _LIMB = 2.0**-24, 2**63 - 1, 1 << 32
_UP = 1 + 2.0**-40  # norms in float64 are off by far less


def usable(vector: str, size: int) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & fine, F.lit(False))


def _narrow(size: int) -> float:
    """Below this magnitude of both, differences and sums of their squares stay within 64 bits."""
    return 2.0 ** (30 - size.bit_length() / 2)


def _integers(column: pa.Array, size: int, scale: float) -> np.ndarray:
    """floor(scale * x): of int64, or of Python's integers where a value, a difference or a sum of squares could leave 64 bits."""
    x = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size) * scale)
    if not x.size or np.abs(x).max() < _narrow(size):
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(-1, size)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    d = x - c
    return (d * d).sum(axis=1)


class Centroids:
    """Rows of integers that vectors are assigned to."""

    def __init__(self, rows: list[list[int]]):
        self.big = any(abs(v) >= _narrow(len(r)) for r in rows for v in r)
        self.rows = np.array(rows, dtype=object if self.big else np.int64).reshape(len(rows), -1)
        self._squares = [sum(v * v for v in r) for r in rows]
        self._norm = np.sqrt(np.array([float(s) if s < 1e300 else np.inf for s in self._squares])) * _UP
        self._f32 = self.rows.astype(np.float64).astype(np.float32) if not self.big else None
        m = (self.rows.shape[1] + 3) * _U
        self._g = m / (1 - m)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and centroid, bounds of |c|^2 - 2 x.c, from float32 products of int64 vectors."""
        wide = x.astype(np.float64)
        product = (wide.astype(np.float32) @ self._f32.T).astype(np.float64)
        value = np.array(self._squares, dtype=np.float64) - 2 * product
        norm = np.sqrt((wide * wide).sum(axis=1)) * _UP
        reach = 2 * self._g * norm[:, None] * self._norm[None, :]
        reach = reach * _UP + (np.abs(value) + np.array(self._squares, dtype=np.float64)) * 2.0**-50  # float64 roundings above
        return value - reach, value + reach

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector, its exact distance, and how many vectors needed integers to decide."""
        k = len(self.rows)
        if self.big or x.dtype == object:
            x, rows = x.astype(object), self.rows.astype(object)
            every = np.stack([distances(x, r[None, :]) for r in rows], axis=1) if len(x) else np.zeros((0, k), object)
            at = every.argmin(axis=1).astype(np.int64) if len(x) else np.zeros(0, np.int64)
            return at, every[np.arange(len(x)), at], len(x)
        low, high = self.intervals(x)
        stay = low <= high.min(axis=1, keepdims=True)
        at = stay.argmax(axis=1)
        several = np.flatnonzero(stay.sum(axis=1) > 1)
        if len(several):
            row, c = np.nonzero(stay[several])  # by vector, then by number
            exact = distances(x[several[row]], self.rows[c])
            order = np.lexsort((c, exact, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            at[several] = c[first]
        return at, distances(x, self.rows[at]), len(several)


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value % _LIMB))
        value //= _LIMB
    return out


def _blocks(batches, size: int, scale: float):
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            yield part, _integers(part.column(1), size, scale)


def first_centroids(kept: DataFrame, k: int, seed: str, size: int, scale: float) -> list[list[int]]:
    """The k kept vectors with the least SHA-256 of ``<seed>:<id>``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = kept.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    vectors = pa.array([list(r.embedding) for r in got], pa.list_(pa.float64()))
    return [[int(v) for v in row] for row in _integers(vectors, size, scale).tolist()]


def next_centroids(kept: DataFrame, now: list[list[int]], size: int, scale: float) -> list[list[int]]:
    """Each centroid's vectors' floored mean; one without vectors stays."""
    sent = kept.sparkSession.sparkContext.broadcast(now)

    def add_up(batches):
        c = Centroids(sent.value)
        n, sums = [0] * len(sent.value), np.zeros((len(sent.value), size), object)
        for _, x in _blocks(batches, size, scale):
            at, _, _ = c.assign(x)
            for j in np.unique(at).tolist():
                own = x[at == j]
                n[j] += len(own)
                sums[j] += own.sum(axis=0).astype(object)
        rows = [(j, i, p, v) for j in range(len(n)) if n[j] for i in range(size) for p, v in enumerate(_limbs(int(sums[j][i])))]
        rows += [(j, -1, 0, m) for j, m in enumerate(n) if m]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "limb", "value"])

    rows = kept.select("vec_id", "embedding").mapInArrow(add_up, "cluster int, place int, limb int, value long")
    got = rows.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect()  # clusters x components
    total = {}
    for r in got:
        total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + r.value * _LIMB**r.limb
    return [[total.get((j, i), 0) // total[j, -1] for i in range(size)] if (j, -1) in total else row for j, row in enumerate(now)]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", size: int = 64, scale: float = 256.0, work: Work | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of vectors (vec_id, embedding), and the final centroids."""
    work = work or Work(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding", size))
    kept = work.save(kept, "kept")
    now = first_centroids(kept, k, seed, size, scale)
    for _ in range(rounds if now else 0):
        now = next_centroids(kept, now, size, scale)
    sent = kept.sparkSession.sparkContext.broadcast(now)

    def place(batches):
        c = Centroids(sent.value) if sent.value else None
        for b, x in _blocks(batches, size, scale):
            at, d, _ = c.assign(x)
            d = pa.array([min(int(v), _LONG) for v in d.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), d], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(place, f"vec_id {kind}, cluster int, distance long"), now


def summarized(placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows (vec_id, cluster, distance) with cluster_inertia, inertia and centroid_sha256."""
    spark = placed.sparkSession
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))  # a row for each centroid
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    long = lambda c: F.least(c, F.lit(str(_LONG)).cast("decimal(38,0)")).cast("long")
    whole = sums.agg(F.sum("s").alias("all"))  # one row
    per = sums.join(digests, "cluster").crossJoin(F.broadcast(whole))
    per = per.select("cluster", long(F.col("s")).alias("cluster_inertia"), long(F.col("all")).alias("inertia"), "centroid_sha256")
    return placed.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark)
    placed, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), work=work)
    return summarized(work.save(placed, "placed"), centroids)


def _twin(k: int, rounds: int) -> str:
    """The rounds, written out one after the other, over a row for each vector and component."""
    out = f"""
with kept as materialized (select row_number() over (order by vec_id) as row, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as materialized (select row, vec_id, i, cast(floor(256 * cast(embedding[i] as double)) as bigint) as x from kept, range(1, 65) as t(i)),
starts as (select row, row_number() over (order by sha256('2:' || vec_id)) - 1 as c from kept qualify c < {k}),
c0 as materialized (select c, i, x from starts join v using (row))"""
    for r in range(rounds + 1):
        out += f""",
d{r} as materialized (select row, c, cast(sum((v.x - c{r}.x) * (v.x - c{r}.x)) as bigint) as d from v join c{r} using (i) group by row, c),
a{r} as materialized (select row, min(c) as c, any_value(d) as d from (select *, min(d) over (partition by row) as least from d{r}) where d = least group by row)"""
        if r < rounds:
            out += f""",
m{r} as (select a.c, v.i, cast(sum(v.x) as bigint) as s, count(*) as n from a{r} a join v using (row) group by a.c, v.i),
c{r + 1} as materialized (select o.c, o.i, coalesce(cast((m.s - ((m.s % m.n) + m.n) % m.n) / m.n as bigint), o.x) as x from c{r} o left join m{r} m on m.c = o.c and m.i = o.i)"""
    return out + f""",
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select k.vec_id, cast(a.c as integer) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
       cast(sum(a.d) over () as bigint) as inertia, h.centroid_sha256
from a{rounds} a join kept k using (row) join h on h.c = a.c
"""


QUERIES = {"op13_centroids": op13_centroids}
SQL = {"op13_centroids": _twin(40, 5)}
