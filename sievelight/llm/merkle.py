"""Merkle manifest of a dataset: a tree of SHA-256 digests for each group, and one over the groups.

A leaf is the digest of a row's columns; leaves of a group stand in the order of their ids. While a level has more than
one node, every 16 consecutive ones (the last run may be shorter, even one) become the digest of their hexadecimal
digests, one after the other. The groups' roots, in the order of the groups, are the leaves of one more tree.

Rows get their places by one sort over ranges of group, id and digest, whatever the size of a group. Levels are built
three at a time: an aligned block of 16 ** 3 nodes is a contiguous matrix of 64 bytes a row; reshaped to 16 digests a row,
its rows are hashed, and so on up. A task goes through its blocks one after the other and holds one of them. The blocks'
digests are the nodes of the next pass, so that the work of all passes but the first is a 4,096th of it.

Proofs go down the same way. A block gets one row more, its header, with the siblings above it; its nodes find theirs by
index arithmetic in the block's matrices. A proof holds the siblings of each level, left to right, and the node's place
among them; folding a leaf into it gives the root. No digest of another block is needed, and no list of nodes leaves a task.

The tables of a manifest (leaves, and a table for each pass) are written in the shared working folder.

Nulls are leaves of ``-`` for the null column; a null group comes first, null ids first in their group. Empty texts are
``0:``. Very long texts are hashed whole, in the JVM. Rows with equal ids stand in the order of their digests; equal rows
are as many leaves, which one stands first is of no effect. Other columns are ignored, whatever their names. An empty
table gives no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import texts
from .work import Work

FANOUT, DEPTH = 16, 3
BLOCK = FANOUT**DEPTH
_HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of values, each as ``-`` for null, else the number of its UTF-8 bytes, a colon and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))]
    return F.sha2(F.concat(*parts), 256)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def matrix(column: pa.Array) -> np.ndarray:
    """The digests of a column without nulls as one row of 64 bytes each."""
    buf, at = texts(column)
    return buf[at[0] : at[-1]].reshape(-1, _HEX)


def climb(nodes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrices of a block, level by level: its nodes, and so many levels above."""
    out = [nodes]
    for _ in range(levels):
        full = len(nodes) // FANOUT
        runs = [row for row in nodes[: full * FANOUT].reshape(full, FANOUT * _HEX)]
        if full * FANOUT < len(nodes):
            runs.append(nodes[full * FANOUT :].reshape(-1))
        nodes = np.frombuffer("".join(sha(r) for r in runs).encode(), np.uint8).reshape(-1, _HEX)
        out.append(nodes)
    return out


def siblings(nodes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The digests of the siblings of every node, node by node and left to right, and where each node's begin and the last's end."""
    at = np.arange(len(nodes))
    place = at % FANOUT
    k = np.arange(FANOUT - 1)
    index = (at - place)[:, None] + k + (k >= place[:, None])
    there = index < len(nodes)
    return nodes[index[there]].tobytes(), np.append(0, np.cumsum(there.sum(axis=1))) * _HEX


def fold(digest: str, places: list[int], others: list[str]) -> str:
    """The root that a leaf and the siblings of its levels lead to."""
    for j, s in zip(places, others):
        digest = sha((s[: j * _HEX] + digest + s[j * _HEX :]).encode())
    return digest


def _above(n: Column) -> Column:
    """Levels of a pass over a level of n nodes: until one is left, DEPTH at most."""
    out = F.lit(DEPTH)
    for i in reversed(range(DEPTH)):
        out = F.when(n <= FANOUT**i, i).otherwise(out)
    return out


def indexed(df: DataFrame, order: list[Column], work: Work, name: str) -> DataFrame:
    """The written rows with their index (from 0) in an order that tells all rows apart."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place in its task's output
    df = work.save(df.withColumns({"_range": F.spark_partition_id(), "_at": at}), name)
    counts = df.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each task
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    start = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return df.join(F.broadcast(start), "_range").withColumn("index", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of a task: runs of rows with equal ``grp`` and ``block``, which may go over batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g, k = (b.column(n).to_numpy(zero_copy_only=False) for n in ("grp", "block"))
        ends = [*(np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), b.num_rows]
        if held and (held[-1]["grp"][-1].as_py(), held[-1]["block"][-1].as_py()) != (g[0], k[0]):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in ends[:-1]:
            yield pa.Table.from_batches([*held, b.slice(start, end - start)])
            held, start = [], end
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def grow(nodes: DataFrame, work: Work) -> list[DataFrame]:
    """Passes over nodes (grp, n, pos, digest), written: the nodes, their blocks, the blocks' blocks, until each group has one."""

    def up(batches):
        for t in _cut(batches):
            top = climb(matrix(t["digest"].combine_chunks()), t["levels"][0].as_py())[-1]
            yield pa.RecordBatch.from_arrays([t["grp"][:1].combine_chunks(), t["n"][:1].combine_chunks(), t["block"][:1].combine_chunks(), pa.array([top[0].tobytes().decode()])], ["grp", "n", "pos", "digest"])

    passes, n = [nodes], F.col("n")
    while (most := passes[-1].agg(F.max("n")).first()[0]) and most > 1:
        rows = _by_block(passes[-1].select("grp", "n", "pos", "digest")).withColumn("levels", _above(n).cast("int"))
        next_ = rows.select("grp", F.ceil(n / BLOCK).alias("n"), "block", "digest", "levels").mapInArrow(up, "grp long, n long, pos long, digest string")
        passes.append(work.save(next_, "blocks"))
    return passes


def _down(batches):
    """Of each block's rows (grp, block, pos, digest, levels, places, others, note, ...), the nodes, their proofs and the note.

    The first row of a block is its header (pos -1), which has the places and siblings above, and the note.
    """
    for t in _cut(batches):
        head, t = t.slice(0, 1), t.slice(1)
        if not t.num_rows:  # an empty dataset's root has no nodes
            continue
        top_places, top = head["places"][0].as_py(), head["others"][0].as_py()
        levels = t["levels"][0].as_py()
        m = climb(matrix(t["digest"].combine_chunks()), max(levels - 1, 0))[:levels]
        found = [(b.decode(), at.tolist()) for b, at in map(siblings, m)]
        proofs = [([i // FANOUT**k % FANOUT for k in range(levels)] + top_places, [b[at[i // FANOUT**k] : at[i // FANOUT**k + 1]] for k, (b, at) in enumerate(found)] + top) for i in range(t.num_rows)]
        yield t, proofs, head["note"][0].as_py()


_HEADS = "grp long, pos long, places array<int>, others array<string>, note string"


def _heads(grp: pa.Array, pos: pa.Array, proofs, notes: pa.Array) -> pa.RecordBatch:
    lists = [pa.array([p[i] for p in proofs], pa.list_(k)) for i, k in enumerate((pa.int32(), pa.string()))]
    return pa.RecordBatch.from_arrays([grp, pos, *lists, notes], ["grp", "pos", "places", "others", "note"])


def prove(passes: list[DataFrame], heads: DataFrame, finish, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Proofs for the nodes of the first pass. heads: (grp, pos 0, places, others, note), what stands above each group's root.

    ``finish`` gets a block's nodes, their (places, siblings) lists and the group's note, and gives a RecordBatch of ``schema``.
    """

    def between(t, proofs, note):
        return _heads(t["grp"].combine_chunks(), t["pos"].combine_chunks(), proofs, pa.array([note] * t.num_rows, pa.string()))

    for depth in reversed(range(max(len(passes) - 1, 1))):
        last = depth == 0
        nodes = passes[depth].withColumn("levels", _above(F.col("n")).cast("int")).withColumn("block", F.floor(F.col("pos") / BLOCK))
        kept = keep if last else ()
        none = [F.lit(None).cast(k).alias(c) for c, k in (("places", "array<int>"), ("others", "array<string>"), ("note", "string"))]
        nodes = nodes.select("grp", "block", "pos", "digest", "levels", *none, *kept)
        first = heads.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).alias("levels"), "places", "others", "note", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in kept])
        rows = nodes.unionByName(first).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
        make = finish if last else between

        def go(batches, make=make):
            for found in _down(batches):
                yield make(*found)

        heads = rows.mapInArrow(go, schema if last else _HEADS)
    return heads


@dataclass
class Manifest:
    """Passes over the leaves of all groups, and over the groups' roots (grp 0); ``groups`` has (grp, source, subroot)."""

    passes: list[DataFrame]
    tops: list[DataFrame]
    groups: DataFrame
    root: str | None

    def proofs(self, finish, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """Proofs of all leaves, each block's made into what ``finish`` gives; its note is the group's root. ``keep``: columns of the leaves that it needs."""
        start = self.groups.sparkSession.createDataFrame([(0, 0, [], [], None)], _HEADS)

        def listed(t, proofs, note):
            return _heads(t["pos"].combine_chunks(), pa.array([0] * t.num_rows, pa.int64()), proofs, t["digest"].combine_chunks())

        return prove(self.passes, prove(self.tops, start, listed, _HEADS), finish, schema, keep)


def build(rows: DataFrame, work: Work, keep: tuple[str, ...] = ()) -> Manifest:
    """The manifest of rows (source, doc_id, digest) and columns to keep."""
    tie = F.monotonically_increasing_id()  # written below, so it stays; it splits a run of equal rows over tasks
    rows = work.save(rows.select("source", "doc_id", "digest", *keep).withColumn("tie", tie), "rows")
    first = F.col("source").asc_nulls_first()
    placed = indexed(rows, [first, F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")], work, "sorted")
    parts = placed.groupBy("source").agg(F.count("*").alias("n"), F.min("index").alias("start"))
    groups = indexed(parts, [first], work, "groups").withColumnRenamed("index", "grp")
    passes = grow(work.save(_in_groups(placed, groups).select("grp", "n", "pos", "doc_id", "digest", *keep), "leaves"), work)
    groups = work.save(groups.select("grp", "source").join(passes[-1].select("grp", F.col("digest").alias("subroot")), "grp"), "subroots")
    n = groups.count()
    tops = grow(groups.select(F.lit(0).cast("long").alias("grp"), F.lit(n).cast("long").alias("n"), F.col("grp").alias("pos"), F.col("subroot").alias("digest")), work)
    root = tops[-1].first()
    return Manifest(passes, tops, groups, root.digest if root else None)


#: Places of a range in which leaves and starts of groups meet.
RANGE = 65536


def _in_groups(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """The leaves with grp, n and their place in the group.

    Groups are intervals of places, cut at multiples of RANGE, so the join's keys are (range, source): one of them has
    RANGE rows at most, however large a group is.
    """
    span = F.sequence(F.floor(F.col("start") / RANGE), F.floor((F.col("start") + F.col("n") - 1) / RANGE))
    spans = groups.select("grp", "n", "start", F.col("source").alias("of"), F.explode(span).alias("range"))
    leaves = placed.withColumn("at", F.floor(F.col("index") / RANGE))
    joined = leaves.join(spans, (F.col("at") == F.col("range")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("pos", F.col("index") - F.col("start"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = [F.col(c) for c in COLUMNS]
    shown = F.when(struck, leaf_digest(*whole[:-1], lowered))  # the leaf of a row that was tampered with
    made = build(docs.select("source", "doc_id", leaf_digest(*whole).alias("digest"), shown.alias("shown")), work, keep=("shown",))

    def checked(t: pa.Table, proofs, subroot: str) -> pa.RecordBatch:
        leaf, tampered = t["digest"].to_pylist(), t["shown"].to_pylist()
        proof = [sha("".join(others).encode()) for _, others in proofs]
        folded = [fold(b or a, *p) for a, b, p in zip(leaf, tampered, proofs)]
        columns = [t["doc_id"].combine_chunks(), t["digest"].combine_chunks(), *[pa.array(x, pa.string()) for x in ([subroot] * t.num_rows, proof, folded)]]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = made.proofs(checked, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string", keep=("shown", "doc_id"))
    got = got.withColumn("root", F.lit(made.root).cast("string"))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PART = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in COLUMNS) + ")"
_SHOWN = "sha256(" + " || ".join(_PART.format(c if c != "text" else "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for c in COLUMNS) + ")"
OP11_SQL = f"""
with recursive step as (select list(r order by i) as tab from (select i, list_reduce([i::bigint] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end) as r from range(256) t(i))),
d as (select doc_id, source, {_LEAF} as leaf, case when coalesce(xor(4294967295::bigint, list_reduce([4294967295::bigint] || list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint),
             lambda c, b: xor(c >> 8, tab[cast(xor(c, b) & 255 as integer) + 1]))) % 5 = 0, false) then {_SHOWN} else {_LEAF} end as shown from documents, step),
l as materialized (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as pos, count(*) over (partition by source) as n from d),
low(lvl, source, pos, n, digest) as (select 0, source, pos, n, leaf from l
  union all select lvl + 1, any_value(source), pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by pos)) from low where n > 1 group by lvl, source, pos // 16),
subs as (select source, lvl, digest as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from low where n = 1),
high(lvl, pos, n, digest) as (select 0, pos, n, subroot from subs
  union all select lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by pos)) from high where n > 1 group by lvl, pos // 16),
runs as (select false as up, lvl, source, pos // 16 as run, list(digest order by pos) as nodes from low where n > 1 group by lvl, source, pos // 16
  union all select true, lvl, null, pos // 16, list(digest order by pos) from high where n > 1 group by lvl, pos // 16),
climb(doc_id, leaf, source, subroot, up, lvl, pos, digest, others) as (
  select l.doc_id, l.leaf, l.source, subs.subroot, subs.lvl = 0, 0, case when subs.lvl = 0 then subs.pos else l.pos end, l.shown, '' from l join subs on l.source is not distinct from subs.source
  union all
  select c.doc_id, c.leaf, c.source, c.subroot, c.up or c.lvl + 1 = s.lvl, case when not c.up and c.lvl + 1 = s.lvl then 0 else c.lvl + 1 end,
         case when not c.up and c.lvl + 1 = s.lvl then s.pos else c.pos // 16 end,
         sha256(array_to_string(r.nodes[1:c.pos % 16], '') || c.digest || array_to_string(r.nodes[c.pos % 16 + 2:], '')),
         c.others || array_to_string(r.nodes[1:c.pos % 16], '') || array_to_string(r.nodes[c.pos % 16 + 2:], '')
  from climb c join subs s on c.source is not distinct from s.source join runs r on r.up = c.up and r.lvl = c.lvl and r.run = c.pos // 16 and (c.up or r.source is not distinct from c.source)),
top as (select digest as root, lvl from high where n = 1)
select doc_id, leaf, subroot, root, sha256(others) as proof_sha256, digest as folded_root, digest = root as verified from climb join top on climb.up and climb.lvl = top.lvl
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
SQL = {"op11_merkle_manifest": OP11_SQL}
