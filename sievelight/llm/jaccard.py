"""N-gram Jaccard join: an exact similarity self-join of word-shingle sets in a metric space.

d = 1 - Jaccard is a metric, and r = 1 - threshold the radius. The join divides the sets into regions around documents
as pivots and joins each region by itself:

1. Equal sets are one point. What follows joins points.
2. Two points within the radius share one of the first n - ceil(t n) + 1 shingles of each in any fixed order. Each such
   shingle names the least point that holds it among these, and a point lies in the regions of all pivots so named. So
   of two points within the radius some region holds both. (Regions by distance alone can't be the coarsest ones: nearly
   all points lie at distance 1 of nearly all pivots, so each would be in every window.) The order puts shingles that
   many points hold last, so a line that a third of all documents share names no pivot for them. Shingles are ordered
   by a key of level and hash; where two keys clash, regions hold a few points too many.
3. Each point carries a bitmap of its set, of 2 to 4 bits a shingle. Bits that the other of a pair lacks bound its
   intersection from above; what they don't rule out is compared in full.
4. Each point is compared with the pivots of its regions. Only regions that then hold points not yet known to be in one
   component go on, and there only pairs of different parts: small ones at once, larger ones block by block. A block
   is of bounded size in points and shingles. Bitmaps find the points that may link; their sets are then sent to the
   block once, and a block returns links, not pairs.
5. A region of more than BLOCK points with more than LEAF outside of its main part is divided first. PIVOTS documents of
   it go to all of its blocks, and every point measures its distances to them. It belongs to the Voronoi cell of the
   nearest pivot, and is copied into the cell of each pivot at most 2 r farther: by the triangle inequality a partner
   of x that belongs to cell i has d(x, p_i) <= d(x, p_j) + 2 r for each j. Cells are regions again: their links are
   spread, they are compared, or divided once more, until one is no less than three quarters of the region that it came
   from, as near copies just beyond the radius of one another can't be parted by pivots; those are joined in blocks.

Pairs known to be in one component need no comparison, as components are what is returned.

Nulls, empty texts and texts of white space have no shingles, lie in no region and stay alone. Repeated rows and equal
texts share a point; a null id names a component only where no other is in it. Very long texts are hashed in pieces and keep all
shingles. Columns beyond the id and the text are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .words import blocks, shingles
from .work import Work

#: Slots of the table of levels sent to the workers, 4 MB whatever the data; slots that clash cost work, not links.
LEVEL_BITS = 22
#: Shingles that a counting task holds at once, and most shingles that are marked as frequent.
HELD, FREQUENT = 1 << 21, 1 << 17
#: Points of a region that is joined pair by pair; pivots of a region that is divided; points and shingles of a block.
LEAF, PIVOTS, BLOCK, HEAVY = 64, 8, 1024, 1 << 20


def _point(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequent(docs: DataFrame, k: int, work: Work) -> np.ndarray:
    """Levels (log2 of the count) by slot of shingles that many distinct texts hold; 0 for the others.

    Each task counts over all of its texts, 4 million shingles at a time, and hands on what at least two of them
    share; a shingle in more texts than there are such blocks is always among them. Counts only order the shingles:
    any levels give the same links.
    """

    def count(batches):
        held, n, seen = [], 0, set()
        for b in batches:
            for _, _, h, bounds in blocks(b.column(0)):
                for s in shingles(h, bounds, k):
                    if len(s) and (p := _point(s)) not in seen:
                        seen.add(p)
                        held.append(s)
                        n += len(s)
                if n >= HELD:
                    yield _repeated(held)
                    held, n, seen = [], 0, set()
        yield _repeated(held)

    def _repeated(held):
        x, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(_signed(x[c > 1])), pa.array(c[c > 1].astype(np.int64))], ["s", "n"])

    counts = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 16")
    slots = work.save(counts.select((F.col("s").bitwiseAND((1 << LEVEL_BITS) - 1)).alias("slot"), F.floor(F.log2("n")).cast("int").alias("level")).groupBy("slot").agg(F.max("level").alias("level")), "frequent")
    by_level = {r.level: r.n for r in slots.groupBy("level").agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for level in sorted(by_level, reverse=True):
        total += by_level[level]
        if total > FREQUENT:
            break
        least = level
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    got = slots.where(F.col("level") >= least).toPandas()
    out[got["slot"].to_numpy(np.int64)] = got["level"].to_numpy(np.uint8)
    work.drop(slots)
    return out


def _sketch(s: np.ndarray) -> bytes:
    """A bitmap of a set, of at least 2 bits a shingle; its halves laid over each other are the bitmap of half the size."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    out = np.zeros(bits, bool)
    out[((s >> np.uint64(16)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] | x[..., half:]
    return x


def _points(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(key, doc_id, n, point, opens, sketch): each document's set size, point, shingles of the front, and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    mask = np.uint64((1 << LEVEL_BITS) - 1)

    def cut(batches):
        table = sent.value
        for b in batches:
            sizes, points, opens, sketches = [], [], [], []
            for _, _, h, bounds in blocks(b.column(2)):
                for s in shingles(h, bounds, k):
                    n = len(s)
                    sizes.append(n)
                    points.append(_point(s) if n else None)
                    sketches.append(_sketch(s) if n else None)
                    p = n - (percent * n + 99) // 100 + 1 if n else 0
                    level = table[(s & mask).astype(np.int64)].astype(np.uint64)
                    opens.append(_signed(np.sort((level << np.uint64(58)) | (s >> np.uint64(6)))[:p]))
            columns = [pa.array(sizes, pa.int64()), pa.array(points, pa.int64()), _lists(opens), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["key", "doc_id", "n", "point", "opens", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(cut, f"key long, doc_id {kind}, n long, point long, opens array<long>, sketch binary")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _sets(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(point, set): the shingles of the documents whose keys (point, key) are given; each point once.

    A bitmap of the keys, sized by their number up to 16 MB, spares most other texts the work; what it lets through is
    dropped by the join.
    """
    bits = min(27, max(16, int(16 * keys.count()).bit_length()))
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    got = keys.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("v")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches):
        words = sent.value
        for b in batches:
            slots = b.column(0).to_numpy().view(np.uint64) & np.uint64(64 * len(words) - 1)
            keep = (words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
            for _, _, h, bounds in blocks(b.column(1).filter(pa.array(keep))):
                s = [x for x in shingles(h, bounds, k) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_point(x) for x in s], pa.int64()), _lists([_signed(x) for x in s])], ["point", "set"])

    got = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(cut, "point long, set array<long>")
    return got.groupBy("point").agg(F.first("set").alias("set")).join(keys.select("point"), "point", "left_semi")


def _possible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b) that the bitmaps of the points ``held`` don't rule out.

    Each bit of one that the other lacks stands for a shingle at least that isn't shared.
    """

    def may(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                x, y = _folded(x, size).view(np.uint64), _folded(y, size).view(np.uint64)
                most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
                keep.append(100 * most >= percent * (n + m - most))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = held.select("point", "n", "sketch")
    joined = pairs.select("a", "b").join(of.toDF("b", "n_b", "sketch_b"), "b").join(of.toDF("a", "n_a", "sketch_a"), "a")
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(may, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets (point, set) are within the radius."""
    joined = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return joined.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _spread(links: DataFrame, work: Work) -> DataFrame:
    """(point, part): two steps of the least label along links. Points of one part are in one component; not conversely."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("point"), F.least("a", "m").alias("part"))
    one = work.save(one, "step")
    two = both.join(one.toDF("b", "of_b"), "b").groupBy("a").agg(F.min("of_b").alias("m"))
    return work.save(one.join(two.toDF("point", "m"), "point").select("point", F.least("part", "m").alias("part")), "parts")


def _apart(rows: DataFrame, links: DataFrame, work: Work) -> DataFrame:
    """Rows (region, point, ...) of the regions that hold points of more than one part; with their part, and of their
    region the main part, the numbers of points and of those outside of it, and the sum of set sizes."""
    m = work.save(rows.join(_spread(links, work), "point", "left").withColumn("part", F.coalesce("part", "point")), "members")
    by_part = m.groupBy("region", "part").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    per = by_part.groupBy("region").agg(F.count("*").alias("parts"), F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("size"), F.sum("w").alias("weight")).where("parts > 1")
    per = per.select("region", F.col("top.part").alias("main"), (F.col("size") - F.col("top.c")).alias("outside"), "size", "weight")
    # written first, so that a large region is split by the join
    return work.save(m.join(work.save(per, "regions"), "region"), "apart")


def jaccard_links(docs: DataFrame, work: Work, k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(points, links) of documents (doc_id, text): rows (doc_id, n, point), and links (a, b) between points.

    Links hold at least one path for every pair of points with 100 * intersection >= percent * union, and no pair
    below that. ``k`` is the number of words of a shingle.
    """
    docs = docs.select("doc_id", "text")
    points = work.save(_points(docs, k, percent, _frequent(docs, k, work)), "points")
    opened = points.where("point is not null").select("point", F.explode("opens").alias("shingle"))
    pivots = opened.groupBy("shingle").agg(F.min("point").alias("region"), F.max("point").alias("other"))
    pivots = work.save(pivots.where("region < other").select("shingle", "region"), "pivots")
    met = work.save(opened.join(pivots, "shingle").select("region", "point").distinct(), "met")
    work.drop(pivots)
    held = points.where("point is not null").groupBy("point").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    held = work.save(held.join(met.select("point").distinct(), "point"), "held")
    rows = work.save(met.join(held.select("point", "n"), "point").withColumns({"inner": F.lit(True), "was": F.lit(None).cast("long")}), "rows")
    # each point against the pivots of its regions
    fits = F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    pivot = rows.where("region = point").select("region", F.col("n").alias("n2"))
    star = rows.where("region <> point").join(pivot, "region").where(fits).select(F.col("region").alias("a"), F.col("point").alias("b"))
    star = work.save(_possible(star, held, percent), "star")
    links = work.save(_linked(star, work.save(_sets(docs, _named(held, star), k), "sets"), percent), "links")
    apart = _apart(rows, links, work)
    # small regions, pair by pair
    small, large = apart.where(F.col("size") <= LEAF), apart.where(F.col("size") > LEAF)
    outer = small.where("part <> main").select("region", F.col("point").alias("p"), F.col("n").alias("n2"), F.col("part").alias("part2"))
    pairs = small.join(outer, "region").where("part <> part2 and (part = main or point < p)").where(fits).select(*_ordered("point", "p")).distinct()
    pairs = work.save(_possible(pairs, held, percent).join(star, ["a", "b"], "left_anti"), "pairs")
    near = _blocks(large.where(~_divisible()), held, percent, work)
    named = pairs.select(F.explode(F.array("a", "b")).alias("point")).union(near.select("point")).union(large.where(_divisible()).select("point"))
    sets = work.save(_sets(docs, held.select("point", "key").join(named.distinct(), "point", "left_semi"), k), "sets")
    links = links.union(work.save(_linked(pairs, sets, percent), "links"))
    links = links.union(work.save(_joined(near, sets, percent), "links"))
    # large regions, divided until they are small or no longer shrink
    large, level = large.where(_divisible()), 1
    while not large.isEmpty():
        cells = work.save(_cells(large, sets, percent, level), "cells")
        links = links.union(cells.where("linked and point <> p").select(*_ordered("point", "p")))
        inside = cells.select("region", "point", "inner", "was").join(held.select("point", "n"), "point")
        apart = _apart(inside, links, work)
        near = _blocks(apart.where(~_divisible()), held, percent, work)
        links = links.union(work.save(_joined(near, sets, percent), "links"))
        large, level = apart.where(_divisible()), level + 1
    return points.select("doc_id", "n", "point"), links


def _named(held: DataFrame, pairs: DataFrame) -> DataFrame:
    return held.select("point", "key").join(pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct(), "point", "left_semi")


def _divisible() -> Column:
    """Whether a region is worth dividing: large, with many points outside of its main part, and less than the one it came from."""
    return (F.col("size") > BLOCK) & (F.col("outside") > LEAF) & (F.col("size") < F.coalesce(0.75 * F.col("was"), F.col("size") + 1))


def _parts(points: Column, weight: Column) -> Column:
    return F.ceil(F.greatest(points / F.lit(BLOCK), weight / F.lit(HEAVY))).cast("int")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("point", F.lit("block")), parts).cast("int")


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _cells(large: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """(region, p, point, inner, linked, was): Voronoi cells of the regions, with windows.

    Pivots, some inside and some outside of the main part, go to all blocks of their region; each block measures its
    points' distances to them. A point lies in the cell of its nearest pivot, and is copied to the cells of the pivots
    that are at most 2 r farther: only there can it have a partner that belongs to the cell.
    """
    inside = F.col("part") == F.col("main")
    chosen = []
    for i in range(PIVOTS):
        chosen.append(F.min(F.when(inside if i % 2 else ~inside, F.struct(F.xxhash64(F.lit(level * PIVOTS + i), "point"), "point"))).alias(f"p{i}"))
    pivots = large.groupBy("region").agg(*chosen, F.first("size").alias("size"), F.first("weight").alias("weight"))
    pivots = pivots.select("region", "size", _every(_parts(F.col("size"), F.col("weight"))).alias("block"), F.array_distinct(F.array_compact(F.array(*[F.col(f"p{i}.point") for i in range(PIVOTS)]))).alias("p"))
    pivots = pivots.select("region", "size", "block", F.explode("p").alias("point"), F.lit(True).alias("pivot"))
    rows = large.select("region", "size", _dealt(_parts(F.col("size"), F.col("weight"))).alias("block"), "point", F.lit(False).alias("pivot"))
    rows = rows.union(pivots).join(sets, "point")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        p, x = pdf[pdf["pivot"]].sort_values("point"), pdf[~pdf["pivot"]]
        heads = [np.asarray(s, np.int64).view(np.uint64) for s in p["set"]]
        both = np.array([[_meet(s, h) for h in heads] for s in (np.asarray(v, np.int64).view(np.uint64) for v in x["set"])], np.int64).reshape(len(x), len(p))
        either = np.array([len(v) for v in x["set"]], np.int64).reshape(-1, 1) + np.array([len(h) for h in heads], np.int64) - both
        d = 1 - both / either
        own = d.argmin(axis=1) if len(p) and len(x) else np.zeros(0, int)
        i, j = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * (1 - percent / 100) + 1e-9) if len(own) else (np.zeros(0, int),) * 2
        at = x["point"].to_numpy()
        return pd.DataFrame({"region": x["region"].to_numpy()[i], "p": p["point"].to_numpy()[j], "point": at[i], "inner": own[i] == j, "linked": 100 * both[i, j] >= percent * either[i, j], "was": x["size"].to_numpy()[i]})

    schema = "region long, p long, point long, inner boolean, linked boolean, was long"
    got = rows.groupBy("region", "block").applyInPandas(measure, schema)
    return got.withColumn("region", F.xxhash64(F.lit(level), "region", "p"))


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _candidates(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of points of different parts the bitmaps don't rule out, one of each pair in its own cell."""
    n, m = x["n"].to_numpy(np.int64)[:, None], y["n"].to_numpy(np.int64)[None]
    out = (x["part"].to_numpy()[:, None] != y["part"].to_numpy()[None]) & (x["inner"].to_numpy()[:, None] | y["inner"].to_numpy()[None])
    out &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    kinds = [np.array([len(s) for s in t["sketch"]], np.int64) for t in (x, y)]
    for i in np.unique(kinds[0]):
        for j in np.unique(kinds[1]):
            if 2 * min(i, j) < max(i, j):  # sizes too far apart
                continue
            at, to, size = np.flatnonzero(kinds[0] == i), np.flatnonzero(kinds[1] == j), min(i, j)
            u, v = (_folded(np.stack([np.frombuffer(t["sketch"].iloc[q], np.uint8) for q in of]), size) for t, of in ((x, at), (y, to)))
            c = np.zeros((len(at), len(to)), np.float32)
            for lo in range(0, size, 256):
                c += np.unpackbits(u[:, lo : lo + 256], axis=1).astype(np.float32) @ np.unpackbits(v[:, lo : lo + 256], axis=1).astype(np.float32).T
            most = np.minimum(n[at] - (np.bitwise_count(u).sum(axis=1, dtype=np.int64)[:, None] - c), m[:, to] - (np.bitwise_count(v).sum(axis=1, dtype=np.int64)[None] - c))
            out[np.ix_(at, to)] &= 100 * most >= percent * (n[at] + m[:, to] - most)
    return out


def _blocks(large: DataFrame, held: DataFrame, percent: int, work: Work) -> DataFrame:
    """Points of regions that may link to one of another part there: rows (region, i, j, outer, point, n, part, inner, sketch).

    The points outside of the main part are held against all, block by block, by their bitmaps. No pairs leave a block.
    """

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["outer"]], pdf[~pdf["outer"]]
        may = _candidates(x, y, percent)
        return pd.concat([x[may.any(axis=1)], y[may.any(axis=0)]])

    large = large.join(held.select("point", "sketch"), "point")
    outside, size, weight = F.col("outside"), F.col("size"), F.col("weight")
    outer = large.where("part <> main").withColumn("i", _dealt(_parts(outside, weight))).withColumn("j", _every(_parts(size, weight))).withColumn("outer", F.lit(True))
    every = large.withColumn("j", _dealt(_parts(size, weight))).withColumn("i", _every(_parts(outside, weight))).withColumn("outer", F.lit(False))
    cols = ("region", "i", "j", "outer", "point", "n", "part", "inner", "sketch")
    rows = outer.select(*cols).unionByName(every.select(*cols))
    return work.save(rows.groupBy("region", "i", "j").applyInPandas(hold, "region long, i int, j int, outer boolean, point long, n long, part long, inner boolean, sketch binary"), "near")


def _joined(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the blocks of ``near``, from whole sets; pairs that links of their block join already are left out."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["outer"]], pdf[~pdf["outer"]]
        p, q = x["point"].to_numpy(), y["point"].to_numpy()
        sets_x, sets_y = ([np.asarray(s, np.int64).view(np.uint64) for s in t["set"]] for t in (x, y))
        to = {v: v for v in (*x["part"].tolist(), *y["part"].tolist())}

        def root(v: int) -> int:
            while to[v] != v:
                to[v] = to[to[v]]
                v = to[v]
            return v

        of_x, of_y, out = x["part"].tolist(), y["part"].tolist(), []
        for i, j in zip(*(v.tolist() for v in np.nonzero(_candidates(x, y, percent)))):
            r, s = root(of_x[i]), root(of_y[j])
            if r != s:
                both = _meet(sets_x[i], sets_y[j])
                if 100 * both >= percent * (len(sets_x[i]) + len(sets_y[j]) - both):
                    to[max(r, s)] = min(r, s)
                    out.append((min(p[i], q[j]), max(p[i], q[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return near.join(sets, "point").groupBy("region", "i", "j").applyInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, work: Work | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``; the id is the least one reachable by links."""
    work = work or Work(docs.sparkSession)
    points, links = jaccard_links(docs, work, k, percent)
    parts = connected_components(links, work)
    own = points.where("point is not null").groupBy("point").agg(F.min("doc_id").alias("least"))
    whole = own.join(parts.withColumnRenamed("node", "point"), "point")
    least = whole.groupBy("component").agg(F.min("least").alias("among"))
    moved = whole.join(least, "component").select("point", "among")
    named = work.save(own.join(moved, "point", "left").select("point", F.coalesce("among", "least").alias("component_id")), "named")
    out = points.join(named, "point", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
