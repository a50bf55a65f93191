"""Connected components of a distributed graph, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def connected_components(edges: DataFrame, work: Work) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns a, b); component is the least node reachable.

    Each round points every node at its least neighbour (a minimum with map-side combine, so a hub costs one partial
    row a task), shortens the pointers by two joins, and contracts the edges to the nodes pointed at. Rounds fall with
    the logarithm of the longest path. Loops, repeated edges and null ends are ignored. Each round's tables are
    written, so nothing is recomputed when an executor is lost. No link or component reaches the driver.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = work.save(e, "edges")
    maps = []
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        first = work.save(p, "parents")
        p = work.save(_jump(_jump(first, first), first), "jumped")
        work.drop(first)
        maps.append(p)
        of_a, of_b = p.toDF("a", "pa"), p.toDF("b", "pb")
        nxt = e.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        nxt = work.save(nxt, "edges")
        work.drop(e)
        e = nxt
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for m in maps[1:]:
        step = m.toDF("to", "then")
        out = out.join(step, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    return work.save(out.select("node", F.col("to").alias("component")), "components")


def _jump(p: DataFrame, by: DataFrame) -> DataFrame:
    step = by.toDF("to", "then")
    return p.join(step, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
