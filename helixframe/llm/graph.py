"""Connected components by alternating stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from helixframe.util import materialize, release


def numbered(nodes: DataFrame) -> DataFrame:
    """node and its 64-bit number; the numbers of different nodes are checked to differ, with another seed if not."""
    seed = 0
    while True:
        out = materialize(nodes.select("node", F.xxhash64(F.lit(seed), "node").alias("number")), "nodes")
        if out.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return out
        release(out)
        seed += 1


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Component (its smallest node) of each node of an undirected edge list: node, component.

    Large-star and small-star steps in turn until the edges are stars. Every step is an aggregation joined back on
    its key, so no neighbour list is collected and the engine may split a hot hub. Each round is written to the
    shared folder and the round before it deleted. Self-loops and edges with a null end are ignored;
    nodes without an edge to another node have no row. Nodes that are no 64-bit numbers are numbered first, so that
    the rounds use hash aggregates on numbers whatever the nodes are.
    """
    if not isinstance(edges.schema[u].dataType, LongType):
        pairs = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "pairs")
        names = numbered(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        x, y = names.select(F.col("node").alias("x"), F.col("number").alias("nu")), names.select(F.col("node").alias("y"), F.col("number").alias("nv"))
        of = components(pairs.join(x, F.col("u") == F.col("x")).join(y, F.col("v") == F.col("y")), "nu", "nv").select(F.col("node").alias("number"), F.col("component").alias("c"))
        named = materialize(names.join(of, "number"), "named")
        least = named.groupBy("c").agg(F.min("node").alias("component"))
        return named.join(least, "c").select("node", "component")
    a, b = F.col(u).alias("u"), F.col(v).alias("v")
    e = edges.select(a, b).where("u <> v").distinct()
    e = materialize(e, "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("_m")).select("k", F.least("k", "_m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = (
            down.join(near, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(near.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        )
        nxt = materialize(small, "edges")
        release(e)
        e = nxt
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
