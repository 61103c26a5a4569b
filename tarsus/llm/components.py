"""Connected components of an edge table by hooking and pointer jumping, as written tables in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsus.runtime import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an undirected edge table with the smallest node it is connected to.

    Each round hooks every node onto its smallest neighbour, jumps pointers twice, and contracts the edges to the
    roots reached; the edge table shrinks by at least half its nodes a round, so the rounds are logarithmic. A hub
    costs one partially aggregated row a task. Loops and repeated edges are allowed, null ends are ignored; no edges
    give no rows. Nothing but the emptiness of the next edge table comes to the driver.
    """
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null")
    e = materialize(e.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct())
    first, maps = e, []
    e = e.where("_a < _b")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        hook = both.groupBy(F.col("_a").alias("_n")).agg(F.min("_b").alias("_m")).select("_n", F.least("_n", "_m").alias("_p"))
        hook = materialize(hook)
        jump = hook
        for _ in range(2):
            up = jump.select(F.col("_n").alias("_p"), F.col("_p").alias("_q"))
            jump = jump.join(up, "_p", "left").select("_n", F.coalesce("_q", "_p").alias("_p"))
        jump = materialize(jump)
        maps.append(jump)
        pa, pb = jump.select(F.col("_n").alias("_a"), F.col("_p").alias("_x")), jump.select(F.col("_n").alias("_b"), F.col("_p").alias("_y"))
        e = e.join(pa, "_a").join(pb, "_b").where("_x <> _y")
        e = materialize(e.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct())

    def then(m: DataFrame, up: DataFrame) -> DataFrame:
        return m.join(up.select(F.col("_n").alias("_p"), F.col("_p").alias("_q")), "_p", "left").select("_n", F.coalesce("_q", "_p").alias("_p"))

    nodes = first.where("_a = _b").select(F.col("_a").alias("_n"))
    if not maps:
        return nodes.distinct().select(F.col("_n").alias("node"), F.col("_n").alias("component"))
    full = reduce(then, maps)
    alone = nodes.distinct().join(full.select("_n"), "_n", "left_anti").select("_n", F.col("_n").alias("_p"))
    return full.unionByName(alone).select(F.col("_n").alias("node"), F.col("_p").alias("component"))
