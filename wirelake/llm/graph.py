"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); component is the smallest node reachable.

    Each round maps every node to the neighbour (or itself) that comes first in a fixed random order and contracts the
    edges accordingly; the number of nodes falls by a constant factor a round whatever the shape of the graph. Then the
    maps are composed backwards. Only DataFrame joins and aggregates; every round is cut off by a written table.
    Joins have two plain exchanges, so that Spark can split the keys of large components.
    """

    def order(c):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))

    def both(e):
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    links = scratch.table(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links-0")
    maps = []
    while not links.isEmpty():
        k = len(maps)
        best = both(links).groupBy("u").agg(F.min(order("v")).alias("m"))
        step = scratch.table(best.select(F.col("u").alias("node"), F.least(F.col("m"), order("u"))["id"].alias("to")), f"map-{k}")
        maps.append(step)
        half = links.join(step, links.u == step.node).select(F.col("to").alias("a"), "v")
        moved = half.join(step, half.v == step.node).select("a", F.col("to").alias("b")).where("a <> b")
        links = scratch.table(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"links-{k + 1}")
        scratch.drop(f"links-{k}")
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = maps[-1]
    for k, step in reversed(list(enumerate(maps[:-1]))):
        up = label.select(F.col("node").alias("at"), F.col("to").alias("top"))
        label = scratch.table(step.join(up, step["to"] == up["at"], "left").select("node", F.coalesce("top", "to").alias("to")), f"label-{k}")
    least = scratch.table(label.groupBy(F.col("to").alias("root")).agg(F.min("node").alias("component")), "least")
    return label.join(least, label["to"] == least["root"]).select("node", "component")
