"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is one shuffle of the links; the number of steps grows with the logarithm of the longest path. Lineage is cut by a
written table after every round, and the only thing brought to the driver is one changed/unchanged number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v): neighbours are joined to the least of their neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        near = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least"))
        out = both.where("v > u").join(near.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node that occurs in edges (src, dst); component is the smallest id that is connected to it.

    Directions, repeated edges and self-loops don't matter; edges with a null end are left out (the other end still gets a
    row). Empty input gives an empty result. More rounds than max_rounds, which no real graph needs, are an error. Works for any orderable id type.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    links = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = materialize(links, "links")
    before = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(links, True), False), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links)
        links = after
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    parents = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "id")
    return ends.join(parents, "id", "left").select("id", F.coalesce("m", "id").alias("component"))
