"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

#: Neighbours that one task joins at most, and nodes with more of them that the driver holds (some 2 MB).
HUB, MOST_HUBS = 100_000, 50_000


def least_neighbour(rows: DataFrame, most: int) -> DataFrame:
    """``rows(u, v)``, at most ``most`` of a u, with m, the smallest v of their u. Nodes of more than ``HUB`` neighbours are met by broadcast, the others by shuffle."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if most <= HUB:  # no hubs: nothing is asked for them
        return rows.join(least.select("u", "m"), "u")
    hubs = least.where(F.col("n") > HUB).select("u", "m").limit(MOST_HUBS + 1).collect()
    if not hubs or len(hubs) > MOST_HUBS:  # without hubs, or with so many that none holds much of the rows
        return rows.join(least.select("u", "m"), "u")
    few = F.broadcast(rows.sparkSession.createDataFrame(hubs, "u long, m long"))
    light = rows.join(few.select("u"), "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return light.unionByName(rows.join(few, "u"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of ``links(a long, b long)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step moves
    links nearer to their smallest node and none collects a neighbourhood. Each round is
    a written table, so a lost executor costs one round. An empty list gives no rows.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_neighbour(both, state[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = durable(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = least_neighbour(large, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least)
        after = durable(small.distinct(), "links")
        discard(edges, large)
        edges = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
