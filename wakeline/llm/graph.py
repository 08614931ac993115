"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import BROADCAST_ROWS, drop_materialised, materialise

#: A node with more edges is a hub, at least.
HUB = 256


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """u, v, m: the edges (`rows` of them, cheap to read again) with the least of u and its neighbours v.

    A hub's edges would meet in one task of a join by u. There are at most rows / limit nodes of more than `limit` edges,
    so with this limit hubs are few enough to be broadcast; the others join by u.
    """
    limit = max(HUB, math.ceil(rows / BROADCAST_ROWS))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    least = materialise(least)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("hub")))
    marked = edges.join(hubs, "u", "left")
    near = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionAll(near.select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge of two different nodes; component is its least node.

    Loops and edges with a null end are ignored. Each step aggregates before it joins, and the edges of hubs join by
    broadcast, so that no task holds a node's neighbours. A round writes its edges to the shared folder; the number of
    rounds grows with the logarithm of the component size.
    """
    e = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_with_least(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        star = _with_least(large, state[0])  # its edges are no more than those of e
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(star.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small)
        drop_materialised(e)
        drop_materialised(large)
        before, state = state, _state(new)
        e = new
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
