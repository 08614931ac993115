"""Nearest neighbours: route analogs for forecasts, and exact search over vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import Prediction
from wakeline.functions.geo import enu
from wakeline.operators.samples import anchors, truth_at
from wakeline.operators.sequence import micros

MAX_DISTANCE, MIN_NEIGHBOURS, SPREAD_M = 3.0, 3, 50.0
RATIO = (0.6, 1.6)


def _features(df: DataFrame, origin: tuple[float, float], p: Prediction) -> DataFrame:
    e, n = enu("lat0", "lon0", *origin)
    th = math.radians(p.course_scale_deg)
    c = F.radians("cog_deg")
    return df.withColumns({"_e": e / p.pos_scale_m, "_n": n / p.pos_scale_m, "_s": F.sin(c) / th, "_c": F.cos(c) / th, "_x": F.floor(e / (MAX_DISTANCE * p.pos_scale_m)), "_y": F.floor(n / (MAX_DISTANCE * p.pos_scale_m))})


def build_library(points: DataFrame, origin: tuple[float, float], p: Prediction, every_s: float, futures_s: Sequence[int]) -> DataFrame:
    """Training anchors with their features and their displacements on a grid of future times."""
    a = anchors(points, every_s, 0.0)
    at = points.select("voyage_id", micros("t").alias("us"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "sog_kn", "cog_deg").join(a, ["voyage_id", "us"], "left_semi")
    at = at.where((F.col("sog_kn") >= p.min_sog_kn) & F.col("cog_deg").isNotNull()).withColumn("library_id", F.concat_ws("@", "voyage_id", "us"))
    asked = at.withColumn("ahead", F.explode(F.array(*map(F.lit, futures_s)))).withColumn("at_us", F.col("us") + F.col("ahead").cast("long") * 1_000_000)
    e, n = enu("lat_h", "lon_h", "lat0", "lon0")
    path = truth_at(asked, points, p.bracket_s).where("known").withColumns({"e": e, "n": n})
    futures = path.groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct("ahead", "e", "n"))).alias("future"))  # one entry for each grid time
    return _features(at.join(futures, "library_id"), origin, p).select("library_id", F.col("sog_kn").alias("v_n"), *(F.col(c).alias(f"l{c}") for c in ("_e", "_n", "_s", "_c", "_x", "_y")), "future")


def neighbours(samples: DataFrame, library: DataFrame, origin: tuple[float, float], p: Prediction) -> DataFrame:
    """The k nearest library anchors of each sample within MAX_DISTANCE, by an equi-join on position cells."""
    s = samples.select("sample_id", "lat0", "lon0", "sog_kn", "cog_deg").distinct()
    s = _features(s, origin, p).withColumn("_g", F.explode(F.array(*(F.struct((F.col("_x") + i).alias("x"), (F.col("_y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))))
    j = s.join(library, (F.col("_g.x") == F.col("l_x")) & (F.col("_g.y") == F.col("l_y")))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"l{c}"), 2) for c in ("_e", "_n", "_s", "_c")), F.lit(0.0)))
    j = j.select("sample_id", "sog_kn", "library_id", "v_n", d.alias("d")).where(F.col("d") < MAX_DISTANCE)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("d", "library_id"))).where(F.col("rank") <= p.k)


def knn_forecast(samples: DataFrame, library: DataFrame, fallback: DataFrame, origin: tuple[float, float], p: Prediction) -> DataFrame:
    """Weighted mean and scatter of the neighbours' time-warped futures; the fallback's row where there are too few."""
    near = neighbours(samples, library, origin, p).join(library.select("library_id", "future"), "library_id")  # futures only for the ranked
    ratio = F.least(F.greatest(F.col("sog_kn") / F.greatest("v_n", F.lit(0.1)), F.lit(RATIO[0])), F.lit(RATIO[1]))
    near = near.withColumn("ratio", ratio).join(samples.select("sample_id", "horizon_min"), "sample_id").withColumn("ask", F.col("horizon_min") * 60 * F.col("ratio"))
    after = F.try_element_at(F.filter("future", lambda f: f["ahead"] > F.col("ask")), F.lit(1))
    zero = F.struct(F.lit(0).alias("ahead"), F.lit(0.0).alias("e"), F.lit(0.0).alias("n"))
    before = F.coalesce(F.try_element_at(F.filter("future", lambda f: f["ahead"] <= F.col("ask")), F.lit(-1)), zero)
    near = near.withColumns({"_a": before, "_z": after})
    share = (F.col("ask") - F.col("_a.ahead")) / (F.col("_z.ahead") - F.col("_a.ahead"))
    read = lambda c: F.when(F.col("_a.ahead") == F.col("ask"), F.col(f"_a.{c}")).otherwise(F.col(f"_a.{c}") + share * (F.col(f"_z.{c}") - F.col(f"_a.{c}")))
    near = near.withColumns({"e": read("e"), "n": read("n"), "w": 1 / (F.col("d") + 0.1)}).where("e is not null")
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    e, n = F.col("e"), F.col("n")
    g = near.groupBy("sample_id", "horizon_min").agg(F.count("*").alias("k"), mean(e).alias("me"), mean(n).alias("mn"), mean(e * e).alias("ee"), mean(n * n).alias("nn"), mean(e * n).alias("en")).where(F.col("k") >= MIN_NEIGHBOURS)
    g = g.select("sample_id", "horizon_min", F.col("me").alias("k_me"), F.col("mn").alias("k_mn"), (F.col("ee") - F.col("me") ** 2 + SPREAD_M**2).alias("k_cee"), (F.col("nn") - F.col("mn") ** 2 + SPREAD_M**2).alias("k_cnn"), (F.col("en") - F.col("me") * F.col("mn")).alias("k_cen"))
    f = fallback.join(g, ["sample_id", "horizon_min"], "left")
    pick = lambda c: F.when(F.col("k_me").isNotNull(), F.col(f"k_{c}")).otherwise(F.col(c)).alias(c)
    return f.select(F.lit("knn").alias("model"), "sample_id", "horizon_min", "lat0", "lon0", *map(pick, ("me", "mn", "cee", "cnn", "cen")), F.col("k_me").isNotNull().alias("analog"))


def nearest_vectors(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, block: int = 512) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest other vectors by Euclidean distance, exactly.

    The queries are a stated set and go out in blocks; each batch of vectors keeps k for each query of a block, so that
    the shuffle holds k rows for each query and batch, whatever the number of vectors.
    """
    out = None
    for at in range(0, max(1, len(queries)), block):
        ids = np.array([q for q, _ in queries[at : at + block]], np.int64)
        q = np.array([v for _, v in queries[at : at + block]], float)

        def run(batches, ids=ids, q=q):
            for b in batches:
                if len(b) and len(ids):
                    m, names = np.stack(b["v"].to_numpy()), b["vec_id"].to_numpy()
                    d = np.sqrt(np.maximum(((q[:, None] - m[None]) ** 2).sum(-1), 0)) if m.size * len(q) < 5e7 else np.array([np.sqrt(((m - x) ** 2).sum(1)) for x in q])
                    order = np.lexsort((np.broadcast_to(names, d.shape), d), axis=1)[:, : k + 1]
                    yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": names[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()})

        part = vectors.select("vec_id", "v").where("v is not null").mapInPandas(run, "query_id long, vec_id long, distance double")
        out = part if out is None else out.unionAll(part)
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.where("query_id != vec_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

