"""Forecast samples: greedily spaced anchors, interpolated truth, and the dead-reckoning baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import Prediction
from wakeline.functions.geo import enu, velocity, with_latlon
from wakeline.operators.sequence import micros


def anchors(points: DataFrame, every_s: float, history_s: float, key: str = "voyage_id") -> DataFrame:
    """The first fix with enough history, then each fix at least every_s after the last chosen one.

    The rule is recursive, so the times of one voyage are folded as an array; a voyage is bounded by its length.
    """
    t = points.groupBy(key).agg(F.array_sort(F.collect_set(micros("t"))).alias("_t"))
    first = F.element_at("_t", 1)
    empty = F.array().cast("array<bigint>")

    def take(acc: Column, x: Column) -> Column:
        ready = x - first >= int(history_s * 1e6)
        spaced = (F.size(acc) == 0) | (x - F.coalesce(F.try_element_at(acc, F.lit(-1)), x) >= int(every_s * 1e6))
        return F.when(ready & spaced, F.concat(acc, F.array(x))).otherwise(acc)

    return t.select(key, F.explode(F.aggregate("_t", empty, take)).alias("us"))


def truth_at(asked: DataFrame, points: DataFrame, bracket_s: float, key: str = "voyage_id") -> DataFrame:
    """Positions at the times `at_us` of `asked` (key, at_us, ...), between the fixes before and after.

    Both must lie within bracket_s of the time; an exact hit always counts. The line is drawn in the frame of the
    voyage's first fix. Asked times and fixes are merged on one window, so no range join is needed.
    """
    w = Window.partitionBy(key).orderBy("us", "kind")
    # The fix after a time is the last one backwards: a frame that shrinks towards the end would be walked for every row.
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy(key).orderBy(F.desc("us"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    fix = F.struct("us", "lat", "lon")
    p = points.select(key, micros("t").alias("us"), F.lit(0).alias("kind"), "lat", "lon")
    q = asked.select(key, F.col("at_us").alias("us"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")).distinct()
    m = p.unionByName(q).withColumn("_f", F.when(F.col("kind") == 0, fix))
    m = m.select(key, "us", "kind", F.last("_f", True).over(back).alias("a"), F.last("_f", True).over(forth).alias("z"), F.first("_f", True).over(Window.partitionBy(key).orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("o"))
    m = m.where("kind = 1")
    hit = F.col("a.us") == F.col("us")
    ok = F.coalesce(hit | ((F.col("us") - F.col("a.us") <= int(bracket_s * 1e6)) & (F.col("z.us") - F.col("us") <= int(bracket_s * 1e6))), F.lit(False))
    (e0, n0), (e1, n1) = (enu(F.col(f"{x}.lat"), F.col(f"{x}.lon"), F.col("o.lat"), F.col("o.lon")) for x in "az")
    m = m.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_ok": ok, "_share": (F.col("us") - F.col("a.us")) / F.nullif(F.col("z.us") - F.col("a.us"), F.lit(0)), "_e0": e0, "_n0": n0, "_e1": e1, "_n1": n1, "_la": F.col("o.lat"), "_lo": F.col("o.lon")})
    m = m.withColumns({"_e": F.col("_e0") + F.col("_share") * (F.col("_e1") - F.col("_e0")), "_n": F.col("_n0") + F.col("_share") * (F.col("_n1") - F.col("_n0"))})
    m = with_latlon(m, "_e", "_n", "_la", "_lo", ("_lat", "_lon"))
    # `known` tells whether there is a position; a filter on the position itself would be pushed down as its whole expression.
    found = m.select(key, F.col("us").alias("at_us"), (F.col("_hit") | F.col("_ok")).alias("known"), *(F.when(F.col("_hit"), F.col(f"a.{c}")).when(F.col("_ok"), F.col(f"_{c}")).alias(f"{c}_h") for c in ("lat", "lon")))
    return asked.join(found, [key, "at_us"], "left")


def build_samples(points: DataFrame, p: Prediction | None = None) -> DataFrame:
    """One row for each anchor of a vessel under way and horizon: sample_id, start and true position."""
    p = p or Prediction()
    a = anchors(points, p.anchor_every_min * 60, p.history_min * 60)
    at = points.select("voyage_id", "mmsi", "vessel_group", F.col("t").alias("t0"), micros("t").alias("us"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), "sog_kn", "cog_deg")
    s = at.join(a, ["voyage_id", "us"], "left_semi").where((F.col("sog_kn") >= p.min_sog_kn) & F.col("cog_deg").isNotNull())
    s = s.withColumn("sample_id", F.concat_ws("@", "voyage_id", F.date_format("t0", "yyyyMMdd'T'HHmmss")))
    s = s.withColumn("horizon_min", F.explode(F.array(*map(F.lit, p.horizons_min)))).withColumn("at_us", F.col("us") + F.col("horizon_min").cast("long") * 60_000_000)
    return truth_at(s, points, p.bracket_s).drop("at_us", "us")


def dead_reckoning(samples: DataFrame, least_sigma_m: float = 50.0, share: float = 0.1) -> DataFrame:
    """Straight on at the reported speed and course; the spread is a tenth of the way, 50 m at least."""
    ve, vn = velocity("sog_kn", "cog_deg")
    s = F.col("horizon_min") * 60
    var = F.pow(F.greatest(share * F.hypot(ve, vn) * s, F.lit(least_sigma_m)), 2)
    return samples.select(F.lit("dead_reckoning").alias("model"), "sample_id", "horizon_min", "lat0", "lon0", (ve * s).alias("me"), (vn * s).alias("mn"), var.alias("cee"), var.alias("cnn"), F.lit(0.0).alias("cen"))


def constant_velocity(samples: DataFrame, q: float) -> DataFrame:
    """Forecast of a filtered state (f_lat, f_lon, f_ve, f_vn and its covariances f_pee ... f_pvn): F x, F P F' + Q."""
    h = (F.col("horizon_min") * 60).cast("double")
    e, n = enu("f_lat", "f_lon", "lat0", "lon0")
    c = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    grow = lambda pos, mix, vel: pos + 2 * h * mix + h * h * vel + q * h * h * h / 3
    cen = c("f_pen") + h * (c("f_pevn") + c("f_pnve")) + h * h * c("f_pvevn")
    return samples.select(F.lit("cv_kalman").alias("model"), "sample_id", "horizon_min", "lat0", "lon0", (e + F.col("f_ve") * h).alias("me"), (n + F.col("f_vn") * h).alias("mn"), grow(c("f_pee"), c("f_peve"), c("f_pveve")).alias("cee"), grow(c("f_pnn"), c("f_pnvn"), c("f_pvnvn")).alias("cnn"), cen.alias("cen"))
