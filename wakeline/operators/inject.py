"""Synthetic anomalies put into real tracks, and a study of how many the detectors find.

Every injection is a row; the voyages it concerns are replicated under its injection_id, and each detector runs once over
all of them, keyed by (injection_id, mmsi).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import Region
from wakeline.functions.geo import edge_km, enu, with_latlon
from wakeline.operators.detectors import new_events, overlap_matches
from wakeline.operators.sequence import micros

KEY = ("injection_id", "mmsi")


def uniform(seed: int, *ids: str) -> Column:
    """A number in [0, 1) that depends only on the seed and the row."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 40)) / float(1 << 40)


def eligible(points: DataFrame, kind: str, span_min: float, region: Region, tail_min: float = 15.0, skip: int = 5, window_min: float = 5.0) -> DataFrame:
    """Fixes at which an anomaly of this type may begin: moving, away from the edge, with enough voyage left."""
    w = Window.partitionBy("voyage_id").orderBy("t")
    every = Window.partitionBy("voyage_id")
    near = Window.partitionBy("voyage_id").orderBy(micros("t")).rangeBetween(-int(window_min * 6e7), int(window_min * 6e7))
    least, far = {"gap": (3.0, 5.0), "deviation": (3.0, 5.0), "jump": (2.0, 0.0), "loiter": (2.0, 3.0), "rendezvous": (2.0, 3.0)}[kind]
    p = points.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(every), "_end": F.max("t").over(every), "_edge": edge_km("lat", "lon", region.box), "_sog": F.coalesce("sog_kn", F.lit(0.0))})
    steady = (F.min("_sog").over(near) >= least) & (F.min("_edge").over(near) >= far) if kind in ("gap", "deviation") else (F.col("_sog") >= least) & (F.col("_edge") >= far)
    p = p.withColumn("_ok", steady).where((F.col("_k") > skip) & (F.col("_k") <= F.col("_n") - skip) & F.col("_ok"))
    return p.where((micros("_end") - micros("t")) / 6e7 >= span_min + tail_min).drop("_k", "_n", "_end", "_edge", "_sog", "_ok")


def choose(points: DataFrame, kind: str, magnitudes: Sequence[float], span_min: Callable[[float], float], n: int, region: Region, seed: int = 0) -> DataFrame:
    """n injections: injection_id, type, voyage_id, mmsi, t_start, t_end, magnitude; one for a voyage and magnitude at most."""
    parts = []
    for i, m in enumerate(magnitudes):
        c = eligible(points, kind, span_min(m), region).withColumn("_u", F.xxhash64(F.lit(seed + i), "voyage_id", micros("t")))
        c = c.groupBy("voyage_id", "mmsi").agg(F.min_by("t", "_u").alias("t_start"), F.min("_u").alias("_u")).orderBy("_u", "voyage_id").limit(max(1, n // len(magnitudes)))
        parts.append(c.select(F.concat_ws("-", F.lit(kind), F.lit(str(m)), "voyage_id").alias("injection_id"), F.lit(kind).alias("type"), "voyage_id", "mmsi", "t_start", F.timestamp_micros(micros("t_start") + int(span_min(m) * 6e7)).alias("t_end"), F.lit(float(m)).alias("magnitude")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def replicate(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The points of each host voyage under its injection_id, with _s, _e (microseconds) and magnitude."""
    c = chosen.select("injection_id", "voyage_id", micros("t_start").alias("_s"), micros("t_end").alias("_e"), "magnitude")
    return points.join(c, "voyage_id").withColumn("_t", micros("t"))


def inject_gap(p: DataFrame) -> DataFrame:
    return p.where(~((F.col("_t") > F.col("_s")) & (F.col("_t") < F.col("_e"))))


def _moved(p: DataFrame, east: Column, north: Column, where: Column, region: Region) -> DataFrame:
    e, n = enu("lat", "lon", *region.origin)
    p = p.withColumns({"_hit": where, "_e2": e + east, "_n2": n + north, "_a0": F.lit(region.origin[0]), "_o0": F.lit(region.origin[1])})
    p = with_latlon(p, "_e2", "_n2", "_a0", "_o0", ("_lat", "_lon"))
    return p.withColumns({"lat": F.when(F.col("_hit"), F.col("_lat")).otherwise(F.col("lat")), "lon": F.when(F.col("_hit"), F.col("_lon")).otherwise(F.col("lon"))}).drop("_hit", "_e2", "_n2", "_a0", "_o0", "_lat", "_lon")


def inject_jump(p: DataFrame, region: Region, fixes: int = 3, seed: int = 1) -> DataFrame:
    """The first fixes from the start on stand `magnitude` km away in one random direction."""
    k = F.row_number().over(Window.partitionBy("injection_id", F.col("_t") >= F.col("_s")).orderBy("_t"))
    th = 2 * 3.141592653589793 * uniform(seed, "injection_id")
    return _moved(p.withColumn("_k", k), 1000 * F.col("magnitude") * F.sin(th), 1000 * F.col("magnitude") * F.cos(th), (F.col("_t") >= F.col("_s")) & (F.col("_k") <= fixes), region).drop("_k")


def inject_deviation(p: DataFrame, region: Region, seed: int = 2) -> DataFrame:
    """A sideways bump of `magnitude` km, a squared sine over the span."""
    share = (F.col("_t") - F.col("_s")) / (F.col("_e") - F.col("_s"))
    side = 1000 * F.col("magnitude") * F.pow(F.sin(3.141592653589793 * share), 2) * F.when(uniform(seed, "injection_id") < 0.5, -1.0).otherwise(1.0)
    c = F.radians(F.coalesce("cog_deg", F.lit(0.0)))
    return _moved(p, side * F.cos(c), -side * F.sin(c), F.col("_t").between(F.col("_s"), F.col("_e")), region)


def _drift(at: DataFrame, region: Region, every_s: int, radius_m: float, seed: int) -> DataFrame:
    """Slow fixes around one position every every_s seconds over the span, less the last step."""
    d = at.withColumn("_t", F.explode(F.sequence(F.col("_s"), F.col("_e") - every_s * 1_000_000, F.lit(every_s * 1_000_000))))
    th = 2 * 3.141592653589793 * uniform(seed, "injection_id", "_t")
    r = radius_m * uniform(seed + 1, "injection_id", "_t")
    d = d.withColumns({"t": F.timestamp_micros("_t"), "sog_kn": 0.2 + 0.6 * uniform(seed + 2, "injection_id", "_t"), "cog_deg": 360 * uniform(seed + 3, "injection_id", "_t")})
    return _moved(d, r * F.sin(th), r * F.cos(th), F.lit(True), region)


def inject_loiter(p: DataFrame, region: Region, every_s: int = 180, radius_m: float = 150.0, seed: int = 3) -> DataFrame:
    """The vessel stops at the start, drifts over the span, and what follows is later by the span."""
    w = Window.partitionBy("injection_id").orderBy(F.desc("_t"))
    before = p.where(F.col("_t") < F.col("_s"))
    host = p.where(F.col("_t") <= F.col("_s")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    after = p.where(F.col("_t") >= F.col("_s")).withColumn("_t", F.col("_t") + F.col("_e") - F.col("_s"))
    after = after.withColumn("t", F.timestamp_micros("_t"))
    return before.unionByName(_drift(host, region, every_s, radius_m, seed)).unionByName(after)


def inject_rendezvous(p: DataFrame, region: Region, every_s: int = 180, approach_min: float = 30.0, seed: int = 5) -> DataFrame:
    """The host loiters; a partner (MMSI 999000000 and up) comes in over half an hour, stays near, and leaves again."""
    host = inject_loiter(p, region, every_s, 100.0, seed)
    w = Window.partitionBy("injection_id").orderBy(F.desc("_t"))
    at = p.where(F.col("_t") <= F.col("_s")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    lead = int(approach_min * 6e7)
    d = at.withColumn("_t", F.explode(F.sequence(F.col("_s") - lead, F.col("_e") + lead, F.lit(every_s * 1_000_000))))
    away = F.greatest(F.col("_s") - F.col("_t"), F.col("_t") - F.col("_e"), F.lit(0)) / 1e6 * 4.0  # metres at 4 m/s
    th = 2 * 3.141592653589793 * uniform(seed + 7, "injection_id")
    d = d.withColumns({"t": F.timestamp_micros("_t"), "sog_kn": F.when(away > 0, 7.8).otherwise(0.5), "mmsi": F.lit(999_000_000) + F.pmod(F.xxhash64("injection_id"), F.lit(900_000)), "vessel_group": F.lit("other")})
    return host.unionByName(_moved(d, (away + 80) * F.sin(th), (away + 80) * F.cos(th), F.lit(True), region))


INJECTORS = {"gap": lambda p, r: inject_gap(p), "jump": inject_jump, "loiter": inject_loiter, "deviation": inject_deviation, "rendezvous": inject_rendezvous}


def injection_study(points: DataFrame, chosen: DataFrame, kind: str, detect: Callable[[DataFrame, Sequence[str]], DataFrame], region: Region) -> DataFrame:
    """One row for each injection: detected, new_events, matched_events."""
    before = replicate(points, chosen)
    after = INJECTORS[kind](before, region)
    drop = ("_s", "_e", "_t", "magnitude")
    found = detect(after.drop(*drop), KEY)
    fresh = new_events(found, detect(before.drop(*drop), KEY), ["injection_id"])
    match = overlap_matches(fresh, chosen, ["injection_id"]).groupBy("injection_id").agg(F.count("*").alias("matched_events"))
    new = fresh.groupBy("injection_id").agg(F.count("*").alias("new_events"))
    out = chosen.join(new, "injection_id", "left").join(match, "injection_id", "left").na.fill(0, ["new_events", "matched_events"])
    return out.withColumn("detected", F.col("matched_events") > 0)
