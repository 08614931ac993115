"""The registered queries for the operators over position reports. Floats are rounded after all arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import cell, course_bin, edge_km, enu, sog_cog, velocity, with_latlon
from wakeline.operators import clean, context, detectors, evaluate, samples, segment, sequence
from wakeline.plans.fixture import CONFIG, cleaned, fixes, points, raw, voyages
from wakeline.plans.fixture import context as learned

ORIGIN = CONFIG.region.origin


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def us(c: str) -> Column:
    return F.unix_micros(c)


def event_rows(e: DataFrame) -> DataFrame:
    return rounded(e.select("type", "mmsi", "mmsi2", "vessel_group", us("t_start").alias("start_us"), us("t_end").alias("end_us"), "lat", "lon", "lat_end", "lon_end", F.round("duration_min", 3).alias("duration_min"), "score"))


def _fixes(s, d):
    return rounded(fixes(s, d).select("event_id", "mmsi", "us", "lat", "lon", "sog_kn", "cog_deg", "vessel_type"))


def _region_filter(s, d):
    f = fixes(s, d).where(F.col("lat").between(42.0, 42.5) & F.col("lon").between(-83.3, -82.8))
    return rounded(f.select("event_id", "mmsi", "lat", "lon"))


def _vessel_group_counts(s, d):
    return fixes(s, d).groupBy(clean.vessel_group().alias("vessel_group")).agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"))


def _clean_points(s, d):
    return rounded(cleaned(s, d).select("_row", "mmsi", "us", "lat", "lon", "sog_kn", "cog_deg", "heading_deg"))


def _clean_report(s, d):
    return clean.clean_report(raw(s, d))


def _dedup_first(s, d):
    return rounded(sequence.keep_first(raw(s, d), ["mmsi", "us"], ["_row"]).select("_row", "mmsi", "us", "sog_kn"))


def _step_kinematics(s, d):
    steps = rounded(cleaned(s, d).select("_row", "mmsi", *(f"{a}_{w}_{u}" for w in ("prev", "next") for a, u in (("dist", "m"), ("v", "kn"))), *(F.col(f"dt_{w}_s").cast("decimal(20,6)").alias(f"dt_{w}_s") for w in ("prev", "next"))), 5)
    return steps.withColumns({c: F.col(c).cast("double") for c in ("dt_prev_s", "dt_next_s")})


def _spike_flags(s, d):
    return cleaned(s, d).select("_row", "mmsi", "spike")


def _assign_voyages(s, d):
    return points(s, d).select("_row", "mmsi", "us", "voyage_id")


def _voyage_summary(s, d):
    v = voyages(s, d).drop("vessel_name")
    return rounded(v.withColumn("start_us", us("t_start")).withColumn("end_us", us("t_end")).drop("t_start", "t_end"), 5)


def _split_summary(s, d):
    return rounded(segment.split_summary(voyages(s, d)), 4)


def _group_summary(s, d):
    return segment.group_summary(voyages(s, d))


def _unseen_vessels(s, d):
    return segment.unseen_vessels(voyages(s, d).where("usable"), "val")


def _latlon_enu(s, d):
    e, n = enu("lat", "lon", *ORIGIN)
    ve, vn = velocity("sog_kn", "cog_deg")
    return rounded(fixes(s, d).select("event_id", e.alias("east"), n.alias("north"), ve.alias("ve"), vn.alias("vn"), edge_km("lat", "lon", CONFIG.region.box).alias("edge_km")), 5)


def _enu_round_trip(s, d):
    e, n = enu("lat", "lon", *ORIGIN)
    ve, vn = velocity("sog_kn", "cog_deg")
    f = fixes(s, d).withColumns({"e": e, "n": n, "ve": ve, "vn": vn, "lat0": F.lit(ORIGIN[0]), "lon0": F.lit(ORIGIN[1])})
    sog, cog = sog_cog(F.col("ve"), F.col("vn"))
    f = with_latlon(f, "e", "n", "lat0", "lon0", ("lat1", "lon1"))
    same = (F.abs(F.col("lat1") - F.col("lat")) < 2e-5) & (F.abs(F.col("lon1") - F.col("lon")) < 2e-5)
    return rounded(f.select("event_id", same.alias("same_place"), sog.alias("sog_kn"), F.when(F.col("sog_kn") > 0.01, F.round(cog, 4) % 360).alias("cog_deg")), 5)


def _grid_cells(s, d):
    return fixes(s, d).groupBy(cell("lat", "lon", 2000.0, ORIGIN).alias("cell"), course_bin("cog_deg").alias("bin")).agg(F.count("*").alias("n"))


def _reception_grid(s, d):
    return rounded(context.reception_grid(points(s, d), CONFIG.context, ORIGIN))


def _port_cells(s, d):
    return context.port_cells(points(s, d), CONFIG.context, ORIGIN)


def _traffic_grid(s, d):
    return context.traffic_grid(points(s, d), CONFIG.context, ORIGIN)


def _course_histogram(s, d):
    return rounded(context.course_histogram(points(s, d), CONFIG.context, ORIGIN))


def _vessel_homes(s, d):
    return context.vessel_homes(points(s, d), CONFIG.context, ORIGIN)


def _complete_days(s, d):
    return clean.complete_days(fixes(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def gaps(s, d):
    return detectors.detect_gaps(points(s, d), CONFIG.gap, CONFIG.region, learned(s, d))


def jumps(s, d):
    return detectors.detect_jumps(points(s, d), CONFIG.jump)


def loiter(s, d):
    return detectors.detect_loiter(points(s, d), CONFIG.loiter, learned(s, d))


def deviation(s, d):
    return detectors.detect_deviation(points(s, d), learned(s, d), CONFIG.deviation)


def rendezvous(s, d):
    return detectors.detect_rendezvous(points(s, d), CONFIG.rendezvous, CONFIG.region, learned(s, d))


def every_event(s, d):
    return detectors.all_events([f(s, d) for f in (gaps, jumps, loiter, deviation, rendezvous)])


def _all_events(s, d):
    return rounded(every_event(s, d).groupBy("type", "vessel_group").agg(F.count("*").alias("n"), F.sum("duration_min").alias("minutes"), F.max("score").alias("score")), 4)


def _top_events(s, d):
    return rounded(detectors.top_events(every_event(s, d).withColumn("score", F.round("score", 6)), 5).select("type", "rank", "event_id", "score"))


def _base_alarm_rate(s, d):
    return rounded(detectors.base_alarm_rate(every_event(s, d), points(s, d), 86400.0), 5)


def _event_overlap_match(s, d):
    e = jumps(s, d).unionByName(gaps(s, d))
    t = detectors.with_event_ids(gaps(s, d).unionByName(jumps(s, d))).withColumn("t_start", F.timestamp_micros(us("t_start") + F.lit(3_600_000_000)))
    return detectors.overlap_matches(detectors.with_event_ids(e), t, ["mmsi"]).select("type", "mmsi", "event_id").distinct()


def _new_events(s, d):
    e = gaps(s, d)
    return detectors.with_event_ids(detectors.new_events(e.withColumn("type", F.lit("any")), jumps(s, d).withColumn("type", F.lit("any")), ["mmsi"])).select("mmsi", "event_id")


def _anchors(s, d):
    p = CONFIG.prediction
    return samples.anchors(points(s, d), p.anchor_every_min * 60, p.history_min * 60)


def sample_rows(s, d):
    return samples.build_samples(points(s, d), CONFIG.prediction)


def _interp_truth(s, d):
    return rounded(sample_rows(s, d).select("sample_id", "horizon_min", "lat0", "lon0", "lat_h", "lon_h"), 5)


def _dead_reckoning(s, d):
    return rounded(samples.dead_reckoning(sample_rows(s, d)).withColumns({c: F.round(c, 1) for c in ("me", "mn", "cee", "cnn", "cen")}), 4)


def score_rows(s, d):
    x = sample_rows(s, d)
    dr = samples.dead_reckoning(x)
    still = dr.select(F.lit("stay").alias("model"), "sample_id", "horizon_min", "lat0", "lon0", F.lit(0.0).alias("me"), F.lit(0.0).alias("mn"), "cee", "cnn", "cen")
    return evaluate.per_sample_scores(dr.unionByName(still), x.select("sample_id", "voyage_id", "vessel_group", "horizon_min", "lat_h", "lon_h", "known"))


def _forecast_scores(s, d):
    return rounded(score_rows(s, d), 4)


def _score_summary(s, d):
    return rounded(evaluate.summarise_scores(score_rows(s, d)), 4)


def _cov_scale(s, d):
    return rounded(evaluate.cov_scales(score_rows(s, d)), 4)


def _paired_difference(s, d):
    p = evaluate.paired_differences(score_rows(s, d), "dead_reckoning", "stay")
    return rounded(p.groupBy("horizon_min").agg(F.count("*").alias("n"), F.avg("diff_km").alias("mean_diff_km")), 5)


def _bootstrap_ci(s, d):
    p = evaluate.paired_differences(score_rows(s, d), "dead_reckoning", "stay")
    return rounded(evaluate.cluster_intervals(p, "diff_km", "voyage_id", ("horizon_min",)))


def _manoeuvre_stats(s, d):
    """Percentiles of speed, turn rate and interval over the steps of a vessel."""
    w = sequence.by_time()
    turn = F.abs(F.pmod(F.col("cog_deg") - F.lag("cog_deg").over(w) + 180, F.lit(360.0)) - 180)
    hours = (sequence.micros("t") - F.lag(sequence.micros("t")).over(w)) / 3.6e9
    x = cleaned(s, d).select("sog_kn", turn.alias("turn"), hours.alias("hours"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rounded(x.agg(*(q(c, p).alias(f"{c}_p{int(100 * p)}") for c in ("sog_kn", "turn", "hours") for p in (0.05, 0.5, 0.95))), 5)


def _decimated(s, d):
    return sequence.decimate(points(s, d), 20, ["mmsi"]).select("_row", "mmsi")


def _sample_without_replacement(s, d):
    return sequence.seeded_sample(points(s, d).select("_row"), 100, 7, "_row")


def _embedding_neighbours(s, d):
    """The five nearest vectors of each vector whose id is divisible by 20, exactly, in blocks of queries."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = [(r[0], r[1]) for r in e.where("vec_id % 20 = 0").orderBy("vec_id").collect()]
    from wakeline.operators.analogs import nearest_vectors

    return rounded(nearest_vectors(e, asked, 5).select("query_id", "vec_id", "distance", "rank"), 4)


def _with_module(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s, d):
        import importlib

        return getattr(importlib.import_module(f"wakeline.plans.{module}"), name)(s, d)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fixes": _fixes, "region_filter": _region_filter, "vessel_group_counts": _vessel_group_counts, "clean_points": _clean_points, "clean_report": _clean_report, "dedup_first": _dedup_first,
    "step_kinematics": _step_kinematics, "spike_flags": _spike_flags, "assign_voyages": _assign_voyages, "voyage_summary": _voyage_summary, "split_summary": _split_summary, "group_summary": _group_summary,
    "unseen_vessels": _unseen_vessels, "latlon_enu": _latlon_enu, "enu_round_trip": _enu_round_trip, "grid_cells": _grid_cells, "reception_grid": _reception_grid, "port_cells": _port_cells,
    "traffic_grid": _traffic_grid, "course_histogram": _course_histogram, "vessel_homes": _vessel_homes, "complete_days": _complete_days,
    "detect_gaps": lambda s, d: event_rows(gaps(s, d)), "detect_jumps": lambda s, d: event_rows(jumps(s, d)), "detect_loiter": lambda s, d: event_rows(loiter(s, d)),
    "detect_deviation": lambda s, d: event_rows(deviation(s, d)), "detect_rendezvous": lambda s, d: event_rows(rendezvous(s, d)),
    "all_events": _all_events, "top_events": _top_events, "base_alarm_rate": _base_alarm_rate, "event_overlap_match": _event_overlap_match, "new_events": _new_events,
    "anchors": _anchors, "interp_truth": _interp_truth, "dead_reckoning": _dead_reckoning, "forecast_scores": _forecast_scores, "score_summary": _score_summary, "cov_scale": _cov_scale,
    "paired_difference": _paired_difference, "bootstrap_ci": _bootstrap_ci, "manoeuvre_stats": _manoeuvre_stats, "decimated_track": _decimated, "seeded_sample": _sample_without_replacement, "embedding_neighbours": _embedding_neighbours,
}
QUERIES |= {k: _with_module("more", k) for k in ("track_kf", "track_imm", "nis_report", "filter_forecasts", "tune_filter", "knn_analogs", "knn_forecast", "learned_forecast", "simulate_tracks", "sim_study", "injection_study")
}
