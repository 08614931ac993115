"""Queries whose operators are recursions, simulations or models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import analogs, detectors, evaluate, inject, learned, samples, segment, simulate, tracking
from wakeline.plans.fixture import CONFIG, points, voyages
from wakeline.plans.fixture import context as learn_context
from wakeline.plans.queries import rounded, sample_rows, us

P, REGION = CONFIG.prediction, CONFIG.region
#: Fixes half a day apart need a softer model than reports a minute apart.
CV = tracking.CvParameters(q=1e-3, r_m=50.0, gate=0.999999)
IMM = tracking.ImmParameters(r_m=50.0, q_cruise=1e-3, clutter=1e-14)
TRUTH = ("sample_id", "voyage_id", "vessel_group", "horizon_min", "lat_h", "lon_h", "known")


def tracks(s, d, states=False):
    return tracking.track_all(points(s, d), CV, IMM, states)


def track_kf(s, d):
    return rounded(tracks(s, d).select("voyage_id", us("t").alias("us"), "f_lat", "f_lon", "f_ve", "f_vn", "nis", "accepted", "reinit"), 5)


def track_imm(s, d):
    return rounded(tracks(s, d).select("voyage_id", us("t").alias("us"), "i_lat", "i_lon", "i_stationary", "i_cruise", "i_turn", "i_nis", "i_accepted", "s_lat", "s_lon"), 5)


def nis_report(s, d):
    t = tracks(s, d)
    return rounded(evaluate.nis_consistency(t).withColumn("filter", F.lit("cv_kalman")).unionAll(evaluate.nis_consistency(t, "i_nis", "i_accepted").withColumn("filter", F.lit("imm"))), 4)


def filter_forecasts(s, d):
    t, x = tracks(s, d, True), sample_rows(s, d)
    f = tracking.with_states(x, t, [c for c in t.columns if c.startswith("f_")])
    cv = samples.constant_velocity(f, CV.q)
    both = cv.unionByName(tracking.imm_forecasts(x, t, IMM, True)).unionByName(tracking.imm_forecasts(x, t, IMM, False))
    return rounded(evaluate.summarise_scores(evaluate.per_sample_scores(both, x.select(*TRUTH))), 4)


def tune_filter(s, d):
    return rounded(tracking.tune(points(s, d), [tracking.CvParameters(q=q, r_m=50.0) for q in (1e-4, 1e-3, 1e-2)]), 4)


def _train_library(s, d):
    """Samples outside the training split, and the library of the voyages inside it."""
    split = voyages(s, d).select("voyage_id", "split")
    train = points(s, d).join(split.where("split = 'train'"), "voyage_id", "left_semi")
    asked = sample_rows(s, d).join(split.where("split != 'train'"), "voyage_id", "left_semi")
    return asked, analogs.build_library(train, REGION.origin, P, 3600.0, [3600 * h for h in (2, 4, 8, 12, 16, 20)])


def knn_analogs(s, d):
    x, library = _train_library(s, d)
    return rounded(analogs.neighbours(x, library, REGION.origin, P).where("rank <= 5").select("sample_id", "library_id", "d", "rank"))


def knn_forecast(s, d):
    x, library = _train_library(s, d)
    return rounded(analogs.knn_forecast(x, library, samples.dead_reckoning(x), REGION.origin, P).select("sample_id", "horizon_min", "me", "mn", "cee", "cnn", "analog"), 2)


def learned_forecast(s, d):
    x = segment.enrich(points(s, d), voyages(s, d))
    split = x.select("voyage_id", "split").distinct()
    rows = learned.features(sample_rows(s, d), points(s, d)).join(split, "voyage_id")
    got = learned.forecast(rows.where("split != 'train'"), learned.fit(rows.where("split = 'train'")))
    return rounded(evaluate.summarise_scores(evaluate.per_sample_scores(got, rows.select(*TRUTH))), 4)


def simulate_tracks(s, d):
    return rounded(simulate.simulate(s, range(8), n=60), 3)


def sim_study(s, d):
    return rounded(simulate.study(simulate.follow(simulate.simulate(s, range(8), n=120))), 3)


def injection_study(s, d):
    p, ctx = points(s, d), learn_context(s, d)
    run = {
        "gap": lambda x, k: detectors.detect_gaps(x, CONFIG.gap, REGION, None, None, k), "jump": lambda x, k: detectors.detect_jumps(x, CONFIG.jump, k), "loiter": lambda x, k: detectors.detect_loiter(x, CONFIG.loiter, None, k),
        "deviation": lambda x, k: detectors.detect_deviation(x, ctx, CONFIG.deviation, k), "rendezvous": lambda x, k: detectors.detect_rendezvous(x, CONFIG.rendezvous, REGION, None, k),
    }
    plan = {"gap": ((13.0, 30.0), lambda m: m * 60), "jump": ((5.0, 30.0), lambda m: 60.0), "loiter": ((13.0, 20.0), lambda m: m * 60), "deviation": ((2.0, 8.0), lambda m: 720.0), "rendezvous": ((7.0, 13.0), lambda m: m * 60)}
    # The host needs only a fix to start from here, as fixes lie half a day apart.
    parts = []
    for kind, (magnitudes, span) in plan.items():
        chosen = _chosen(p, kind, magnitudes, span)
        rows = inject.injection_study(p, chosen, kind, run[kind], REGION)
        parts.append(evaluate.precision_recall(rows, ("type", "magnitude")))
    return rounded(detectors.all_events(parts), 4)


def _chosen(p, kind, magnitudes, span):
    out = []
    for m in magnitudes:
        c = p.groupBy("voyage_id", "mmsi").agg(F.min("t").alias("t_start"), F.count("*").alias("n")).where("n >= 3").orderBy(F.xxhash64("voyage_id", F.lit(str(m)))).limit(15)
        out.append(c.select(F.concat_ws("-", F.lit(kind), F.lit(str(m)), "voyage_id").alias("injection_id"), F.lit(kind).alias("type"), "voyage_id", "mmsi", "t_start", F.timestamp_micros(us("t_start") + int(span(m) * 6e7)).alias("t_end"), F.lit(float(m)).alias("magnitude")))
    return detectors.all_events(out)
