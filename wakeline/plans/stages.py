"""The batch stages from day files to results. Each reads what earlier ones wrote below `root` and writes Parquet there.

build: points, voyages. track: tracks. anomaly: events, base_rate. evaluate: scores and choices on the validation split.
holdout: the choices, unchanged, on the test split. tune: a grid of detector settings. export: JSON.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.config import COMMERCIAL, Config
from wakeline.operators import analogs, detectors, evaluate, inject, learned, samples, segment, tracking
from wakeline.operators.clean import clean_points, complete_days, vessel_group
from wakeline.operators.context import Learned, learn
from wakeline.sources import export, ingest

TRUTH = ("sample_id", "voyage_id", "vessel_group", "horizon_min", "lat_h", "lon_h", "known")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def build(spark: SparkSession, root: str, config: Config) -> None:
    raw = ingest.read_reports(spark, f"{root}/reports")
    p = segment.assign_voyages(clean_points(raw, config.clean), config.segment)
    export.write_points(p, f"{root}/cleaned")
    p = read(spark, root, "cleaned")
    export.write_points(segment.summarise_voyages(p, config), f"{root}/voyages")
    export.write_points(segment.enrich(p, read(spark, root, "voyages")), f"{root}/points", "split")


def track(spark: SparkSession, root: str, config: Config) -> None:
    p = read(spark, root, "points").where("usable")
    export.write_points(tracking.track_all(p, states=True), f"{root}/tracks")


def detector_set(config: Config, ctx: Learned | None, days: Sequence | None = None) -> dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]]:
    """The detectors by type, as functions of points and key."""
    return {
        "gap": lambda p, k=("mmsi",): detectors.detect_gaps(p, config.gap, config.region, ctx, days, k),
        "jump": lambda p, k=("mmsi",): detectors.detect_jumps(p, config.jump, k),
        "loiter": lambda p, k=("mmsi",): detectors.detect_loiter(p, config.loiter, ctx, k),
        "deviation": lambda p, k=("mmsi",): detectors.detect_deviation(p, ctx, config.deviation, k),
        "rendezvous": lambda p, k=("mmsi",): detectors.detect_rendezvous(p, config.rendezvous, config.region, ctx, k),
    }


def anomaly(spark: SparkSession, root: str, config: Config) -> None:
    p = read(spark, root, "points").withColumn("vessel_group", F.coalesce("vessel_group", vessel_group()))
    ctx = learn(p.where("split = 'train'"), config.context, config.region).persist()
    days = [r["day"] for r in complete_days(p).collect()]  # one row a day
    export.write_points(detectors.all_events([f(p) for f in detector_set(config, ctx, days).values()]), f"{root}/events")
    e = read(spark, root, "events")
    test = p.where("split = 'test'")
    inside = e.join(test.select("mmsi", F.col("t").alias("t_start")), ["mmsi", "t_start"], "left_semi")
    export.write_points(detectors.base_alarm_rate(inside, test), f"{root}/base_rate")


def _forecasts(spark: SparkSession, root: str, config: Config, split: str) -> tuple[DataFrame, DataFrame]:
    """Truth and uncalibrated forecasts of all models for the samples of a split; models learn from the training split."""
    p, prm, origin = read(spark, root, "points").where("usable"), config.prediction, config.region.origin
    own, train = p.where(F.col("split") == split), p.where("split = 'train'")
    s, t = samples.build_samples(own, prm), read(spark, root, "tracks")
    at = tracking.with_states(s, t, [c for c in t.columns if c.startswith("f_")])
    dr = samples.dead_reckoning(s)
    library = analogs.build_library(train, origin, prm, 300.0, [300 * i for i in range(1, 37)])
    rows = learned.fit(learned.features(samples.build_samples(train, prm), train))
    parts = [dr, samples.constant_velocity(at, tracking.CvParameters().q), tracking.imm_forecasts(s, t, switch=True), tracking.imm_forecasts(s, t, switch=False), analogs.knn_forecast(s, library, dr, origin, prm).drop("analog")]
    if rows:
        parts.append(learned.forecast(learned.features(s, own), rows))
    return s.select(*TRUTH), detectors.all_events(parts)


def evaluate_stage(spark: SparkSession, root: str, config: Config) -> None:
    truth, fc = _forecasts(spark, root, config, "val")
    export.write_points(evaluate.per_sample_scores(fc, truth), f"{root}/val_raw")
    raw = read(spark, root, "val_raw")
    export.write_points(evaluate.cov_scales(raw), f"{root}/cov_scales")
    own = F.col("model").isin(*evaluate.BASELINES)
    best = [evaluate.best_model(raw.where(cond)).withColumn("role", F.lit(role)) for role, cond in (("baseline", own), ("learned", ~own))]
    export.write_points(detectors.all_events(best), f"{root}/choices")
    export.write_points(evaluate.summarise_scores(evaluate.per_sample_scores(evaluate.with_cov_scale(fc, read(spark, root, "cov_scales")), truth)), f"{root}/val_summary")


def holdout(spark: SparkSession, root: str, config: Config) -> None:
    """All models on the test split, by horizon and by group, and on vessels that training never saw; the paired verdict."""
    truth, fc = _forecasts(spark, root, config, "test")
    export.write_points(evaluate.per_sample_scores(evaluate.with_cov_scale(fc, read(spark, root, "cov_scales")), truth), f"{root}/test_scores")
    s = read(spark, root, "test_scores")
    export.write_points(evaluate.summarise_scores(s), f"{root}/test_summary")
    export.write_points(evaluate.summarise_scores(s, ("model", "horizon_min", "vessel_group")), f"{root}/test_by_group")
    v = read(spark, root, "voyages")
    fresh = v.join(segment.unseen_vessels(v), "mmsi", "left_semi").select("voyage_id")
    export.write_points(evaluate.summarise_scores(s.join(fresh, "voyage_id", "left_semi")), f"{root}/test_unseen")
    chosen = read(spark, root, "choices").where("role = 'learned'").first()
    if chosen:
        export.write_points(evaluate.verdict(s, chosen["model"], config.prediction.n_boot), f"{root}/verdict")


def tune(spark: SparkSession, root: str, config: Config, kind: str, grid: dict[str, Sequence], magnitudes: Sequence[float], span_min: Callable[[float], float], n: int = 60) -> DataFrame:
    """Precision, recall and base rate of each candidate of a detector's settings, by injection into the validation split.

    The settings of `config` are a candidate too (`own`); `eligible` and `chosen` follow `evaluate.pick_setting`.
    """
    p = read(spark, root, "points")
    ctx = learn(p.where("split = 'train'"), config.context, config.region).persist()
    own = p.where("split = 'val'").where(F.col("vessel_group").isin(*COMMERCIAL))
    chosen = inject.choose(own, kind, magnitudes, span_min, n, config.region)
    parts, now = [], tuple(getattr(getattr(config, kind), k) for k in grid)
    hours = detectors.vessel_hours(own).agg(F.sum("hours").alias("hours"))
    for values in dict.fromkeys([now, *itertools.product(*grid.values())]):  # one plan for each candidate
        c = dataclasses.replace(config, **{kind: dataclasses.replace(getattr(config, kind), **dict(zip(grid, values)))})
        run = detector_set(c, ctx)[kind]
        rows = evaluate.precision_recall(inject.injection_study(own, chosen, kind, run, config.region))
        base = run(own).agg(F.count("*").alias("base_events"))
        rows = rows.join(F.broadcast(base)).join(F.broadcast(hours)).withColumn("base_per_1000_h", 1000 * F.col("base_events") / F.col("hours")).drop("hours")
        parts.append(rows.withColumn("settings", F.lit(json.dumps(dict(zip(grid, values))))).withColumn("own", F.lit(values == now)))
    return evaluate.pick_setting(detectors.all_events(parts))


def showcase(voyages: DataFrame, per_group: int = 3, seed: int = 0) -> DataFrame:
    """Voyages drawn from the longer half of each commercial group, the same ones every time; one for a vessel."""
    v = voyages.where(F.col("usable") & F.col("vessel_group").isin(*COMMERCIAL))
    v = v.withColumn("_r", F.percent_rank().over(Window.partitionBy("vessel_group").orderBy("duration_min"))).where("_r >= 0.5")
    draw = F.xxhash64("voyage_id", F.lit(seed))
    v = v.withColumn("_k", F.row_number().over(Window.partitionBy("mmsi").orderBy(draw))).where("_k = 1")
    return v.withColumn("_k", F.row_number().over(Window.partitionBy("vessel_group").orderBy(draw))).where(F.col("_k") <= per_group).drop("_r", "_k")


def export_stage(spark: SparkSession, root: str, config: Config) -> None:
    v = showcase(read(spark, root, "voyages"))
    export.voyage_payload(read(spark, root, "tracks").join(v, "voyage_id", "left_semi"), v).select("json").write.mode("overwrite").text(f"{root}/json_voyages")
    export.anomaly_payload(detectors.top_events(read(spark, root, "events"), 200).drop("rank", "event_id")).write.mode("overwrite").text(f"{root}/json_events")
    if root.startswith("/"):
        export.write_text(str(Path(root) / "summary.md"), export.summary_markdown(read(spark, root, "voyages")) + f"\n\nconfig {config.hash()}")


STAGES: dict[str, Callable[[SparkSession, str, Config], None]] = {"build": build, "track": track, "evaluate": evaluate_stage, "holdout": holdout, "anomaly": anomaly, "export": export_stage}
