"""Simulated tracks with truth, and how well the filters follow them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.stats import chi2_quantile
from wakeline.operators.tracking import CvParameters, ImmParameters, run_cv, run_imm

SIM_SCHEMA = "seed long, k int, t double, segment string, te double, tn double, tve double, tvn double, ze double, zn double, outlier boolean"


def simulate_track(seed: int, n: int = 240, noise_m: float = 5.0, outlier_rate: float = 0.02, outlier_m: float = 2000.0, mean_step_s: float = 60.0) -> pd.DataFrame:
    """Legs of straight sailing, turns and stops, reported at irregular times with noise and rare outliers."""
    r = np.random.default_rng([seed, 20231])
    t = np.cumsum(np.maximum(5.0, r.gamma(4.0, mean_step_s / 4, n)))
    e = nn = 0.0
    course, speed, omega, kind, left, rows, before = r.uniform(0, 2 * np.pi), r.uniform(3, 9), 0.0, "straight", 0.0, [], t[0]
    for k in range(n):
        step = t[k] - before
        while step > 1e-9:
            if left <= 0:
                kind = r.choice(["straight", "manoeuvre", "stopped"], p=[0.6, 0.3, 0.1])
                left = {"straight": r.uniform(900, 2400), "manoeuvre": r.uniform(120, 420), "stopped": r.uniform(600, 1800)}[kind]
                omega = r.choice([-1, 1]) * np.radians(r.uniform(0.1, 0.6)) if kind == "manoeuvre" else 0.0
            h = min(step, left, 1.0)
            v = 0.0 if kind == "stopped" else speed
            course += omega * h
            e, nn = e + v * np.sin(course) * h, nn + v * np.cos(course) * h
            step, left = step - h, left - h
        before, v = t[k], 0.0 if kind == "stopped" else speed
        bad = bool(r.random() < outlier_rate) and k > 5
        far = r.uniform(0, 2 * np.pi)
        z = np.array([e, nn]) + r.normal(0, noise_m, 2) + (outlier_m * np.array([np.sin(far), np.cos(far)]) if bad else 0)
        rows.append((seed, k, t[k], str(kind), e, nn, v * np.sin(course), v * np.cos(course), z[0], z[1], bad))
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SIM_SCHEMA.split(", ")])


def simulate(spark: SparkSession, seeds: range, partitions: int | None = None, **options) -> DataFrame:
    """One simulated track for each seed; a seed gives the same track wherever it runs."""

    def run(batches):
        for b in batches:
            for seed in b["id"]:
                yield simulate_track(int(seed), **options)

    return spark.range(seeds.start, seeds.stop, 1, partitions or min(len(seeds), 64)).mapInPandas(run, SIM_SCHEMA)


def follow(tracks: DataFrame, cv: CvParameters | None = None, imm: ImmParameters | None = None) -> DataFrame:
    """Filter errors at every fix: model, seed, k, segment, error_m, nees, outlier, accepted."""
    cv, imm = cv or CvParameters(), imm or ImmParameters(r_m=5.0)

    def run(v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("k")
        t, z, truth = v["t"].to_numpy(), v[["ze", "zn"]].to_numpy(), v[["te", "tn", "tve", "tvn"]].to_numpy()
        out = []
        for name, got in (("cv_kalman", run_cv(t, z, None, cv)), ("imm", run_imm(t, z, None, imm))):
            d = got.x[:, :4] - truth
            nees = np.array([x @ np.linalg.solve(p[:4, :4] + 1e-9 * np.eye(4), x) for x, p in zip(d, got.p)])
            out.append(pd.DataFrame({"model": name, "seed": v["seed"], "k": v["k"], "segment": v["segment"], "error_m": np.hypot(d[:, 0], d[:, 1]), "nees": nees, "outlier": v["outlier"], "accepted": got.accepted}))
        return pd.concat(out)

    return tracks.groupBy("seed").applyInPandas(run, "model string, seed long, k int, segment string, error_m double, nees double, outlier boolean, accepted boolean")


def study(errors: DataFrame, warm_up: int = 10) -> DataFrame:
    """For each model and segment: RMSE, median, 95th percentile; for the model: outlier precision and recall."""
    e = errors.where(F.col("k") >= warm_up)
    by = e.where("not outlier").groupBy("model", "segment").agg(F.sqrt(F.avg(F.col("error_m") ** 2)).alias("rmse_m"), F.median("error_m").alias("median_m"), F.percentile("error_m", F.lit(0.95)).alias("p95_m"), F.count("*").alias("n"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit, miss, false = n(F.col("outlier") & ~F.col("accepted")), n(F.col("outlier") & F.col("accepted")), n(~F.col("outlier") & ~F.col("accepted"))
    found = e.groupBy("model").agg(F.try_divide(hit, hit + false).alias("outlier_precision"), F.try_divide(hit, hit + miss).alias("outlier_recall"))
    return by.join(found, "model")


def nees_in_band(errors: DataFrame, runs: int, prob: float = 0.95) -> DataFrame:
    """Share of steps whose mean error over the runs lies in the band that a consistent filter stays in."""
    lo, hi = (chi2_quantile(q, 4 * runs) / runs for q in ((1 - prob) / 2, (1 + prob) / 2))
    per = errors.groupBy("model", "k").agg(F.avg("nees").alias("m"))
    return per.groupBy("model").agg(F.avg(F.col("m").between(lo, hi).cast("double")).alias("in_band"))
