"""Forecast scores: errors, calibration, summaries with cluster-bootstrap intervals, paired differences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import enu, haversine_m, with_latlon
from wakeline.functions.stats import bootstrap_median, chi2_2, gaussian_scores


#: Models that learn nothing from the errors of forecasts.
BASELINES = ("dead_reckoning", "cv_kalman", "imm_switching", "imm_frozen", "knn")
#: The cumulative Poisson distribution with mean 1, as far as a hash of 32 bits can tell.
POISSON_1 = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def per_sample_scores(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Score forecasts (model, sample_id, horizon_min, lat0, lon0, me, mn, cee, cnn, cen) against truth (sample_id,
    voyage_id, vessel_group, horizon_min, lat_h, lon_h, known); rows without a true position are dropped."""
    j = forecasts.join(truth.where("known" if "known" in truth.columns else "lat_h is not null").drop("known"), ["sample_id", "horizon_min"])
    te, tn = enu("lat_h", "lon_h", "lat0", "lon0")
    j = with_latlon(j.withColumns({"_re": te - F.col("me"), "_rn": tn - F.col("mn")}), "me", "mn", "lat0", "lon0", ("_lat", "_lon"))
    j = j.withColumn("error_km", haversine_m("_lat", "_lon", "lat_h", "lon_h") / 1000)
    g = gaussian_scores(*(F.col(c) for c in ("_re", "_rn", "cee", "cnn", "cen")))
    return j.select("model", "sample_id", "voyage_id", "vessel_group", "horizon_min", "error_km", *(v.alias(k) for k, v in g.items()))


def cov_scales(scores: DataFrame, prob: float = 0.9) -> DataFrame:
    """model, horizon_min, scale: what the covariances have to be multiplied by for nominal coverage."""
    return scores.groupBy("model", "horizon_min").agg((F.percentile("d2", F.lit(prob)) / chi2_2(prob)).alias("scale"))


def with_cov_scale(forecasts: DataFrame, scales: DataFrame) -> DataFrame:
    j = forecasts.join(scales, ["model", "horizon_min"], "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return j.withColumns({c: F.col(c) * F.col("scale") for c in ("cee", "cnn", "cen")}).drop("scale")


def summarise_scores(scores: DataFrame, by: tuple[str, ...] = ("model", "horizon_min")) -> DataFrame:
    """The metrics of each group, all in one aggregation."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("voyage_id").alias("voyages"), F.avg("error_km").alias("mean_km"), F.median("error_km").alias("median_km"), F.percentile("error_km", F.lit(0.9)).alias("p90_km"),
        F.avg((F.col("d2") <= chi2_2(0.5)).cast("double")).alias("cov50"), F.avg((F.col("d2") <= chi2_2(0.9)).cast("double")).alias("cov90"), F.avg("nll").alias("nll"), F.median("area90_km2").alias("area90_km2"),
    )


def cluster_intervals(df: DataFrame, value: str, cluster: str, by: tuple[str, ...], n_boot: int = 1000, seed: int = 0, stat: str = "mean") -> DataFrame:
    """Percentile intervals of a mean (or median) when whole clusters are resampled.

    For a mean each cluster, reduced to its sum and count, gets a Poisson(1) weight in each of `n_boot` resamples, drawn by a
    hash of seed, resample and cluster; sums are added up where the data are. For a median the values themselves go to
    one task for each group of `by`.
    """
    per = df.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), *([F.collect_list(value).alias("_v")] if stat == "median" else [])).where("_n > 0")
    if stat == "mean":
        point = per.groupBy(*by).agg(F.count("*").alias("clusters"), (F.sum("_s") / F.sum("_n")).alias("point"))
        drawn = per.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(max(1, n_boot)))))
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_r").cast("string"), F.col(cluster).cast("string"))), 1, 8), 16, 10).cast("double") / float(16**8)
        drawn = drawn.withColumn("_w", sum((F.when(u >= c, 1).otherwise(0) for c in POISSON_1), F.lit(0)))
        means = drawn.groupBy(*by, "_r").agg((F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))).alias("_m"))
        ends = means.groupBy(*by).agg(*(F.percentile("_m", F.lit(q)).alias(c) for c, q in (("lo", 0.025), ("hi", 0.975))))
        known = (F.col("clusters") > 1) & F.lit(n_boot > 0)
        return point.join(ends, list(by)).select(*by, "clusters", "point", *(F.when(known, F.col(c)).alias(c) for c in ("lo", "hi")))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", clusters long, point double, lo double, hi double"

    def resample(key, part):
        import pandas as pd

        part = part.sort_values(cluster)
        out = bootstrap_median([np.sort(np.array(v)) for v in part["_v"]], n_boot, seed)
        return pd.DataFrame([[*key, len(part), *(None if math.isnan(x) else x for x in out)]], columns=[*by, "clusters", "point", "lo", "hi"])

    return per.groupBy(*by).applyInPandas(resample, schema)


def paired_differences(scores: DataFrame, a: str, b: str) -> DataFrame:
    """error_km of model a less that of model b on the samples and horizons that both have."""
    one = lambda m, c: scores.where(F.col("model") == m).select("sample_id", "voyage_id", "horizon_min", F.col("error_km").alias(c))
    return one(a, "_a").join(one(b, "_b").drop("voyage_id"), ["sample_id", "horizon_min"]).select("sample_id", "voyage_id", "horizon_min", (F.col("_a") - F.col("_b")).alias("diff_km"))


def verdict(scores: DataFrame, model: str, n_boot: int = 1000) -> DataFrame:
    """For each horizon the baseline with the least mean error on these scores, and how far `model` lies from it: the mean
    difference with its interval (clusters are voyages), and the share of the baseline's error."""
    per = scores.where(F.col("model").isin(*BASELINES)).groupBy("horizon_min", "model").agg(F.avg("error_km").alias("e"))
    best = per.groupBy("horizon_min").agg(F.min_by("model", F.struct("e", "model")).alias("best_baseline"), F.min("e").alias("baseline_km"))
    own = scores.where(F.col("model") == model).select("sample_id", "voyage_id", "horizon_min", F.col("error_km").alias("_a"))
    base = scores.join(F.broadcast(best), "horizon_min").where(F.col("model") == F.col("best_baseline")).select("sample_id", "horizon_min", F.col("error_km").alias("_b"))
    d = own.join(base, ["sample_id", "horizon_min"]).withColumn("diff_km", F.col("_a") - F.col("_b"))
    return best.join(cluster_intervals(d, "diff_km", "voyage_id", ("horizon_min",), n_boot), "horizon_min").withColumn("share", F.col("point") / F.col("baseline_km"))


def best_model(scores: DataFrame) -> DataFrame:
    """The model with the least mean error over the horizons."""
    per = scores.groupBy("model", "horizon_min").agg(F.avg("error_km").alias("e"))
    return per.groupBy("model").agg(F.avg("e").alias("mean_km")).orderBy("mean_km", "model").limit(1)


def pick_setting(rows: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """`rows` (a candidate each: precision, recall, base_per_1000_h, settings, own) with `eligible` and `chosen`.

    Eligible are settings precise enough that alarm no more often than the present ones (`own`). The one with the highest
    recall is chosen, then the lowest base rate; the present ones where none is eligible.
    """
    now = F.broadcast(rows.where("own").agg(F.min("base_per_1000_h").alias("_now")))
    marked = rows.join(now).withColumn("eligible", F.coalesce((F.col("precision") >= least_precision) & (F.col("base_per_1000_h") <= F.col("_now") + 1e-9), F.lit(False))).drop("_now")
    order = F.struct((~F.col("eligible")).alias("a"), F.when(F.col("eligible"), -F.col("recall")).alias("b"), F.when(F.col("eligible"), F.col("base_per_1000_h")).alias("c"), (~F.col("own")).alias("d"), F.col("settings").alias("e"))
    best = F.broadcast(marked.agg(F.min(order).alias("_best")))
    return marked.join(best).withColumn("chosen", order == F.col("_best")).drop("_best")


def nis_consistency(tracks: DataFrame, nis: str = "nis", accepted: str = "accepted") -> DataFrame:
    """Mean, median and tail share of the normalised innovation squared, and the share of rejected fixes."""
    return tracks.where(F.col(nis).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(nis).alias("mean_nis"), F.median(nis).alias("median_nis"), F.avg((F.col(nis) > chi2_2(0.95)).cast("double")).alias("above_95"), (1 - F.avg(F.col(accepted).cast("double"))).alias("rejected"),
    ).withColumn("consistent", F.col("above_95").between(0.02, 0.10))


def precision_recall(rows: DataFrame, by: tuple[str, ...] = ("type",)) -> DataFrame:
    """Of injections (detected, new_events, matched_events): recall over injections, precision over new events."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("detected").cast("double")).alias("recall"), F.sum("matched_events").alias("matched"), F.sum("new_events").alias("new"),
        F.try_divide(F.sum("matched_events"), F.sum("new_events")).alias("precision"),
    )
