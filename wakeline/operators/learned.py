"""Causal features of an anchor, and a learned correction of dead reckoning with a calibrated spread.

The model is linear: ridge regression of the residual against dead reckoning on the recent motion, one for each horizon,
fitted from sums that Spark aggregates over all training rows. Members are fitted on different halves of the voyages and
combined by moment matching. (A recurrent network needs a library that is not available here; the inputs, the
target and the Gaussian output are those that such a network would have.)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import enu, velocity
from wakeline.operators.sequence import micros

INPUTS = ("one", "ve", "vn", "pe1", "pn1", "pe2", "pn2", "te", "tn")
RIDGE = 1e-3


def features(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Per sample and horizon: velocity, the displacement over the last one and two fixes as velocity, and change of course.

    Only fixes up to the anchor are used.
    """
    w = Window.partitionBy("voyage_id").orderBy("t")
    p = points.select("voyage_id", F.col("t").alias("t0"), *(F.lag(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("lat", "lon")), *(F.lag(micros("t"), k).over(w).alias(f"us{k}") for k in (1, 2)))
    s = samples.join(p, ["voyage_id", "t0"], "left")
    ve, vn = velocity("sog_kn", "cog_deg")
    s = s.withColumns({"one": F.lit(1.0), "ve": ve, "vn": vn})
    for k in (1, 2):
        e, n = enu(f"lat{k}", f"lon{k}", "lat0", "lon0")
        dt = F.greatest((micros("t0") - F.col(f"us{k}")) / 1e6, F.lit(1.0))
        s = s.withColumns({f"pe{k}": F.coalesce(-e / dt, F.col("ve")), f"pn{k}": F.coalesce(-n / dt, F.col("vn"))})
    s = s.withColumns({"te": F.col("pe1") - F.col("pe2"), "tn": F.col("pn1") - F.col("pn2")})
    h = F.col("horizon_min") * 60
    s = s.withColumns({"dr_e": F.col("ve") * h, "dr_n": F.col("vn") * h})
    e, n = enu("lat_h", "lon_h", "lat0", "lon0")
    return s.withColumns({"ye": F.when(F.col("known"), (e - F.col("dr_e")) / h), "yn": F.when(F.col("known"), (n - F.col("dr_n")) / h)}).drop("lat1", "lon1", "lat2", "lon2", "us1", "us2")


def fit(rows: DataFrame, members: int = 2) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(member, horizon) -> (weights of shape inputs x 2, residual covariance 2 x 2)."""
    k = len(INPUTS)
    r = rows.where("known").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    r = r.where(F.pmod(F.xxhash64("voyage_id", "member"), F.lit(2)) == 0)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"x_{i}_{j}") for i, a in enumerate(INPUTS) for j, b in enumerate(INPUTS) if j >= i]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"y_{i}_{y}") for i, a in enumerate(INPUTS) for y in ("ye", "yn")]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"r_{a}_{b}") for a, b in (("ye", "ye"), ("yn", "yn"), ("ye", "yn"))]
    out = {}
    for g in r.groupBy("member", "horizon_min").agg(F.count("*").alias("n"), *sums).collect():  # a row for each member and horizon
        x = np.array([[g[f"x_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        y = np.array([[g[f"y_{i}_{t}"] for t in ("ye", "yn")] for i in range(k)])
        w = np.linalg.solve(x + RIDGE * max(1, g["n"]) * np.eye(k), y)
        yy = np.array([[g["r_ye_ye"], g["r_ye_yn"]], [g["r_ye_yn"], g["r_yn_yn"]]])
        out[g["member"], g["horizon_min"]] = (w, (yy - w.T @ y - y.T @ w + w.T @ x @ w) / max(1, g["n"]))
    return out


def forecast(rows: DataFrame, model: dict, name: str = "learned") -> DataFrame:
    """Moment-matched mean and covariance of the members' forecasts."""
    if not model:
        raise ValueError("no training rows")
    h = F.col("horizon_min") * 60
    parts = []
    for (member, horizon), (w, c) in sorted(model.items()):
        dot = lambda j, w=w: sum((F.col(a) * float(w[i, j]) for i, a in enumerate(INPUTS)), F.lit(0.0))
        at = rows.where(F.col("horizon_min") == horizon)
        parts.append(at.select("sample_id", "horizon_min", "lat0", "lon0", (F.col("dr_e") + dot(0) * h).alias("e"), (F.col("dr_n") + dot(1) * h).alias("n"), *((F.lit(float(c[i, j])) * h * h + (1.0 if i == j else 0.0)).alias(x) for x, i, j in (("a", 0, 0), ("b", 1, 1), ("c", 0, 1)))))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    m = both.groupBy("sample_id", "horizon_min", "lat0", "lon0").agg(F.avg("e").alias("me"), F.avg("n").alias("mn"), (F.avg("a") + F.var_pop("e")).alias("cee"), (F.avg("b") + F.var_pop("n")).alias("cnn"), (F.avg("c") + F.covar_pop("e", "n")).alias("cen"))
    return m.select(F.lit(name).alias("model"), "sample_id", "horizon_min", "lat0", "lon0", "me", "mn", "cee", "cnn", "cen")
