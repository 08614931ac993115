"""The same operators over streams: incremental ingest, voyages by session windows, causal filtering with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.functions.geo import KNOT_MS, np_enu, np_latlon
from wakeline.operators.clean import in_region
from wakeline.operators.tracking import CvParameters, cv_step


def ingest_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, region=None) -> StreamingQuery:
    """All files that are new since the last run, once; the checkpoint is the manifest."""
    s = spark.readStream.schema(schema).parquet(path)
    if region is not None:
        s = s.where(in_region(region))
    return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark("t", delay).dropDuplicatesWithinWatermark(["mmsi", "t"])


def voyage_stream(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """mmsi, t_start, t_end, n_points of each voyage, as it closes."""
    s = stream.withWatermark("t", delay).groupBy("mmsi", F.session_window("t", gap))
    return s.agg(F.count("*").alias("n_points"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.avg("sog_kn").alias("mean_sog_kn")).drop("session_window")


def position_bins(stream: DataFrame, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    s = stream.withWatermark("t", delay).groupBy("mmsi", F.window("t", width))
    return s.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n")).select("mmsi", F.col("window.start").alias("bin"), "lat", "lon", "n")


FILTER_SCHEMA = "mmsi long, t timestamp, f_lat double, f_lon double, f_ve double, f_vn double, nis double"
STATE_SCHEMA = "t double, lat0 double, lon0 double, x array<double>, p array<double>"


def filter_stream(stream: DataFrame, prm: CvParameters | None = None, silence_s: float = 1800.0, late: str = "10 minutes", keep_s: float = 86400.0) -> DataFrame:
    """Constant-velocity states of each vessel as reports arrive; a long silence starts anew. Reports older than a
    vessel's last are skipped, and those beyond the watermark `late` are dropped.

    The state of a vessel is dropped when the watermark is `keep_s` past its last report.
    """
    prm = prm or CvParameters()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        last, lat0, lon0 = (old[0], old[1], old[2]) if old else (None, 0.0, 0.0)
        x, p = (np.array(old[3]), np.array(old[4]).reshape(4, 4)) if old else (None, None)
        h, r = np.eye(2, 4), prm.r_m**2 * np.eye(2)
        rows = []
        for v in pd.concat(list(batches)).sort_values("t").itertuples():
            t = v.t.timestamp()
            if last is not None and t <= last:
                continue
            nis = None
            if last is None or t - last > silence_s:
                lat0, lon0 = v.lat, v.lon
                known = pd.notna(v.sog_kn) and pd.notna(v.cog_deg)
                s, c = (v.sog_kn * KNOT_MS, np.radians(v.cog_deg)) if known else (0.0, 0.0)
                x, p = np.array([0, 0, s * np.sin(c), s * np.cos(c)]), np.diag([prm.r_m**2] * 2 + [0.25 if known else 25.0] * 2)
            else:
                f, q = cv_step(t - last, prm.q)
                x, p = f @ x, f @ p @ f.T + q
                z = np.array(np_enu(v.lat, v.lon, lat0, lon0)) - h @ x
                s = h @ p @ h.T + r
                g = np.linalg.solve(s, h @ p).T
                nis = float(z @ np.linalg.solve(s, z))
                x, p = x + g @ z, (np.eye(4) - g @ h) @ p @ (np.eye(4) - g @ h).T + g @ r @ g.T
            last = t
            lat, lon = np_latlon(x[0], x[1], lat0, lon0)
            rows.append((key[0], v.t, float(lat), float(lon), x[2], x[3], nis))
        if last is not None:
            state.update((last, lat0, lon0, x.tolist(), p.ravel().tolist()))
            state.setTimeoutTimestamp(int((last + keep_s) * 1000))
        yield pd.DataFrame(rows, columns=["mmsi", "t", "f_lat", "f_lon", "f_ve", "f_vn", "nis"])

    return stream.withWatermark("t", late).groupBy("mmsi").applyInPandasWithState(run, FILTER_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
