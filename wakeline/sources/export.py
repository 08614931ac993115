"""Results as Parquet, JSON and a short text report."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.detectors import with_event_ids
from wakeline.operators.segment import group_summary, split_summary


def write_points(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def json_rows(df: DataFrame, digits: int = 5) -> DataFrame:
    """One compact JSON text for each row; NaN and infinities become null."""
    clean = [F.when(F.isnan(c) | F.col(c).isin(math.inf, -math.inf), None).otherwise(F.round(c, digits)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))


def voyage_payload(tracks: DataFrame, voyages: DataFrame, digits: int = 5) -> DataFrame:
    """One JSON text for each voyage: its attributes and its smoothed path in time order."""
    path = tracks.groupBy("voyage_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds("t").alias("t"), F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon"), F.round("sog_kn", 2).alias("sog")))).alias("path"))
    return voyages.join(path, "voyage_id").select("voyage_id", F.to_json(F.struct("voyage_id", "mmsi", "vessel_group", F.unix_seconds("t_start").alias("t_start"), F.unix_seconds("t_end").alias("t_end"), "path")).alias("json"))


def anomaly_payload(events: DataFrame) -> DataFrame:
    e = with_event_ids(events).withColumns({"t_start": F.unix_seconds("t_start"), "t_end": F.unix_seconds("t_end")})
    return json_rows(e)


def write_text(path: str, text: str) -> None:
    Path(path).write_text(text.rstrip("\n") + "\n", encoding="utf-8", newline="\n")


def write_json(path: str, value) -> None:
    tidy = lambda v: {k: tidy(x) for k, x in v.items()} if isinstance(v, dict) else [tidy(x) for x in v] if isinstance(v, (list, tuple)) else None if isinstance(v, float) and not math.isfinite(v) else v
    write_text(path, json.dumps(tidy(value), separators=(",", ":")))


def summary_markdown(voyages: DataFrame) -> str:
    """A report of voyages by split and by vessel group; both frames have a handful of rows."""
    lines = ["| split | voyages | vessels | points | km |", "|---|---:|---:|---:|---:|"]
    lines += [f"| {r.split} | {r.voyages} | {r.vessels} | {r.points} | {r.path_km:.0f} |" for r in split_summary(voyages).orderBy("split").collect()]
    lines += ["", "| group | voyages | vessels | points |", "|---|---:|---:|---:|"]
    lines += [f"| {r.vessel_group} | {r.voyages} | {r.vessels} | {r.points} |" for r in group_summary(voyages).orderBy(F.desc("points")).collect()]
    return "\n".join(lines)
