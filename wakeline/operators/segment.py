"""Voyages: silences over a limit separate them; one row of summary for each, with a leakage-safe split label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import Config, Segment
from wakeline.operators.clean import vessel_group
from wakeline.operators.sequence import by_time, islands, micros


def assign_voyages(df: DataFrame, segment: Segment | None = None) -> DataFrame:
    """Add voyage_id, `mmsi-yyyyMMdd'T'HHmm` of the first fix; a silence strictly over the limit starts a voyage."""
    limit = (segment or Segment()).max_gap_min * 60
    whole = F.floor(micros("t") / 1_000_000)
    df = df.withColumn("_gap", whole - F.lag(whole).over(by_time()) > limit)
    df = islands(df, F.coalesce("_gap", F.lit(False)), name="_seg")
    start = F.min("t").over(Window.partitionBy("mmsi", "_seg"))
    return df.withColumn("voyage_id", F.concat_ws("-", F.col("mmsi").cast("string"), F.date_format(start, "yyyyMMdd'T'HHmm"))).drop("_gap", "_seg")


def split_label(splits: tuple[tuple[str, str, str], ...], start: str = "t_start", end: str = "t_end") -> Column:
    """The split that holds the whole span; later ones win; 'none' elsewhere."""
    label = F.lit("none")
    for name, lo, hi in splits:
        inside = (F.col(start) >= F.lit(f"{lo} 00:00:00").cast("timestamp")) & (F.col(end) < F.date_add(F.lit(hi).cast("date"), 1).cast("timestamp"))
        label = F.when(inside, name).otherwise(label)
    return label


def summarise_voyages(df: DataFrame, config: Config | None = None) -> DataFrame:
    """One row for each voyage. path_km sums the step before each fix, so it holds the silence before the first one."""
    config = config or Config()
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    v = df.groupBy("voyage_id").agg(
        F.first("mmsi").alias("mmsi"), F.mode(have("vessel_name", "string"), True).alias("vessel_name"), F.mode(have("vessel_type", "int"), True).alias("vessel_type"),
        F.median(have("length_m", "double")).alias("length_m"), F.mode(have("transceiver", "string"), True).alias("transceiver"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.count("*").alias("n_points"), F.avg(F.when(F.col("sog_kn") > 1.0, 1.0).when(F.col("sog_kn").isNotNull(), 0.0)).alias("moving_frac"),
        (F.sum(F.coalesce("dist_prev_m", F.lit(0.0))) / 1000).alias("path_km"), F.sum(F.col("spike").cast("long")).alias("n_spikes"),
    )
    v = v.withColumn("duration_min", F.floor((micros("t_end") - micros("t_start")) / 1_000_000) / 60).withColumn("vessel_group", vessel_group())
    usable = (F.col("n_points") >= config.segment.min_points) & (F.col("duration_min") >= config.segment.min_duration_min)
    v = v.withColumn("split", split_label(config.splits)).withColumn("usable", usable)
    return v.select("voyage_id", "mmsi", "vessel_name", "vessel_type", "vessel_group", "length_m", "transceiver", "t_start", "t_end", "duration_min", "n_points", "moving_frac", "path_km", "n_spikes", "split", "usable")


def enrich(points: DataFrame, voyages: DataFrame) -> DataFrame:
    """Points with the split, usability and group of their voyage."""
    return points.drop("split", "usable", "vessel_group").join(voyages.select("voyage_id", "split", "usable", "vessel_group"), "voyage_id", "left")


def split_summary(voyages: DataFrame) -> DataFrame:
    return voyages.where("usable").groupBy("split").agg(F.count("*").alias("voyages"), F.countDistinct("mmsi").alias("vessels"), F.sum("n_points").alias("points"), F.sum("path_km").alias("path_km"))


def group_summary(voyages: DataFrame) -> DataFrame:
    return voyages.where("usable").groupBy("vessel_group").agg(F.count("*").alias("voyages"), F.countDistinct("mmsi").alias("vessels"), F.sum("n_points").alias("points"))


def unseen_vessels(voyages: DataFrame, seen: str = "train", asked: str = "test") -> DataFrame:
    """Vessels of one split that the other has not."""
    return voyages.where(F.col("split") == asked).select("mmsi").distinct().join(voyages.where(F.col("split") == seen), "mmsi", "left_anti")
