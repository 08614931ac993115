"""The cleaning policy for position reports, step kinematics and spikes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.config import MMSI_RANGE, Clean, Region
from wakeline.functions.geo import KNOT_MS, haversine_m
from wakeline.operators.sequence import KEY, by_time, micros


def in_region(region: Region) -> Column:
    return F.col("lat").between(region.lat_min, region.lat_max) & F.col("lon").between(region.lon_min, region.lon_max)


# The type codes of each vessel group, as (first, last); 0 and a missing code are unknown, all others other.
GROUP_CODES = {
    "unknown": [(0, 0)],
    "cargo": [(70, 79), (1003, 1004), (1016, 1016)],
    "tanker": [(80, 89), (1017, 1017), (1023, 1024)],
    "passenger": [(60, 69), (1012, 1015)],
    "tug_tow": [(21, 22), (31, 32), (52, 52), (1025, 1025)],
    "fishing": [(30, 30), (1001, 1002)],
    "pleasure": [(36, 37), (1019, 1019)],
}


def vessel_group(code: str = "vessel_type") -> Column:
    """Vessel group of a type code."""
    c = F.coalesce(F.col(code), F.lit(0))
    hits = [F.when(reduce(lambda a, b: a | b, (c.between(lo, hi) for lo, hi in spans)), name) for name, spans in GROUP_CODES.items()]
    return F.coalesce(*hits, F.lit("other"))


def add_kinematics(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Distance (m), time (s) and implied speed (kn) of the step before and after each fix."""
    w = by_time(key)
    for name, move in (("prev", F.lag), ("next", F.lead)):
        lat, lon, t = (move(c).over(w) for c in ("lat", "lon", "t"))
        dist = haversine_m(lat, lon, "lat", "lon")
        dt = F.abs(micros("t") - micros(t)) / 1e6
        df = df.withColumns({f"dist_{name}_m": dist, f"dt_{name}_s": dt, f"v_{name}_kn": dist / F.greatest(dt, F.lit(1.0)) / KNOT_MS})
    return df


def spike(limit_kn: float) -> Column:
    return F.coalesce((F.col("v_prev_kn") > limit_kn) & (F.col("v_next_kn") > limit_kn), F.lit(False))


def _verdict() -> tuple[Column, Column, Column]:
    keyed = F.col("mmsi").isNotNull() & F.col("t").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    station = F.col("mmsi").between(*MMSI_RANGE)
    formed = F.col("transceiver").isNull() | F.col("transceiver").isin("A", "B")
    return keyed, station, formed


def clean_points(df: DataFrame, clean: Clean | None = None, arrival: Sequence[str] = ("_file", "_row"), kinematics: bool = True) -> DataFrame:
    """Null keys, MMSI range, malformed rows, duplicates (first in arrival order stays), not-available codes, kinematics, spikes.

    Duplicates are found by the time of the row before, so that the exchange and the sort by vessel and time serve
    de-duplication, kinematics and the voyages that follow.
    """
    clean = clean or Clean()
    keyed, station, formed = _verdict()
    again = F.lag("t").over(by_time(order=("t", *arrival))) == F.col("t")
    df = df.where(keyed & station & formed).withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again").drop("_again")
    df = df.withColumn("sog_kn", F.when(F.col("sog_kn") <= clean.max_sog_kn, F.col("sog_kn")))
    for c in ("cog_deg", "heading_deg"):
        if c in df.columns:
            df = df.withColumn(c, F.when(F.col(c) < 360, F.col(c)))
    return add_kinematics(df).withColumn("spike", spike(clean.max_implied_kn)) if kinematics else df


def clean_report(df: DataFrame) -> DataFrame:
    """One row with the rows that each cleaning step drops, in one pass."""
    keyed, station, formed = _verdict()
    good = keyed & station & formed
    copies = df.where(good).groupBy("mmsi", "t").count().agg(F.sum("count").alias("kept"), F.count("*").alias("unique"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    steps = df.agg(F.count("*").alias("rows_in"), n(~keyed).alias("null_keys"), n(keyed & ~station).alias("invalid_mmsi"), n(keyed & station & ~formed).alias("malformed"))
    both = steps.join(copies, F.lit(True))
    return both.select("rows_in", "null_keys", "invalid_mmsi", "malformed", (F.coalesce("kept", F.lit(0)) - F.col("unique")).alias("duplicates"), F.col("unique").alias("rows_out"))


def complete_days(df: DataFrame, least_share: float = 0.6) -> DataFrame:
    """UTC days with at least this share of the median number of reports."""
    days = df.groupBy(F.to_date("t").alias("day")).count()
    return days.join(F.broadcast(days.agg(F.median("count").alias("m"))), F.col("count") >= least_share * F.col("m")).select("day", F.col("count").alias("n"))
