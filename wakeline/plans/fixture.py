"""Position reports derived from the `events` table, so that every operator has something to find in it.

The view is one SQL text for Spark and for the SQL that checks it; {US} is the time in microseconds. Thresholds are scaled to its
spacing of about half a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.config import Config
from wakeline.operators.clean import clean_points, vessel_group
from wakeline.operators.context import Learned, learn
from wakeline.operators.segment import assign_voyages, summarise_voyages

CONFIG = Config.load(
    {
        "clean": {"max_implied_kn": 0.4},
        "segment": {"max_gap_min": 720.0, "min_points": 3, "min_duration_min": 30.0},
        "context": {"reception_cell_m": 4000.0, "port_cell_m": 2000.0, "traffic_cell_m": 2000.0, "max_step_s": 86400.0, "report_s": 3600.0, "still_kn": 4.0, "max_still_h": 24.0, "port_min_hours": 48.0, "port_min_vessels": 3, "home_min_hours": 90.0, "course_min_fixes": 5},
        "gap": {"min_gap_min": 720.0, "min_sog_kn": 1.0, "min_reception": 0.02, "max_gap_h": 48.0},
        "jump": {"abs_kn": 5.0, "sog_factor": 0.2, "sog_margin_kn": 1.0, "merge_s": 86400.0},
        "loiter": {"min_hours": 12.0, "max_port_frac": 0.6, "max_gap_min": 1440.0},
        "deviation": {"min_sog_kn": 2.0, "max_cell_voyages": 2, "min_course_prob": 0.05, "min_cell_voyages_for_course": 4, "min_minutes": 300.0, "max_gap_min": 1440.0, "bridge_min": 720.0, "skip_groups": ("fishing",)},
        "rendezvous": {"max_dist_m": 2000.0, "min_hours": 6.0, "bin_min": 360.0},
        "prediction": {"horizons_min": (180, 360, 720), "history_min": 720.0, "anchor_every_min": 480.0, "bracket_s": 43200.0},
        "splits": (("train", "2024-01-01", "2024-01-18"), ("val", "2024-01-19", "2024-01-23"), ("test", "2024-01-24", "2024-01-31")),
    }
)
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

FIXES = """
select event_id, 316000000 + user_id as mmsi, {US} as us,
  41.4e0 + 1.7e0 * (0.2e0 + 0.6e0 * ((cast(floor(user_id / 2e0) as bigint) * 37) % 101) / 101e0) + 0.02e0 * sin({US} / 3.6e9 / 40e0 + cast(floor(user_id / 2e0) as bigint))
    + (case when event_id % 29 = 0 then 0.1e0 else 0e0 end) as lat,
  -83.6e0 + 1.3e0 * (0.2e0 + 0.6e0 * ((cast(floor(user_id / 2e0) as bigint) * 53) % 103) / 103e0) + 0.02e0 * cos({US} / 3.6e9 / 40e0 + cast(floor(user_id / 2e0) as bigint)) as lon,
  case when event_type in ('view', 'click', 'error') then value / 40e0 else value / 5e0 end as sog_kn,
  cast((event_id * 37) % 360 as double) as cog_deg, cast((event_id * 53) % 400 as double) as heading_deg,
  cast(case when event_type = 'signup' then 30 else 60 + ((316000000 + user_id) % 30) end as int) as vessel_type,
  case when event_id % 97 = 0 then '52' when event_id % 5 = 0 then null when event_id % 3 = 0 then 'B' else 'A' end as transceiver,
  cast(case when user_id % 7 = 0 then null else 40e0 + user_id % 160 end as double) as length_m
from {EVENTS}
"""

#: Faults on top: not-available codes, bad MMSIs, null keys, and duplicates that arrive later.
RAW = """
select event_id as _row, case when event_id % 89 = 0 then 1234567 else mmsi end as mmsi, us, case when event_id % 101 = 0 then null else lat end as lat, lon,
  case when event_id % 41 = 0 then 102.3e0 else sog_kn end as sog_kn, case when event_id % 43 = 0 then 360e0 else cog_deg end as cog_deg, heading_deg, vessel_type, transceiver, length_m
from fixes
union all
select event_id + 1000000000 as _row, mmsi, us, lat, lon, sog_kn + 1e0, cog_deg, heading_deg, vessel_type, transceiver, length_m from fixes where event_id % 17 = 0
"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    return spark.sql(FIXES.replace("{US}", MICROS).replace("{EVENTS}", "{events}"), events=events).withColumn("t", F.timestamp_micros("us"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW.replace("from fixes", "from {fixes}"), fixes=fixes(spark, sf_dir)).withColumn("t", F.timestamp_micros("us"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_points(raw(spark, sf_dir), CONFIG.clean, ("_row",))


def voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise_voyages(assign_voyages(cleaned(spark, sf_dir), CONFIG.segment), CONFIG)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned fixes with their voyage, and the vessel group of the report."""
    return assign_voyages(cleaned(spark, sf_dir), CONFIG.segment).withColumn("vessel_group", vessel_group())


def context(spark: SparkSession, sf_dir: str) -> Learned:
    return learn(points(spark, sf_dir), CONFIG.context, CONFIG.region)
