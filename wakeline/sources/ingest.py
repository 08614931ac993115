"""Raw day files to canonical reports: header names, archives, tolerant parsing, region filter, manifest of days."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.config import Region
from wakeline.operators.clean import in_region

CANONICAL = "mmsi long, t timestamp, lat double, lon double, sog_kn float, cog_deg float, heading_deg float, vessel_name string, imo string, call_sign string, vessel_type int, status int, length_m float, width_m float, draft_m float, cargo int, transceiver string"
# What day files call each column, in whatever case.
HEADER_NAMES = {
    "mmsi": ("mmsi",),
    "t": ("basedatetime", "base_date_time"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "sog_kn": ("sog",),
    "cog_deg": ("cog",),
    "heading_deg": ("heading",),
    "vessel_name": ("vesselname", "vessel_name"),
    "imo": ("imo",),
    "call_sign": ("callsign", "call_sign"),
    "vessel_type": ("vesseltype", "vessel_type"),
    "status": ("status",),
    "length_m": ("length",),
    "width_m": ("width",),
    "draft_m": ("draft",),
    "cargo": ("cargo",),
    "transceiver": ("transceiverclass", "transceiver"),
}


def header_columns(header: Sequence[str]) -> dict[str, str]:
    """Canonical names to the header's own; a header without one of them is an error that says which."""
    own = {name.strip().lower(): name for name in header}
    found = {canonical: own[alias] for canonical, aliases in HEADER_NAMES.items() for alias in (*aliases, canonical) if alias in own}
    lacking = sorted(HEADER_NAMES.keys() - found.keys())
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking)} in the header {list(header)}")
    return found


def read_day_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-string scan. Quotes are ordinary characters; a ragged row shifts and later fails the key checks."""
    return spark.read.option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def to_canonical(df: DataFrame) -> DataFrame:
    names = header_columns(df.columns)
    text = lambda c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit(""))

    def parsed(c: str, kind: str) -> Column:
        if kind == "timestamp":
            return F.try_to_timestamp(F.replace(text(c), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
        if kind in ("long", "int"):  # "57.0" is 57
            return text(c).try_cast("double").try_cast(kind)
        return text(c) if kind == "string" else text(c).try_cast(kind)

    return df.select(*(parsed(c, k).alias(c) for c, k in (x.split(" ") for x in CANONICAL.split(", "))))


def region_reports(df: DataFrame, region: Region | None = None) -> DataFrame:
    return to_canonical(df).where(in_region(region or Region()))


def _lines(name: str, content: bytes) -> Iterator[str]:
    """Lines of a day file, as it is, in a zip archive with one CSV file, or compressed with zstandard; only \n ends one."""
    raw: io.BufferedIOBase = io.BytesIO(content)
    if name.lower().endswith(".zip"):
        archive = zipfile.ZipFile(raw)
        inside = [i for i in archive.infolist() if not i.is_dir() and i.filename.lower().rpartition(".")[2] == "csv"]
        if len(inside) != 1:
            raise ValueError(f"{name}: one CSV file expected, {len(inside)} found")
        raw = archive.open(inside[0])
    elif name.lower().endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw)
    for line in io.TextIOWrapper(raw, "utf-8", "replace", newline="\n"):
        yield line.rstrip("\r\n")


def read_archives(spark: SparkSession, path: str, rows: int = 50_000) -> DataFrame:
    """Reports of day files (.csv, .zip, .zst) as strings under their canonical names, for `to_canonical`.

    A file is one task, as its compression allows no other; its lines stream through. Quotes are ordinary characters.
    """
    fields = list(HEADER_NAMES)

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                reader = csv.reader(_lines(name, content), quoting=csv.QUOTE_NONE)
                header = next(reader, None)
                if header is None:
                    continue
                own = header_columns(header)
                at, held = [header.index(own[c]) for c in fields], []
                for row in reader:
                    held.append([row[k] if k < len(row) else None for k in at])
                    if len(held) == rows:
                        yield pd.DataFrame(held, columns=fields)
                        held = []
                yield pd.DataFrame(held, columns=fields)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(f"{c} string" for c in fields))


def configured_days(start: date, end: date, extra: Sequence[tuple[date, date]] = ()) -> list[date]:
    days = {a + timedelta(i) for a, b in ((start, end), *extra) for i in range((b - a).days + 1)}
    return sorted(days)


MANIFEST = "day date, rows_read long, rows_kept long, error string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each day; an empty table where nothing was ingested yet."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(path).withColumn("_at", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name")))
    except Exception as e:  # Spark has no cheaper test that works on every file system
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return entries.groupBy("day").agg(F.max_by(F.struct("rows_read", "rows_kept", "error"), "_at").alias("e")).select("day", "e.*")


def pending_days(spark: SparkSession, days: Sequence[date], manifest: DataFrame) -> DataFrame:
    """Configured days that the manifest does not have as done; a day with an error is tried again."""
    done = manifest.where(F.col("error").isNull()) if "error" in manifest.columns else manifest
    return spark.createDataFrame([(d,) for d in days], "day date").join(done.select("day"), "day", "left_anti")


def ingest_day(spark: SparkSession, path: str, day: date, out: str, region: Region | None = None) -> tuple[date, int, int]:
    """Write one day's reports of the region; (day, rows read, rows kept), counted in the same pass."""
    read, kept = Observation(), Observation()
    raw = read_archives(spark, path) if path.lower().endswith((".zip", ".zst")) else read_day_csv(spark, path)
    df = to_canonical(raw).observe(read, F.count("*").alias("n")).where(in_region(region or Region())).observe(kept, F.count("*").alias("n"))
    df.withColumn("date", F.lit(day)).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(out)
    return day, read.get["n"], kept.get["n"]


def ingest_pending(spark: SparkSession, days: Sequence[date], path_of: Callable[[date], str], out: str, manifest: str, region: Region | None = None) -> DataFrame:
    """Ingest the days that the manifest lacks, one after the other, and return the manifest.

    Each day is entered as soon as it is done, so a run that breaks off goes on where it stopped. A day that fails is
    entered with its error, the others go on, and the next run tries it again.
    """
    for row in pending_days(spark, days, read_manifest(spark, manifest)).orderBy("day").collect():  # a few hundred a year
        try:
            entry = (*ingest_day(spark, path_of(row["day"]), row["day"], out, region), None)
        except Exception as e:
            entry = (row["day"], None, None, f"{type(e).__name__}: {e}"[:500])
        spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").parquet(manifest)
    return read_manifest(spark, manifest)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All ingested days, with the arrival order of each row (_file, _row)."""
    schema = T.StructType.fromDDL(CANONICAL)
    return spark.read.schema(schema.add("date", "date")).parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
