"""What normal looks like, learned on grids: reception, ports, traffic, courses, and each vessel's own berths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.config import Context, Region
from wakeline.functions.geo import cell, course_bin, neighbours
from wakeline.operators.sequence import by_time, micros


def reception_grid(points: DataFrame, c: Context, origin: tuple[float, float]) -> DataFrame:
    """cell, received, missed, rate: expected against received reports between the fixes of moving vessels."""
    w = by_time()
    p = points.select("lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), "sog_kn", F.lead("sog_kn").over(w).alias("sog2"), ((F.lead(micros("t")).over(w) - micros("t")) / 1e6).alias("dt"))
    p = p.where((F.col("dt") <= c.max_step_s) & (F.col("sog_kn") >= c.moving_kn) & (F.col("sog2") >= c.moving_kn))
    p = p.select(cell((F.col("lat") + F.col("lat2")) / 2, (F.col("lon") + F.col("lon2")) / 2, c.reception_cell_m, origin).alias("cell"), F.greatest(F.bround(F.col("dt") / c.report_s, 0) - 1, F.lit(0.0)).alias("missed"))
    return p.groupBy("cell").agg(F.count("*").alias("received"), F.sum("missed").cast("long").alias("missed")).withColumn("rate", F.col("received") / (F.col("received") + F.col("missed")))


def _still(points: DataFrame, c: Context, origin: tuple[float, float]) -> DataFrame:
    dt = (F.lead(micros("t")).over(by_time()) - micros("t")) / 3.6e9
    p = points.withColumn("hours", dt).where((F.coalesce("sog_kn", F.lit(0.0)) < c.still_kn) & (F.col("hours") <= c.max_still_h))
    return p.select("mmsi", cell("lat", "lon", c.port_cell_m, origin).alias("cell"), "hours")


def port_cells(points: DataFrame, c: Context, origin: tuple[float, float]) -> DataFrame:
    """Cells in which several vessels lay for hours, and those around them."""
    core = _still(points, c, origin).groupBy("cell").agg(F.sum("hours").alias("hours"), F.countDistinct("mmsi").alias("vessels")).where((F.col("hours") >= c.port_min_hours) & (F.col("vessels") >= c.port_min_vessels))
    return core.select(F.explode(neighbours(F.col("cell"))).alias("cell")).distinct()


def vessel_homes(points: DataFrame, c: Context, origin: tuple[float, float]) -> DataFrame:
    """(mmsi, cell) in which a vessel itself lay for hours, and the cells around."""
    own = _still(points, c, origin).groupBy("mmsi", "cell").agg(F.sum("hours").alias("hours")).where(F.col("hours") >= c.home_min_hours)
    return own.select("mmsi", F.explode(neighbours(F.col("cell"))).alias("cell")).distinct()


def _moving(points: DataFrame, c: Context, origin: tuple[float, float], groups: tuple[str, ...] | None) -> DataFrame:
    p = points.where(F.col("sog_kn") >= c.moving_kn)
    if groups:
        p = p.where(F.col("vessel_group").isin(*groups))
    return p.withColumn("cell", cell("lat", "lon", c.traffic_cell_m, origin))


def traffic_grid(points: DataFrame, c: Context, origin: tuple[float, float], groups: tuple[str, ...] | None = None) -> DataFrame:
    return _moving(points, c, origin, groups).groupBy("cell").agg(F.countDistinct("voyage_id").alias("voyages"))


def course_histogram(points: DataFrame, c: Context, origin: tuple[float, float], groups: tuple[str, ...] | None = None) -> DataFrame:
    """cell, bin, prob: share of each course bin with 0.5 added to every bin, for cells with enough fixes."""
    n = _moving(points, c, origin, groups).where("cog_deg is not null").groupBy("cell", course_bin("cog_deg", c.bins).alias("bin")).count()
    total = n.groupBy("cell").agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("by")).where(F.col("total") >= c.course_min_fixes)  # at most `bins` entries
    every = total.select("cell", "total", "by", F.explode(F.sequence(F.lit(0), F.lit(c.bins - 1))).alias("bin"))
    return every.select("cell", "bin", ((F.coalesce(F.try_element_at("by", F.col("bin")), F.lit(0)) + 0.5) / (F.col("total") + 0.5 * c.bins)).alias("prob"))


@dataclass
class Learned:
    reception: DataFrame
    ports: DataFrame
    traffic: DataFrame
    courses: DataFrame
    homes: DataFrame
    parameters: Context
    origin: tuple[float, float]

    def persist(self) -> Learned:
        for df in (self.reception, self.ports, self.traffic, self.courses, self.homes):
            df.persist()
        return self


def learn(points: DataFrame, c: Context | None = None, region: Region | None = None, groups: tuple[str, ...] | None = None) -> Learned:
    """All grids from training points (with voyage_id and vessel_group)."""
    c, origin = c or Context(), (region or Region()).origin
    return Learned(reception_grid(points, c, origin), port_cells(points, c, origin), traffic_grid(points, c, origin, groups), course_histogram(points, c, origin, groups), vessel_homes(points, c, origin), c, origin)


# Lookups. The grids carry no hint: their size is known when they have been computed, and adaptive execution
# broadcasts those that turn out small.


def with_reception(df: DataFrame, ctx: Learned, lat: str, lon: str, name: str) -> DataFrame:
    g = ctx.reception.select(F.col("cell").alias("_c"), F.col("rate").alias(name))
    return df.join(g, cell(lat, lon, ctx.parameters.reception_cell_m, ctx.origin) == F.col("_c"), "left").drop("_c")


def with_berth(df: DataFrame, ctx: Learned, lat: str, lon: str, port: str, home: str | None = None) -> DataFrame:
    """Flags: the position is in a port cell; in a home cell of the vessel."""
    df = df.withColumn("_at", cell(lat, lon, ctx.parameters.port_cell_m, ctx.origin))
    df = df.join(ctx.ports.select(F.col("cell").alias("_c"), F.lit(True).alias("_p")), F.col("_at") == F.col("_c"), "left").withColumn(port, F.coalesce("_p", F.lit(False))).drop("_c", "_p")
    if home:
        h = ctx.homes.select(F.col("mmsi").alias("_m"), F.col("cell").alias("_c"), F.lit(True).alias("_h"))
        df = df.join(h, (F.col("mmsi") == F.col("_m")) & (F.col("_at") == F.col("_c")), "left").withColumn(home, F.coalesce("_h", F.lit(False))).drop("_m", "_c", "_h")
    return df.drop("_at")


def with_traffic(df: DataFrame, ctx: Learned) -> DataFrame:
    """voyages of the cell (0 if unknown) and course_prob (null without a histogram; an unknown course looks up bin 0)."""
    df = df.withColumn("_at", cell("lat", "lon", ctx.parameters.traffic_cell_m, ctx.origin)).withColumn("_bin", course_bin("cog_deg", ctx.parameters.bins))
    df = df.join(ctx.traffic.select(F.col("cell").alias("_c"), F.col("voyages").alias("_v")), F.col("_at") == F.col("_c"), "left").withColumn("voyages", F.coalesce("_v", F.lit(0))).drop("_c", "_v")
    h = ctx.courses.select(F.col("cell").alias("_c"), F.col("bin").alias("_b"), F.col("prob").alias("course_prob"))
    return df.join(h, (F.col("_at") == F.col("_c")) & (F.col("_bin") == F.col("_b")), "left").drop("_c", "_b", "_at", "_bin")
