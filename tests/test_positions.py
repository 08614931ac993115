"""Cleaning, voyages, context and detectors on small hand-made tracks."""

import json
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.config import Config, Gap, Jump, Loiter, Region, Rendezvous
from wakeline.functions import geo, stats
from wakeline.operators import clean, context, detectors, inject, segment, sequence

T0 = datetime(2023, 7, 1, tzinfo=timezone.utc)
FIX = "_file string, _row long, mmsi long, t timestamp, lat double, lon double, sog_kn double, cog_deg double, heading_deg double, vessel_type int, vessel_name string, length_m double, transceiver string"


def straight(mmsi, minutes, lat=42.2, lon=-83.0, step=0.004, sog=10.0, first=0):
    return [("a", first + i, mmsi, T0 + timedelta(minutes=m), lat, lon + step * m, sog, 90.0, 90.0, 70, "X", 100.0, "A") for i, m in enumerate(minutes)]


def frame(spark, rows):
    return spark.createDataFrame(rows, FIX)


def test_cleaning_policy_and_report(spark):
    rows = straight(316000001, range(5))
    bad = list(rows[0])
    rows += [tuple(["b", 0, *bad[2:]])]  # duplicate that arrives later
    rows += [("b", 1, 1234567, *rows[0][3:]), ("b", 2, 992000001, *rows[0][3:]), ("b", 3, None, *rows[0][3:])]
    rows += [("b", 4, 316000002, T0, 42.0, -83.0, 102.3, 360.0, 511.0, None, None, None, "52")]
    df = frame(spark, rows)
    got = clean.clean_points(df)
    assert got.count() == 5 and {r["_file"] for r in got.collect()} == {"a"}
    assert clean.clean_report(df).first().asDict() == {"rows_in": 10, "null_keys": 1, "invalid_mmsi": 2, "malformed": 1, "duplicates": 1, "rows_out": 5}
    s = clean.clean_points(frame(spark, [("a", 0, 316000002, T0, 42.0, -83.0, 102.3, 360.0, 511.0, None, None, None, None)])).first()
    assert s["sog_kn"] is None and s["cog_deg"] is None and s["heading_deg"] is None and s["dist_prev_m"] is None and s["spike"] is False


def test_spike_is_out_and_back(spark):
    rows = straight(316000001, range(5))
    rows[2] = (*rows[2][:4], 42.3, *rows[2][5:])
    assert [r["spike"] for r in clean.clean_points(frame(spark, rows)).orderBy("t").collect()] == [False, False, True, False, False]


def test_voyages_split_only_over_the_limit_and_labels_need_the_whole_span(spark):
    p = segment.assign_voyages(clean.clean_points(frame(spark, straight(316000001, [0, 1, 31, 72, 73]))))
    assert p.select("voyage_id").distinct().count() == 2
    v = {r["voyage_id"]: r for r in segment.summarise_voyages(p).collect()}
    assert sorted(r["n_points"] for r in v.values()) == [2, 3] and {r["split"] for r in v.values()} == {"train"}
    assert v["316000001-20230701T0000"]["vessel_group"] == "cargo" and v["316000001-20230701T0000"]["usable"] is False
    edge = spark.createDataFrame([(datetime(2023, 8, 31, 23, 0), datetime(2023, 9, 1, 0, 0)), (datetime(2023, 8, 31, 23, 0), datetime(2023, 8, 31, 23, 59))], "t_start timestamp, t_end timestamp")
    assert [r[0] for r in edge.select(segment.split_label(Config().splits)).collect()] == ["none", "train"]


def test_geodesy_round_trip_and_twins(spark):
    r = np.random.default_rng(1)
    lat, lon = r.uniform(41.4, 43.1, 50), r.uniform(-83.6, -82.3, 50)
    e, n = geo.np_enu(lat, lon, 42.25, -82.95)
    back = geo.np_latlon(e, n, 42.25, -82.95)
    assert np.abs(back[0] - lat).max() < 1e-5 and np.abs(back[1] - lon).max() < 1e-5
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "i int, lat double, lon double")
    ce, cn = geo.enu("lat", "lon", 42.25, -82.95)
    la, lo = geo.latlon(ce, cn, 42.25, -82.95)
    got = np.array(df.orderBy("i").select(ce, cn, la, lo, geo.haversine_m("lat", "lon", 42.25, -82.95)).collect())
    assert np.allclose(got[:, 0], e, atol=1e-4) and np.allclose(got[:, 1], n, atol=1e-4) and np.allclose(got[:, 2], back[0]) and np.allclose(got[:, 3], back[1])
    assert np.allclose(got[:, 4], geo.np_haversine_m(lat, lon, 42.25, -82.95))
    ring = df.limit(1).select(geo.ellipse("lat", "lon", F.lit(100.0), F.lit(100.0), F.lit(0.0)).alias("r"), "lat", "lon").first()
    d = geo.np_haversine_m(ring["lat"], ring["lon"], [p["lat"] for p in ring["r"]], [p["lon"] for p in ring["r"]])
    assert len(ring["r"]) == 49 and np.allclose(d, np.sqrt(stats.chi2_2(0.9) * 100), rtol=0.01)


def test_quantiles():
    assert abs(stats.chi2_2(0.95) - 5.991464547) < 1e-8
    assert abs(stats.chi2_quantile(0.95, 2) - 5.991464547) < 1e-6 and abs(stats.chi2_quantile(0.975, 40) - 59.34171) < 1e-3


def points(spark, rows):
    return segment.assign_voyages(clean.clean_points(frame(spark, rows))).withColumn("vessel_group", clean.vessel_group())


def test_gap_rules(spark):
    many = points(spark, straight(316000001, [0, 1, 2, 48, 49]))
    assert detectors.detect_gaps(many).count() == 1
    e = detectors.detect_gaps(many).first()
    assert e["duration_min"] == 46 and e["type"] == "gap" and json.loads(e["explanation"])["minutes"] == 46
    assert detectors.detect_gaps(points(spark, straight(316000001, [0, 1, 22]))).count() == 0
    assert detectors.detect_gaps(points(spark, straight(316000001, [0, 46], sog=0.1))).count() == 0
    assert detectors.detect_gaps(points(spark, straight(316000001, [0, 46], lat=41.405))).count() == 0
    assert detectors.detect_gaps(many, days=[date(2023, 7, 1)]).count() == 1 and detectors.detect_gaps(many, days=[date(2023, 7, 2)]).count() == 0
    assert detectors.detect_gaps(points(spark, straight(316000001, [0, 1800], step=0.0001))).count() == 0


def test_jump_merges_out_and_back_and_takes_the_first_of_equal_steps(spark):
    rows = straight(316000001, range(8))
    rows[4] = (*rows[4][:4], 42.4, *rows[4][5:])
    e = detectors.detect_jumps(points(spark, rows), Jump()).collect()
    assert len(e) == 1 and e[0]["t_start"].replace(tzinfo=timezone.utc) == T0 + timedelta(minutes=3) and e[0]["t_end"].replace(tzinfo=timezone.utc) == T0 + timedelta(minutes=5) and e[0]["lat_end"] == 42.4


def test_runs_and_bridge(spark):
    df = spark.createDataFrame([(1, T0 + timedelta(minutes=m), f) for m, f in [(0, True), (1, True), (2, False), (3, True), (60, True)]] + [(2, T0, True)], "mmsi long, t timestamp, flag boolean")
    assert sorted(sequence.runs(df, "flag", 600).groupBy("mmsi", "run").count().select("count").toPandas()["count"]) == [1, 1, 1, 2]
    assert sequence.bridge(df, "flag", 180).where("flag").count() == 6


def trained(spark):
    rows = []
    for k in range(12):
        rows += straight(316000100 + k, range(0, 60), lat=42.2 + 0.0001 * k)
    for k in range(4):
        rows += straight(316000200 + k, range(0, 1200, 3), lat=42.5, lon=-82.8, step=0.0, sog=0.1)
    return points(spark, rows)


def test_context_and_loiter_and_deviation(spark):
    p = trained(spark)
    ctx = context.learn(p)
    assert ctx.ports.count() == 9 and ctx.traffic.agg(F.max("voyages")).first()[0] >= 6
    away = points(spark, straight(316000300, range(0, 200, 5), lat=42.0, lon=-82.9, step=0.0, sog=0.3))
    assert detectors.detect_loiter(away, Loiter(), ctx).count() == 1
    assert detectors.detect_loiter(points(spark, straight(316000301, range(0, 200, 5), lat=42.5, lon=-82.8, step=0.0, sog=0.3)), Loiter(), ctx).count() == 0
    off = detectors.detect_deviation(points(spark, straight(316000302, range(0, 30), lat=41.9)), ctx).collect()
    assert len(off) == 1 and json.loads(off[0]["explanation"])["rule"] == "lane"
    assert detectors.detect_deviation(points(spark, straight(316000303, range(0, 30))), ctx).count() == 0
    back = [(*r[:7], 270.0, *r[8:]) for r in straight(316000304, range(0, 30))]
    ctx2 = context.learn(p, Config.load({"context": {"course_min_fixes": 5, "traffic_cell_m": 2000.0}}).context)
    assert {round(r["s"], 9) for r in ctx2.courses.groupBy("cell").agg(F.sum("prob").alias("s")).collect()} == {1.0}
    wrong = detectors.detect_deviation(points(spark, back), ctx2).collect()
    assert len(wrong) == 1 and json.loads(wrong[0]["explanation"])["rule"] == "course"


def test_rendezvous_has_no_cartesian_product(spark, capsys):
    rows = straight(316000001, range(0, 120, 3), step=0.0, sog=0.5) + straight(316000002, range(0, 120, 3), lat=42.202, step=0.0, sog=0.5) + straight(316000003, range(0, 120, 3), lat=42.3, step=0.0, sog=0.5)
    df = detectors.detect_rendezvous(points(spark, rows), Rendezvous())
    e = df.collect()
    assert [(r["mmsi"], r["mmsi2"]) for r in e] == [(316000001, 316000002)] and e[0]["duration_min"] == 120
    df.explain()
    assert "Cartesian" not in (plan := capsys.readouterr().out) and "NestedLoop" not in plan


def test_injections_are_found(spark):
    region = Region()
    p = points(spark, [r for k in range(4) for r in straight(316000010 + k, range(0, 240), lat=42.0 + 0.1 * k, step=0.002)])
    for kind, m, span, run in (("gap", 60.0, lambda x: x, lambda x, k: detectors.detect_gaps(x, Gap(), region, None, None, k)), ("jump", 5.0, lambda x: 5.0, lambda x, k: detectors.detect_jumps(x, Jump(), k)), ("loiter", 180.0, lambda x: x - 60, lambda x, k: detectors.detect_loiter(x, Loiter(min_hours=1.5), None, k)), ("rendezvous", 90.0, lambda x: x, lambda x, k: detectors.detect_rendezvous(x, Rendezvous(), region, None, k))):
        chosen = inject.choose(p, kind, [m], span, 4, region)
        rows = inject.injection_study(p, chosen, kind, run, region).collect()
        assert rows and all(r["detected"] for r in rows), kind
    bump = inject.inject_deviation(inject.replicate(p, inject.choose(p, "deviation", [2.0], lambda x: 40.0, 2, region)), region)
    moved = bump.join(p.select("voyage_id", "t", F.col("lat").alias("a"), F.col("lon").alias("o")), ["voyage_id", "t"]).select(geo.haversine_m("lat", "lon", "a", "o").alias("d"))
    assert 1500 < moved.agg(F.max("d")).first()[0] < 2050


def test_config():
    assert Config().hash() == Config().hash() != Config.load({"gap": {"min_gap_min": 31.0}}).hash() and len(Config().hash()) == 12
    with pytest.raises(ValueError):
        Config.load({"gap": {"nonsense": 1}})
    with pytest.raises(ValueError):
        Config.load({"splits": [["train", "2023-02-01", "2023-01-01"]]})
