"""Filters, samples, scores, analogs, learned correction, ingest, export and streams."""

import json
import zipfile
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.test_positions import T0, points, straight
from wakeline.config import Prediction, Region
from wakeline.operators import analogs, evaluate, learned, samples, simulate, tracking
from wakeline.sources import export, ingest
from wakeline.streaming import streams


def line(n=60, dt=60.0, v=(3.0, 4.0), noise=5.0, seed=0):
    t = np.arange(n) * dt
    truth = np.column_stack([t * v[0], t * v[1]])
    return t, truth + np.random.default_rng(seed).normal(0, noise, (n, 2)), truth


@pytest.mark.parametrize("run", [tracking.run_cv, tracking.run_imm])
def test_filters_follow_reject_and_restart(run):
    t, z, truth = line()
    z[30] += 5000
    got = run(t, z)
    assert not got.accepted[30] and got.accepted[40:].all() and np.hypot(*(got.x[-1, :2] - truth[-1])) < 15
    z = line()[1]
    z[30:] += 20_000
    got = run(t, z)
    assert got.restart[31] and np.hypot(*(got.x[-1, :2] - z[-1])) < 15
    z[10] = z[9]
    assert np.isnan(run(t, z).nis[10])
    with pytest.raises(ValueError):
        run(t[::-1], z)


def test_batch_equals_single_tracks_and_smoothing_helps():
    tracks = [line(n, seed=n) for n in (60, 20, 40)]
    n = np.array([60, 20, 40])
    t, z = np.zeros((3, 60)), np.zeros((3, 60, 2))
    for i, (a, b, _) in enumerate(tracks):
        t[i, : n[i]], z[i, : n[i]] = a, b
    vel = np.full((3, 60, 2), np.nan)
    for batch, single in ((tracking.run_cv_batch, tracking.run_cv), (tracking.run_imm_batch, tracking.run_imm)):
        got = batch(t, z, vel, n)
        for i in range(3):
            assert np.allclose(got.x[i, : n[i]], single(*tracks[i][:2]).x)
    one = tracking.run_cv(*tracks[0][:2], None, tracking.CvParameters(q=1e-4))
    err = lambda x: np.hypot(*(x[5:-5, :2] - tracks[0][2][5:-5]).T).mean()
    assert err(tracking.smooth(one)[0]) < err(one.x)


def test_turn_jacobian_and_switching():
    r = np.random.default_rng(3)
    for w in (0.0, 1e-9, 0.01, -0.02):
        x, dt = np.append(r.normal(0, 5, 4), w), 30.0
        y, f = tracking.turn(x, dt)
        for j in range(5):
            h = np.zeros(5)
            h[j] = 1e-6 if j < 4 else 1e-7
            assert np.allclose((tracking.turn(x + h, dt)[0] - tracking.turn(x - h, dt)[0]) / (2 * h[j]), f[:, j], rtol=1e-3, atol=2e-2)
    assert np.allclose(tracking.switching(120.0, tracking.ImmParameters()).sum(1), 1)


def test_simulation_and_study(spark):
    a = simulate.simulate_track(7, n=50)
    assert a.equals(simulate.simulate_track(7, n=50))
    s = {(r["model"], r["segment"]): r for r in simulate.study(simulate.follow(simulate.simulate(spark, range(6), n=120))).collect()}
    assert s["cv_kalman", "straight"]["median_m"] < 30 and s["imm", "straight"]["outlier_recall"] > 0.9
    assert 0 <= simulate.nees_in_band(simulate.follow(simulate.simulate(spark, range(4), n=60)), 4).first()["in_band"] <= 1


def test_anchors_are_greedy_and_truth_is_bracketed(spark):
    p = points(spark, straight(316000001, [0, 1, 2, 10, 19, 21, 40]))
    got = [r["us"] for r in samples.anchors(p, 600, 60).orderBy("us").collect()]
    us0 = int(T0.timestamp() * 1e6)
    assert [(u - us0) // 60_000_000 for u in got] == [1, 19, 40]
    q = spark.createDataFrame([("v", int(x * 1e6)) for x in (60, 90, 300, 700, -10)], "voyage_id string, at_us long")
    fixes = spark.createDataFrame([("v", datetime.fromtimestamp(x, timezone.utc), 42.0, -83.0 + x / 6000) for x in (0, 60, 120, 600)], "voyage_id string, t timestamp, lat double, lon double")
    lon = [r["lon_h"] for r in samples.truth_at(q, fixes, 180).orderBy(F.expr("array_position(array(60,90,300,700,-10), cast(at_us/1000000 as int))")).collect()]
    assert lon[2:] == [None, None, None] and abs(lon[0] + 83 - 0.01) < 1e-9 and abs(lon[1] + 83 - 0.015) < 1e-6


def sampled(spark, n=6):
    p = points(spark, [r for k in range(n) for r in straight(316000020 + k, range(0, 300), lat=42.0 + 0.02 * k, step=0.002)])
    return p, samples.build_samples(p, Prediction(horizons_min=(15, 30)))


def test_dead_reckoning_scores_and_calibration(spark):
    p, s = sampled(spark)
    dr = samples.dead_reckoning(s)
    scores = evaluate.per_sample_scores(dr, s.select("sample_id", "voyage_id", "vessel_group", "horizon_min", "lat_h", "lon_h", "known"))
    m = {r["horizon_min"]: r for r in evaluate.summarise_scores(scores).collect()}
    assert set(m) == {15, 30} and m[15]["mean_km"] < m[30]["mean_km"]
    fixed = evaluate.per_sample_scores(evaluate.with_cov_scale(dr, evaluate.cov_scales(scores)), s.select("sample_id", "voyage_id", "vessel_group", "horizon_min", "lat_h", "lon_h", "known"))
    assert all(abs(r["cov90"] - 0.9) < 0.08 for r in evaluate.summarise_scores(fixed).collect())
    ci = evaluate.cluster_intervals(scores, "error_km", "voyage_id", ("model",), 200).first()
    assert ci["clusters"] == 6 and ci["lo"] <= ci["point"] <= ci["hi"]
    other = scores.unionByName(scores.withColumn("model", F.lit("worse")).withColumn("error_km", F.col("error_km") + 1))
    assert abs(evaluate.paired_differences(other, "worse", "dead_reckoning").agg(F.avg("diff_km")).first()[0] - 1) < 1e-9
    assert evaluate.best_model(other).first()["model"] == "dead_reckoning"


def test_analogs_match_brute_force_and_fall_back(spark):
    p, s = sampled(spark, 4)
    prm = Prediction(horizons_min=(15, 30), k=5)
    lib = analogs.build_library(p, Region().origin, prm, 300.0, [300 * i for i in range(1, 13)])
    near = analogs.neighbours(s, lib, Region().origin, prm)
    a, b = s.select("sample_id", "lat0", "lon0", "cog_deg").distinct(), lib.collect()
    feats = {r["library_id"]: (r["l_e"], r["l_n"], r["l_s"], r["l_c"]) for r in b}
    asked = {r["sample_id"]: [r[c] for c in ("_e", "_n", "_s", "_c")] for r in analogs._features(a, Region().origin, prm).collect()}
    want = {i: sorted((float(np.linalg.norm(np.subtract(x, y))), k) for k, y in feats.items()) for i, x in asked.items()}
    got = {}
    for r in near.collect():
        got.setdefault(r["sample_id"], []).append((r["d"], r["library_id"]))
    for i, w in want.items():
        w = [x for x in w if x[0] < 3][:5]
        assert np.allclose([x[0] for x in sorted(got.get(i, []))], [x[0] for x in w])
    f = analogs.knn_forecast(s, lib, samples.dead_reckoning(s), Region().origin, prm)
    assert f.count() == s.count() and f.where("analog").count() > 0
    assert analogs.knn_forecast(s, lib.limit(0), samples.dead_reckoning(s), Region().origin, prm).where("analog").count() == 0


def test_learned_correction_is_causal_and_helps(spark):
    p, s = sampled(spark)
    rows = learned.features(s, p)
    cut = p.where(F.col("t") <= F.lit(T0 + timedelta(minutes=150)).cast("timestamp"))
    early = learned.features(s, cut).where(F.col("t0") <= F.lit(T0 + timedelta(minutes=150)).cast("timestamp"))
    cols = ["sample_id", "horizon_min", *learned.INPUTS]
    assert early.select(*cols).exceptAll(rows.select(*cols)).count() == 0
    truth = s.select("sample_id", "voyage_id", "vessel_group", "horizon_min", "lat_h", "lon_h", "known")
    mean = lambda f: evaluate.per_sample_scores(f, truth).agg(F.avg("error_km")).first()[0]
    assert mean(learned.forecast(rows, learned.fit(rows))) < mean(samples.dead_reckoning(s))


def test_ingest_layouts_quotes_ragged_rows(spark, tmp_path):
    head = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass"
    rows = ['316000001,2023-07-01T00:00:00,42.0,-83.0,10.1,90.0,90.0,RAY "CHIEF" TONEY,IMO1,C1,57.0,0,100,20,5.5,57,A', ",316000002,2023-07-01T00:00:00,42.0,-83.0,1,1,1,X,I,C,1,1,1,1,1,1,A", "316000003,2023-07-01T00:00:00,42.0,-83.0,,,,,,,,,,,,,B", "316000004,2023-07-01T00:00:00,30.0,-83.0,1,1,1,X,I,C,1,1,1,1,1,1,A"]
    (tmp_path / "a.csv").write_text("\n".join([head, *rows]) + "\n")
    got = {r["mmsi"]: r for r in ingest.region_reports(ingest.read_day_csv(spark, str(tmp_path / "a.csv"))).collect()}
    assert set(got) == {316000001, 316000003} and got[316000001]["vessel_name"] == 'RAY "CHIEF" TONEY' and got[316000001]["vessel_type"] == 57 and got[316000003]["sog_kn"] is None
    (tmp_path / "b.csv").write_text("mmsi,base_date_time,longitude,latitude,sog,cog,heading,vessel_name,imo,call_sign,vessel_type,status,length,width,draft,cargo,transceiver\n316000009,2023-07-01 00:00:00,-83.0,42.0,1,1,1,X,I,C,1,1,1,1,1,1,A\n")
    r = ingest.to_canonical(ingest.read_day_csv(spark, str(tmp_path / "b.csv"))).first()
    assert (r["lat"], r["lon"]) == (42.0, -83.0)
    with pytest.raises(ValueError, match="cargo"):
        ingest.header_columns(["x", "y"])
    day, read, kept = ingest.ingest_day(spark, str(tmp_path / "a.csv"), date(2023, 7, 1), str(tmp_path / "out"))
    assert (read, kept) == (4, 2) and ingest.read_reports(spark, str(tmp_path / "out")).select("_file", "_row").count() == 2
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", head + "\n" + rows[0])
        z.writestr("readme.txt", "x")
    (tmp_path / "d.csv.zst").write_bytes(zstandard.compress("\r\n".join([head, rows[0].replace("CHIEF", "A\u2028B\x0b"), rows[2]]).encode()))
    zipped, packed = (ingest.to_canonical(ingest.read_archives(spark, str(tmp_path / f))).collect() for f in ("c.zip", "d.csv.zst"))
    assert zipped == ingest.to_canonical(ingest.read_day_csv(spark, str(tmp_path / "a.csv"))).where("mmsi = 316000001").collect()
    assert [r["vessel_name"] for r in packed] == ['RAY "A\u2028B\x0b" TONEY', None]
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("c.csv", head)
        z.writestr("d.CSV", head)
    with pytest.raises(Exception, match="2 found"):
        ingest.read_archives(spark, str(tmp_path / "two.zip")).collect()
    days = ingest.configured_days(date(2023, 7, 1), date(2023, 7, 3), [(date(2023, 7, 3), date(2023, 7, 4))])
    assert len(days) == 4 and ingest.pending_days(spark, days, spark.createDataFrame([(date(2023, 7, 2),)], "day date")).count() == 3


def test_ingest_loop_goes_on_after_a_bad_day(spark, tmp_path):
    names = ",".join(ingest.HEADER_NAMES)
    good = f"{names}\n316000009,2023-07-01 00:00:00,42.0,-83.0" + ",1" * 12 + ",A\n"
    days = [date(2023, 7, d) for d in (1, 2, 3)]
    for d, text in zip(days, (good, "x,y\n1,2\n", good)):
        (tmp_path / f"{d}.csv").write_text(text)
    run = lambda: {r["day"].day: (r["rows_kept"], bool(r["error"])) for r in ingest.ingest_pending(spark, days, lambda d: str(tmp_path / f"{d}.csv"), str(tmp_path / "out"), str(tmp_path / "manifest")).collect()}
    assert run() == {1: (1, False), 2: (None, True), 3: (1, False)}
    assert {r["day"].day for r in ingest.pending_days(spark, days, ingest.read_manifest(spark, str(tmp_path / "manifest"))).collect()} == {2}
    (tmp_path / "2023-07-02.csv").write_text(good)
    assert run() == {1: (1, False), 2: (1, False), 3: (1, False)} and ingest.read_reports(spark, str(tmp_path / "out")).count() == 3


def test_missing_state_is_an_error_and_verdict_by_horizon(spark):
    s = spark.createDataFrame([("s1", "v1", 1), ("s2", "v2", 2)], "sample_id string, voyage_id string, t0 long")
    t = spark.createDataFrame([("v1", 1, 0.5)], "voyage_id string, t long, f_lat double")
    assert tracking.with_states(s.where("sample_id = 's1'"), t, ["f_lat"]).collect()[0]["f_lat"] == 0.5
    with pytest.raises(Exception, match="no filter state for sample s2"):
        tracking.with_states(s, t, ["f_lat"]).collect()
    rows = [(m, f"s{k}", f"v{k % 7}", h, e + 0.01 * k) for k in range(40) for m, h, e in (("dead_reckoning", 15, 2.0), ("knn", 15, 1.0), ("dead_reckoning", 60, 3.0), ("knn", 60, 5.0), ("net", 15, 0.5), ("net", 60, 4.0))]
    got = {r["horizon_min"]: r for r in evaluate.verdict(spark.createDataFrame(rows, "model string, sample_id string, voyage_id string, horizon_min int, error_km double"), "net", 100).collect()}
    assert got[15]["best_baseline"] == "knn" and got[60]["best_baseline"] == "dead_reckoning"
    assert abs(got[15]["point"] + 0.5) < 1e-9 and abs(got[60]["point"] - 1) < 1e-9 and got[60]["lo"] <= 1 + 1e-9 and got[60]["clusters"] == 7


def test_pick_of_settings(spark):
    pick = lambda rows: {r["settings"]: (r["eligible"], r["chosen"]) for r in evaluate.pick_setting(spark.createDataFrame(rows, "settings string, precision double, recall double, base_per_1000_h double, own boolean")).collect()}
    now = ("now", 0.95, 0.6, 2.0, True)
    assert pick([now, ("a", 1.0, 0.9, 2.1, False), ("b", 0.9, 0.8, 2.0, False), ("c", 0.99, 0.8, 1.0, False), ("d", 0.89, 0.99, 0.1, False)]) == {"now": (True, False), "a": (False, False), "b": (True, False), "c": (True, True), "d": (False, False)}
    assert pick([("now", 0.5, 0.6, 2.0, True), ("a", None, 0.9, 0.0, False)]) == {"now": (False, True), "a": (False, False)}


def test_a_long_voyage_does_not_widen_short_ones():
    sizes = {"a": 3, "b": 5000, "c": 40, "d": 1, "e": 39}
    v = pd.DataFrame({"voyage_id": [k for k, n in sizes.items() for _ in range(n)], "i": range(sum(sizes.values()))})
    parts = list(tracking._of_like_length(v, 100))
    assert [sorted(set(p["voyage_id"])) for p in parts] == [["b"], ["c", "e"], ["a", "d"]]
    assert all(len(set(p["voyage_id"])) == 1 or len(set(p["voyage_id"])) * p["voyage_id"].value_counts().max() <= 100 for p in parts)
    assert sorted(i for p in parts for i in p["i"]) == list(range(len(v))) and all(g["i"].is_monotonic_increasing for p in parts for _, g in p.groupby("voyage_id"))


def test_gap_noise_widens_every_mode():
    x, p, dt = np.zeros((1, 3, 5)), np.repeat(np.eye(5)[None, None], 3, 1), np.array([600.0])
    plain, wide = (tracking.mode_steps(x, p, dt, tracking.ImmParameters(gap_q=q))[1] for q in (0.0, 1e-3))
    extra = tracking.cv_step(600.0, 1e-3)[1]
    assert np.allclose((wide - plain)[0, :, :4, :4], extra) and np.allclose((wide - plain)[0, :, 4, 4], 0)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.23456789)], "a int, b double")
    assert [json.loads(r[0]) for r in export.json_rows(df).orderBy("json").collect()] == [{"a": 1}, {"a": 2, "b": 1.23457}]
    export.write_json(str(tmp_path / "x.json"), {"a": float("inf"), "b": [1.0, float("nan")]})
    assert (tmp_path / "x.json").read_text() == '{"a":null,"b":[1.0,null]}\n'


def test_streams_equal_batch(spark, tmp_path):
    p = points(spark, straight(316000001, [*range(0, 20), *range(60, 80)]) + straight(316000002, range(0, 20)))
    src = p.select("mmsi", "t", "lat", "lon", "sog_kn", "cog_deg")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(316000009, T0 + timedelta(days=2), 42.0, -83.0, 1.0, 1.0)], src.schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    v = run(streams.voyage_stream(stream), "voyages_out")
    assert sorted(r["n_points"] for r in v.where("mmsi < 316000009").collect()) == [20, 20, 20]
    f = run(streams.filter_stream(stream), "filter_out").where("mmsi = 316000002").orderBy("t").collect()
    assert len(f) == 20 and abs(f[-1]["f_lat"] - 42.2) < 1e-3
    q = streams.ingest_stream(spark, str(tmp_path / "in"), src.schema, str(tmp_path / "out"), str(tmp_path / "cp"), Region())
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count() + 1
