"""The batch stages chained over synthetic days of all three splits."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from wakeline.config import Config
from wakeline.plans import stages
from wakeline.sources.ingest import CANONICAL


def test_stages_end_to_end(spark, tmp_path):
    rows = []
    for d, day in enumerate((datetime(2023, 7, 1), datetime(2023, 9, 10), datetime(2023, 10, 10))):
        for v in range(3):
            for m in range(0, 240):
                if v == 2 and 100 <= m < 145:
                    continue
                t = day.replace(tzinfo=timezone.utc) + timedelta(minutes=m)
                mmsi = 316000001 + v + 10 * (d == 2 and v == 1)
                rows.append((mmsi, t, 42.0 + 0.05 * v, -83.3 + 0.002 * m, 8.0, 90.0, 90.0, f"V{v}", None, None, 70, 0, 100.0, 20.0, 5.0, 70, "A", day.date()))
    spark.createDataFrame(rows, CANONICAL + ", date date").write.partitionBy("date").parquet(str(tmp_path / "reports"))
    config = Config.load({"context": {"course_min_fixes": 5}, "prediction": {"horizons_min": (15, 30), "n_boot": 50}})
    for name, stage in stages.STAGES.items():
        stage(spark, str(tmp_path), config)
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    voyages = read("voyages")
    assert {r["split"] for r in voyages.collect()} == {"train", "val", "test"} and voyages.groupBy("mmsi").count().where("count > 3").count() == 1
    assert read("points").groupBy("voyage_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert read("events").where("type = 'gap'").count() >= 1
    models = {r["model"] for r in read("test_summary").collect()}
    assert {"dead_reckoning", "cv_kalman", "imm_switching", "imm_frozen", "knn", "learned"} <= models
    assert read("test_unseen").where("n > 0").count() >= 1 and read("verdict").count() == 2 and (tmp_path / "summary.md").exists()
    tuned = stages.tune(spark, str(tmp_path), config, "gap", {"min_gap_min": (30.0, 40.0)}, (60.0,), lambda m: m, 4).collect()
    assert len(tuned) == 2 and all(r["recall"] is not None for r in tuned)
