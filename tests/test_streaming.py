from datetime import datetime

from strideway.streaming.verification_feed import compact, current, keep_latest

SCHEMA = "candidate_id string, verification_id string, verified_at timestamp, seating boolean"


def test_batches_fold_into_the_latest(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("c1", "v1", datetime(2026, 1, 1), True), ("c2", "v2", None, None)], [("c1", "v0", datetime(2026, 1, 1), False), ("c2", "v3", datetime(2025, 1, 1), True), ("c3", "v4", None, None)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        keep_latest(spark.readStream.schema(SCHEMA).parquet(source), folder, str(tmp_path / "check")).awaitTermination()
    want = {"c1": "v0", "c2": "v3", "c3": "v4"}
    assert n == 1 and {r["candidate_id"]: r["verification_id"] for r in current(spark, folder).collect()} == want
    assert {r["candidate_id"] for r in spark.read.parquet(f"{folder}/batch=1").collect()} == {"c1", "c2", "c3"}
    compact(spark, folder, folder + "-small")
    kept = current(spark, folder + "-small")
    assert kept.columns == current(spark, folder).columns and {r["candidate_id"]: r["verification_id"] for r in kept.collect()} == want
