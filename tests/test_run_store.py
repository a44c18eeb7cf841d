"""The run store: round trip, commit and abort, filters that reach it."""

import pytest
from pyspark.sql import functions as F

from vicinal.sources import records
from vicinal.sources.run_store import SCHEMA, registered


@pytest.fixture
def store(spark, tmp_path):
    registered(spark)
    rows = [(f"r{i}", "failed" if i % 5 == 0 else "success", {"model": "gcn" if i % 2 else "mlp", "seed": str(i)}, {"f1": i / 10, "none": None}, {"host": "a"}) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.format("runs").mode("append").save(str(tmp_path))
    return tmp_path, rows


def test_round_trip(spark, store):
    root, rows = store
    got = spark.read.format("runs").load(str(root)).collect()
    assert sorted((r.run_id, r.status, dict(r.params), dict(r.metrics), dict(r.tags)) for r in got) == sorted(rows)
    assert sorted(r.run_id for r in records.load_records(root)) == sorted(x[0] for x in rows) and not (root / "_staged").exists()
    # what the other writer of records leaves is read too; a folder without a record isn't a run
    records.save_record(root, records.Record("hand", metrics={"f1": 1.0}))
    (root / "half").mkdir()
    assert spark.read.format("runs").load(f"file://{root}").count() == 13


def test_filters_reach_the_store(spark, store):
    root, _ = store
    df = spark.read.format("runs").load(str(root))
    (root / "r3" / "record.json").write_text("{")  # would be passed over if it were opened
    one = df.filter("run_id = 'r4'")
    assert [r.run_id for r in one.collect()] == ["r4"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "isnotnull" in plan
    assert {r.run_id for r in df.filter(F.col("run_id").isin("r1", "r2", "none") & (F.col("status") == "success")).collect()} == {"r1", "r2"}
    assert {r.run_id for r in df.filter("status = 'failed' and metrics['f1'] > 0.2").collect()} == {"r5", "r10"}
    assert df.filter("run_id = 'r1' and run_id = 'r2'").count() == 0


def test_aborted_writes_leave_nothing(spark, store):
    root, rows = store
    before = sorted(p.name for p in root.iterdir())
    bad = spark.createDataFrame([("new1", "success", {}, {}, {}), ("a/b", "success", {}, {}, {})], SCHEMA)
    with pytest.raises(Exception, match="can't be called"):
        bad.coalesce(1).write.format("runs").mode("append").save(str(root))
    again = spark.createDataFrame([("new2", "success", {}, {}, {}), ("r1", "failed", {}, {}, {})], SCHEMA)
    with pytest.raises(Exception, match="already"):
        again.write.format("runs").mode("append").save(str(root))
    with pytest.raises(Exception, match="twice"):
        again.filter("run_id = 'new2'").unionByName(again.filter("run_id = 'new2'")).write.format("runs").mode("append").save(str(root))
    assert sorted(p.name for p in root.iterdir()) == before
    again.write.format("runs").mode("overwrite").save(str(root))
    assert {r.run_id: r.status for r in spark.read.format("runs").load(str(root)).collect()} == {"new2": "success", "r1": "failed"}


def test_empty_and_remote(spark, tmp_path):
    registered(spark)
    assert spark.read.format("runs").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="mounted"):
        spark.read.format("runs").load("s3://x/y").count()
