"""Snapshots that are compared by digests: the same rows, and files of equal buckets left unread."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from brookcheck.operators import drift


def _snapshots(spark):
    at = datetime.datetime(2026, 1, 1, 0, 0, 0, 1)
    rows = [(i, None if i % 5 == 0 else f"v{i}", at, {"k": str(i)} if i % 2 else None, 1.0 * i) for i in range(300)]
    before = spark.createDataFrame(rows, "id long, v string, at timestamp, tags map<string,string>, x double").drop("tags")
    after = before.where("id <> 7").withColumn("at", F.when(F.col("id") == 11, F.col("at") + F.expr("INTERVAL 0.000001 SECOND")).otherwise(F.col("at"))).withColumn("v", F.when(F.col("id") == 20, F.lit("now")).otherwise(F.col("v")))
    return before, after.unionByName(before.limit(1).withColumn("id", F.lit(1000).cast("long")))


def test_only_buckets_that_differ_are_read(spark, tmp_path):
    before, after = _snapshots(spark)
    for name, df in (("a", before), ("b", after.repartition(3))):
        drift.write_snapshot(df, str(tmp_path / name), ["id"], 64)
    out = drift.diff_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["id"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, drift.snapshot_diff(before, after, ["id"]).collect()))
    assert [(r.id, r.change, r.changed) for r in out.orderBy("id").collect()] == [(7, "removed", []), (11, "modified", ["at"]), (20, "modified", ["v"]), (1000, "added", [])]
    differ = drift.differing_buckets(*(spark.read.parquet(str(tmp_path / n / "digests")) for n in "ab"))
    assert 1 <= len(differ) <= 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [_bucket") >= 2
    read = spark.read.parquet(str(tmp_path / "a" / "rows")).where(F.col("_bucket").isin(differ)).select("_metadata.file_path").distinct().count()
    assert read <= len(differ)


def test_equal_snapshots_read_no_rows(spark, tmp_path):
    before, _ = _snapshots(spark)
    for name in "ab":
        drift.write_snapshot(before.repartition(2 if name == "a" else 5), str(tmp_path / name), ["id"], 16)
    a, b = (spark.read.parquet(str(tmp_path / n / "digests")) for n in "ab")
    assert drift.differing_buckets(a, b) == []
    assert drift.diff_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["id"]).count() == 0


def test_nulls_that_change_places_are_seen(spark):
    a, b = (spark.createDataFrame([(1, *r)], "id long, x string, y string") for r in (("v", None), (None, "v")))
    assert len(drift.differing_buckets(drift.bucket_digests(a, ["id"], 4), drift.bucket_digests(b, ["id"], 4))) == 1


def test_unlike_snapshots_are_refused(spark, tmp_path):
    before, _ = _snapshots(spark)
    drift.write_snapshot(before, str(tmp_path / "a"), ["id"], 16)
    drift.write_snapshot(before, str(tmp_path / "b"), ["id"], 8)
    drift.write_snapshot(before, str(tmp_path / "c"), ["id"], 16, format_version=2)
    for other in "bc":
        with pytest.raises(ValueError):
            drift.diff_snapshots(spark, str(tmp_path / "a"), str(tmp_path / other), ["id"])
    with pytest.raises(ValueError):
        drift.diff_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "a"), ["v"])
