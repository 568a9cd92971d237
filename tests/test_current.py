"""The kept table of current results and the retention of logs, on small tables and their files."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import functions as F

from brookcheck.operators import results
from brookcheck.plans import fixtures as fx
from brookcheck.sources import current, files

DATA = "/root/testdata/sf0.001"
NOW = datetime.datetime(2026, 3, 10)


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    at, log = str(tmp_path / "current"), str(tmp_path / "log")
    fx.results(spark, DATA).write.parquet(log)
    df = spark.read.parquet(log)
    assert current.merge_results(df.limit(0), at, 8) == [] and not os.path.exists(at)
    first = df.where("seq < 10000000")
    assert current.merge_results(first, at, 8) == list(range(8))
    before = _files(at)
    one = results.latest_results(first).withColumn("b", current.bucket(8)).where("b = 3").drop("b").limit(5)
    again = one.withColumn("seq", F.col("seq") + 20_000_000).withColumn("status", F.lit("failed"))
    again.write.parquet(str(tmp_path / "again"))
    again = spark.read.parquet(str(tmp_path / "again"))
    assert current.merge_results(again, at, 8) == [3]
    after = _files(at)
    stays = {f for f in before if "bucket=3" not in f}
    assert stays <= set(after) and all(before[f] == after[f] for f in stays)
    assert not {f for f in after if "bucket=3" in f} & set(before)
    # What is older than what stands changes nothing.
    current.merge_results(first, at, 8)
    want = results.latest_results(first.unionByName(again)).select("processing_key", "status", "seq")
    got = current.read_current(spark, at).select("processing_key", "status", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    current.rebuild_current(first.unionByName(again), at, 8)
    assert sorted(map(tuple, current.read_current(spark, at).select("processing_key", "status", "seq").collect())) == sorted(map(tuple, want.collect()))


def _log(spark, path, days):
    rows = [(datetime.datetime(2026, 3, d, 12), f"{d}-{i}") for d, n in days.items() for i in range(n)]
    files.write_results(spark.createDataFrame(rows, "processed_at timestamp, message_id string").coalesce(1), path)


def test_days_go_by_age(spark, tmp_path):
    at = str(tmp_path / "log")
    _log(spark, at, {6: 5, 8: 5, 9: 5, 10: 5})
    assert current.retain_days(spark, at, 24, 1 << 40, NOW) == [datetime.date(2026, 3, 6), datetime.date(2026, 3, 8)]
    assert sorted(x for x in os.listdir(at) if x.startswith("date=")) == ["date=2026-03-09", "date=2026-03-10"]
    assert spark.read.parquet(at).count() == 10
    assert current.retain_days(spark, at, 24, 1 << 40, NOW) == []


def test_days_go_by_size_the_oldest_first(spark, tmp_path):
    at = str(tmp_path / "log")
    _log(spark, at, {6: 50, 7: 50, 8: 50, 9: 50})
    sizes = {r.date.day: r.bytes for r in current.day_sizes(spark, at).collect()}
    assert sizes == {int(d[-2:]): sum(os.path.getsize(os.path.join(at, d, f)) for f in os.listdir(os.path.join(at, d)) if f.endswith(".parquet")) for d in os.listdir(at) if d.startswith("date=")}
    assert current.retain_days(spark, at, 24 * 365, sizes[8] + sizes[9], NOW) == [datetime.date(2026, 3, 6), datetime.date(2026, 3, 7)]
    # The newest day stays, however large.
    assert current.retain_days(spark, at, 24 * 365, 1, NOW) == [datetime.date(2026, 3, 8)]
    assert {r.message_id.split("-")[0] for r in spark.read.parquet(at).collect()} == {"9"}
