from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from brookcheck.operators import history, ingest, results
from brookcheck.plans import fixtures as fx
from brookcheck.sources import files

DATA = "/root/testdata/sf0.001"


def test_sinks_and_sources_round_trip(spark, tmp_path):
    m = fx.valid_messages(spark, DATA).limit(50)
    files.write_messages(m.drop("headers"), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 50 and "route=" in "".join(back.inputFiles())
    r = fx.results(spark, DATA).limit(50)
    files.write_results(r, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("date = to_date(processed_at)").count() == 50
    rec = fx.records(spark, DATA).drop("seq").limit(20)
    files.write_records(rec, {"format": "json", "path": str(tmp_path / "k")})
    topics = [x.topic for x in rec.select("topic").distinct().collect()]
    assert files.read_records(spark, {"format": "json", "path": str(tmp_path / "k")}, topics).count() == 20
    e = fx.config_events(spark, DATA, checked=False)
    e.write.parquet(str(tmp_path / "e"))
    ok, bad = files.read_config_events(spark, str(tmp_path / "e"))
    assert ok.count() + bad.count() == e.count() and bad.count() > 0
    files.write_rejects(bad, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == bad.count()


def test_outgoing_records_are_cleaned_and_blank_topics_refused(spark, tmp_path):
    at = datetime.datetime(2026, 1, 2, 3, 4, 5, 600)
    rows = [(" t ", "k", "p", {" A ": " x ", "": "y", "n": None}, at), (" \t", "k", "p", None, at), ("u", None, "p", None, None)]
    df = spark.createDataFrame(rows, "topic string, key string, payload string, headers map<string,string>, published_at timestamp")
    refused = files.write_records(df, {"format": "json", "path": str(tmp_path / "o")})
    assert [(r.topic, r.problem.code) for r in refused.collect()] == [("", "VAL_INVALID_ARGUMENT")]
    ok = {r.topic: r for r in files.for_kafka(files.outgoing_records(df)[0]).collect()}
    assert {(h.key, bytes(h.value).decode()) for h in ok["t"].headers} == {("A", "x"), ("n", ""), ("published_at", "2026-01-02T03:04:05.000600Z")}
    assert [h.key for h in ok["u"].headers] == ["published_at"] and bytes(ok["u"].headers[0].value)


def test_retries_end(spark):
    df = spark.createDataFrame([(1, "SYS_NOT_FOUND", True, 9), (2, "SYS_NOT_FOUND", True, 10), (3, "SYS_CONFLICT", False, 1), (4, "SYS_UNAVAILABLE", False, None)], "id int, code string, retryable boolean, attempt int")
    again, over = results.retry_rejects(df.withColumn("problem", F.struct("code", "retryable")))
    assert sorted((r.id, r.attempt) for r in again.collect()) == [(1, 10), (4, 2)] and sorted(r.id for r in over.collect()) == [2, 3]


def test_values_envelopes_and_scopes(spark):
    assert [r.x for r in ingest.normalize_values(spark.createDataFrame([(" b ",), ("a",), ("",), (None,), ("b",)], "x string"), "x").collect()] == ["a", "b"]
    e = spark.createDataFrame([("1", "event", "t", datetime.datetime(2026, 1, 1), "c", {"": "x"}), ("2", "event", "t", datetime.datetime(2026, 1, 1), "c", None)], "id string, kind string, type string, timestamp timestamp, content_type string, headers map<string,string>")
    ok, bad = ingest.validate_envelopes(e, "event", "t")
    assert [r.id for r in ok.collect()] == ["2"] and [i.field for i in bad.first().problem.issues] == ["headers"]
    with pytest.raises(ValueError):
        history.scope_filter(e, "tenant", " ")
