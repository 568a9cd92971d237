from __future__ import annotations

from pyspark.sql import functions as F

from brookcheck.operators import drift, ingest, topology
from brookcheck.plans import fixtures as fx


def test_route(spark):
    assert spark.range(1).select(topology.route_subject(F.lit("global"), F.lit("default"), F.lit("orders"))).first()[0] == "dataplane.ingestion.received.global.default.orders"


def test_signature_does_not_depend_on_order_and_sees_every_change(spark):
    b, r = fx.bindings(spark), fx.runtimes(spark)
    sign = lambda x, y: topology.runtime_signature(x, y).first()[0]
    first = sign(b, r)
    assert sign(b.orderBy(F.desc("topic")), r.orderBy(F.desc("scope_key"))) == first
    changed = r.withColumn("artifact", F.col("artifact").withField("checksum", F.lit("x")))
    assert sign(b, changed) != first and sign(b, r.limit(1)) != first and sign(b.limit(0), r.limit(0)) == ""


def test_drift_of_bindings_and_runtimes(spark):
    b, r = fx.bindings(spark), fx.runtimes(spark)
    assert topology.runtime_drift(b, r).isEmpty() and topology.stale_runtimes(b, r).isEmpty()
    assert [x.problem for x in topology.runtime_drift(b, r.where("scope_kind = 'global'")).collect()] == ["runtime_missing"]
    assert [x.problem for x in topology.runtime_drift(b.where("scope_kind = 'global'"), r).collect()] == ["runtime_without_binding"]


def test_fan_out_to_all_bindings_of_a_topic(spark):
    row = spark.createDataFrame([(" events.purchase ", "k", "{}", {" X-Correlation-Id ": " c "}, 0, 7, None, 7), ("events.error", None, "{}", None, 0, 8, None, 8), (" ", "k", "", {}, -1, -1, None, 9)],
                                "topic string, key string, payload string, headers map<string,string>, partition int, offset long, published_at timestamp, seq long")
    ok, bad = ingest.normalize_records(row)
    assert [i.field for i in bad.first().problem.issues] == ["topic", "payload", "partition", "offset"]
    m, lost = ingest.route_records(ok, fx.bindings(spark))
    assert sorted((r.message_id, r.correlation_id) for r in m.collect()) == [("kafka:events.purchase:0:7:global:default:ver-a:purchases", "c"), ("kafka:events.purchase:0:7:tenant:br:ver-b:purchases", "c")]
    assert lost.first().topic == "events.error"
    assert m.join(ingest.route_records(ok, fx.bindings(spark), most_broadcast=0)[0], ["message_id"]).count() == 2


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "id int, a string, b int")
    c = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 2)], "id int, a string, b int")
    got = {r.id: (r.change, list(r.changed)) for r in drift.snapshot_diff(a, c, ["id"]).collect()}
    assert got == {2: ("modified", ["b"]), 3: ("removed", []), 4: ("added", [])}
    assert drift.drift_verdict(spark.createDataFrame([], "severity string")).first().verdict == "clean"
