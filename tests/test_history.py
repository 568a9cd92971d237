from __future__ import annotations

import datetime

from brookcheck.operators import history as H
from brookcheck.streaming.runtime_state import runtime_state, runtime_state_batch

EVENT = "seq long, event string, occurred_at timestamp, set_id string, config_key string, version_id string, version long, scope_kind string, scope_key string, activated_at timestamp, deactivated_at timestamp"


def at(m):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)


def log(spark, *steps):
    rows = [(i, f"config.{e}", at(m), "s", "k", v, 1, k, y, at(m) if e == "activated" else None, at(m) if e == "deactivated" else None) for i, (m, e, v, k, y) in enumerate(steps)]
    return spark.createDataFrame(rows, EVENT)


def life(*events, v="v1", k="global", y="default"):
    return [(i, e, v, k, y) for i, e in enumerate(events)]


def test_lifecycle_ends_inactive(spark):
    e = log(spark, *life("draft_created", "validated", "compiled", "activated", "deactivated"))
    assert H.current_lifecycle(e).first().lifecycle == "inactive" and H.audit_transitions(e).isEmpty()
    assert [c.change for c in H.runtime_changes(H.activation_intervals(e)).orderBy("at").collect()] == ["activated", "cleared"]


def test_illegal_transitions(spark):
    e = log(spark, *life("draft_created", "compiled"), *[(9, "draft_created", "v2", "", ""), (10, "archived", "v2", "", ""), (11, "validated", "v2", "", "")])
    assert sorted(H.audit_transitions(e).select("from_state", "to_state").collect()) == [("archived", "validated"), ("draft", "compiled")]


def test_superseding_closes_without_clearing(spark):
    e = log(spark, (1, "activated", "a", " Global ", ""), (5, "activated", "b", None, "default"), (9, "deactivated", "a", "global", "default"))
    iv = H.activation_intervals(e)
    assert {r.version_id: r.deactivated_at for r in iv.collect()} == {"a": at(5), "b": None}
    assert [r.version_id for r in H.active_by_scope(iv).collect()] == ["b"] and [r.version_id for r in H.active_by_scope(iv, as_of=at(3)).collect()] == ["a"]
    assert H.runtime_changes(iv).where("change = 'cleared'").isEmpty() and H.deactivation_conflicts(e).count() == 1


def test_a_version_stays_active_while_another_scope_holds_it(spark):
    e = log(spark, (1, "activated", "a", "t", "x"), (2, "activated", "a", "t", "y"), (3, "deactivated", "a", "t", "x"))
    assert H.current_lifecycle(e).first().lifecycle == "active"


CHANGE = "seq long, change string, at timestamp, scope_kind string, scope_key string, set_id string, version_id string"
CHANGES = [(1, "activated", at(30), "g", "stale", "s", "new"), (2, "activated", at(15), "g", "stale", "s", "old"), (3, "activated", at(20), "g", "evict", "s", "a"), (4, "cleared", at(19), "g", "evict", "s", "a"),
           (5, "cleared", at(25), "g", "evict", "other", "a"), (6, "activated", at(20), "g", "gone", "s", "a"), (7, "cleared", at(20), "g", "gone", "s", "a")]


def test_runtime_state_of_a_batch_and_a_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(CHANGES, CHANGE)
    want = {("stale", "new"), ("evict", "a")}
    assert {(r.scope_key, r.version_id) for r in runtime_state_batch(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = runtime_state(spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("state").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.scope_key, r.version_id) for r in spark.table("state").where("version_id is not null").collect()} == want
