"""The same records as a batch and as a stream give the same results."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brookcheck.operators import results
from brookcheck.plans import fixtures as fx
from brookcheck.schemas import RECORD
from brookcheck.sources.files import read_records
from brookcheck.streaming import runtime_state
from brookcheck.streaming.pipeline import Topology, incidents_stream, process, start_pipeline

DATA = "/root/testdata/sf0.001"


def test_batch_and_stream_agree(spark, tmp_path):
    src = str(tmp_path / "in")
    fx.records(spark, DATA).drop("seq").repartition(3).write.parquet(src)
    b, r = fx.bindings(spark), fx.runtimes(spark)
    topics = [f"events.{t}" for t in ("click", "view", "purchase", "signup", "error")]
    stream = read_records(spark, {"format": "parquet", "path": src}, topics, streaming=True)
    start_pipeline(stream, lambda: (b, r), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    batch = read_records(spark, {"format": "parquet", "path": src}, topics).withColumn("seq", F.col("offset"))
    messages, want, rejects = process(batch, b, r)
    got = spark.read.parquet(str(tmp_path / "out/results"))
    key = ["processing_key", "status"]
    a, c = (sorted(results.latest_results(x).select(*key).collect()) for x in (got, want))
    assert a == c and len(a) > 100
    assert spark.read.parquet(str(tmp_path / "out/messages")).count() == messages.count()
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == rejects.count()
    # A second start finds nothing new.
    start_pipeline(stream, lambda: (b, r), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == got.count()


def test_a_failing_refresh_keeps_the_last_topology_and_equal_ones_are_not_swapped(spark):
    b, r = fx.bindings(spark), fx.runtimes(spark)
    asked = [(b, r), ValueError("down"), (b.repartition(3), r), (b, r.where("scope_kind = 'global'")), ValueError("down")]
    now = [0.0]

    def refresh():
        got = asked.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    t = Topology(refresh, interval=10, clock=lambda: now[0])
    first = t.current()
    now[0] = 9.0
    assert t.current() is first and len(asked) == 4  # not yet time
    for at, swaps, failed, left in ((10.0, 1, True, 2), (20.0, 1, False, 2), (30.0, 2, False, 1), (40.0, 2, True, 1)):
        now[0] = at
        loaded = t.current()
        assert (t.swaps, t.failure is not None, loaded[1].count()) == (swaps, failed, left)
    with pytest.raises(ValueError):
        Topology(lambda: 1 / 0 if False else (_ for _ in ()).throw(ValueError("first"))).current()


def test_loaded_at_is_kept_while_an_older_activation_is_ignored(spark):
    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, x):
            self.value = x

        def clear(self):
            self.value = None

    class Handle:
        getValueState = lambda self, name, schema: Held()

    names = [c.split()[0] for c in CHANGE.split(", ")]
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    row = lambda seq, change, m, v: Row(**dict(zip(names, (seq, change, at(m), "tenant", "a", "set", v), strict=True)))
    cache = runtime_state._Cache()
    cache.init(Handle())
    one = next(cache.handleInputRows(("tenant", "a"), iter([row(1, "activated", 30, "new")]), None))
    two = next(cache.handleInputRows(("tenant", "a"), iter([row(2, "activated", 15, "old")]), None))
    assert one.loaded_at is not None and (two.version_id, two.loaded_at) == ("new", one.loaded_at)
    three = next(cache.handleInputRows(("tenant", "a"), iter([row(3, "activated", 40, "newer")]), None))
    assert three.version_id == "newer" and three.loaded_at >= one.loaded_at
    gone = next(cache.handleInputRows(("tenant", "a"), iter([row(4, "cleared", 41, "newer")]), None))
    assert gone.version_id is None and gone.loaded_at is None
    given = runtime_state.runtime_state_batch(spark.createDataFrame([row(1, "activated", 30, "new")], CHANGE), at(50)).first()
    assert given.loaded_at == at(50)


def test_redeliveries_are_dropped_in_the_window_and_incidents_grow(spark, tmp_path):
    src = str(tmp_path / "in")
    fx.results(spark, DATA).write.parquet(src)
    schema = spark.read.parquet(src).schema
    from brookcheck.operators.ingest import dedup_messages

    stream = dedup_messages(spark.readStream.schema(schema).parquet(src), "2 minutes", "processing_key", "processed_at")
    q = incidents_stream(stream).writeStream.format("memory").queryName("inc").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    last = spark.table("inc").groupBy("incident_key").agg(F.max("count").alias("count"))
    want = results.incidents(results.latest_results(fx.results(spark, DATA))).select("incident_key", "count")
    assert sorted(last.collect()) == sorted(want.collect())


def _changes(n, scopes=5, seed=3):
    r = random.Random(seed)
    at = lambda: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=r.randrange(40))
    return [(i, r.choice(("activated", "cleared")), at() if scope % 4 or i % 7 else None, "tenant", f"s{scope}", f"set{r.randrange(2)}", f"v{r.randrange(2)}") for i in range(n) for scope in [r.randrange(scopes)]]


CHANGE = "seq long, change string, at timestamp, scope_kind string, scope_key string, set_id string, version_id string"


def _folded(rows):
    state = {}
    for r in sorted(rows):
        now = state.get(r[4])
        if r[1] == "activated":
            if now is None or (now[2] and r[2] and now[2] <= r[2]):
                state[r[4]] = (r[5], r[6], r[2])
        elif now is not None and now[2] and r[2] and now[:2] == r[5:7] and now[2] <= r[2]:
            state[r[4]] = None
    return sorted((k, *v) for k, v in state.items() if v)


def test_runtime_state_equals_the_fold_without_gathering_a_scope(spark, capsys):
    for seed in range(4):
        rows = _changes((60, 25, 400, 9)[seed], seed=seed, scopes=(5, 9, 7, 4)[seed])
        df = spark.createDataFrame(rows, CHANGE)
        out = runtime_state.runtime_state_batch(df)
        assert sorted(tuple(r)[1:5] for r in out.collect()) == _folded(rows)
    out.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_changes_are_ordered_by_runs(monkeypatch):
    monkeypatch.setattr(runtime_state, "RUN", 7)
    rows = [Row(**dict(zip([c.split()[0] for c in CHANGE.split(", ")], x, strict=True))) for x in _changes(50)]
    random.Random(1).shuffle(rows)
    assert [r.seq for r in runtime_state._in_order(iter(rows))] == list(range(50))


def test_record_schema():
    assert RECORD.startswith("topic string")
