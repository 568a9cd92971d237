"""Keyed streams held against plain folds: turns, incidents that are taken back, waits, topics, resume; and as-of joins."""

from __future__ import annotations

import datetime
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brookcheck.operators import asof, history, results
from brookcheck.plans import fixtures as fx
from brookcheck.plans import streams
from brookcheck.streaming import incidents, live, pipeline, redelivery
from brookcheck.streaming.runtime_state import _advance

DATA = "/root/testdata/sf0.001"


class Map:
    def __init__(self):
        self.held = {}
        self.updateValue = lambda k, v: self.held.__setitem__(k, v)
        self.getValue = self.held.__getitem__
        self.containsKey = self.held.__contains__
        self.removeKey = lambda k: self.held.pop(k, None)
        self.iterator = lambda: iter(list(self.held.items()))


class List:
    def __init__(self):
        self.held = []
        self.get = lambda: iter(list(self.held))
        self.exists = lambda: bool(self.held)
        self.clear = lambda: self.held.clear()
        self.appendList = lambda rows: self.held.extend(rows)

    def put(self, rows):
        self.held[:] = rows


class Value:
    def __init__(self):
        self.held = None
        self.exists = lambda: self.held is not None
        self.get = lambda: self.held

    def update(self, v):
        self.held = v


class Handle:
    """State in memory, timers as a list."""

    def __init__(self):
        self.timers = []
        self.getMapState = lambda *_: Map()
        self.getListState = lambda *_: List()
        self.getValueState = lambda *_: Value()
        self.registerTimer = self.timers.append


def clock(ms):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)


# --- turns ---------------------------------------------------------------------------------


def change(seq, kind, at, version):
    return dict(seq=seq, change=kind, at=at, set_id="s", version_id=version, runtime=f"r-{version}" if kind == "activated" else None, message=None)


def message(seq):
    return dict(seq=seq, change=None, at=None, set_id=None, version_id=None, runtime=None, message=f"m{seq}")


def turns(rows):
    """What each message takes, by going through all rows one by one; those before anything is loaded wait."""
    now, waiting, out = None, [], {}
    for r in sorted(rows, key=lambda r: (r["seq"], r["change"] is not None)):
        if r["change"] is None:
            if now is None:
                waiting.append(r["message"])
            else:
                out[r["message"]] = now[3]
            continue
        after = _advance(now[:3] if now else None, SimpleNamespace(**r))
        if after is None:
            now = None
        elif now is None or after is not now[:3] and after != now[:3] or after == (r["set_id"], r["version_id"], r["at"]) and r["change"] == "activated":
            now = (*after, r["runtime"]) if r["change"] == "activated" and after == (r["set_id"], r["version_id"], r["at"]) else now
        if now is not None:
            out.update(dict.fromkeys(waiting, now[3]))
            waiting = []
    return out


def made(rng, n=60):
    rows = []
    for seq in range(n):
        if rng.random() < 0.3:
            rows.append(change(seq, rng.choice(["activated", "activated", "cleared"]), rng.randrange(20), rng.choice("abc")))
        else:
            rows.append(message(seq))
    return rows


def test_messages_take_what_is_loaded_at_their_turn():
    """In micro-batches of any size, with rows of a batch in any order."""
    for seed in range(60):
        rng = random.Random(seed)
        rows, handle, got = made(rng), Handle(), {}
        op = live._Live(10**9, 10**12)
        op.init(handle)
        at = 0
        while at < len(rows):
            step = rng.randrange(1, 20)
            batch = rows[at:at + step]
            rng.shuffle(batch)
            at += step
            chunks = [pd.DataFrame(batch[:len(batch) // 2], columns=list(rows[0])), pd.DataFrame(batch[len(batch) // 2:], columns=list(rows[0]))]
            for pdf in op.handleInputRows(("tenant", "a", 0), iter(chunks), clock(at)):
                got.update(zip(pdf["message"], pdf["runtime"], strict=True))
        assert got == turns(rows)


def test_a_message_waits_no_longer_than_its_patience():
    handle = Handle()
    op = live._Live(300_000, 10**12)
    op.init(handle)
    frame = lambda *rows: iter([pd.DataFrame(list(rows), columns=list(message(0)))])
    assert list(op.handleInputRows(("t", "a", 0), frame(message(1)), clock(1000))) == []
    assert list(op.handleInputRows(("t", "a", 0), frame(message(2)), clock(200_000))) == []
    assert handle.timers == [301_000]
    out = pd.concat(op.handleExpiredTimer(("t", "a", 0), clock(301_000), None))
    assert out["message"].tolist() == ["m1"] and out["runtime"].tolist() == [None]
    assert handle.timers[-1] == 500_000
    out = pd.concat(op.handleInputRows(("t", "a", 0), frame(change(3, "activated", 1, "v")), clock(400_000)))
    assert out[["message", "runtime"]].values.tolist() == [["m2", "r-v"]]
    assert list(op.handleExpiredTimer(("t", "a", 0), clock(500_000), None)) == []


def test_timelines_forget_what_was_replaced_long_ago():
    op = live._Live(1000, 86_400_000)
    op.init(Handle())
    for i in range(5):
        list(op.handleInputRows(("t", "a", 0), iter([pd.DataFrame([change(i, "activated", i, "v")])]), clock(i * 50_000_000)))
    assert len(op.loaded.held) == 3


def test_turns_of_tables_equal_the_fold(spark):
    rng = random.Random(5)
    rows = {f"k{i}": made(rng, 200) for i in range(4)}
    base = datetime.datetime(2024, 1, 1)
    runtimes = fx.runtimes(spark)
    one = runtimes.limit(1).select("scope_kind", "scope_key", "set_id", "config_key", "version", "artifact", "rules", "definition_checksum", F.explode(F.array(*[F.lit(v) for v in "abc"])).alias("version_id"))
    changes = [(r["seq"], r["change"], base + datetime.timedelta(minutes=r["at"]), "Tenant ", k, "s", r["version_id"]) for k, rs in rows.items() for r in rs if r["change"]]
    messages = [(f"{k}-{r['seq']}", r["seq"], " TENANT", k) for k, rs in rows.items() for r in rs if not r["change"]]
    c = live.with_runtimes(spark.createDataFrame(changes, "seq long, change string, at timestamp, scope_kind string, scope_key string, set_id string, version_id string"), one)
    m = spark.createDataFrame(messages, "message_id string, seq long, scope_kind string, scope_key string")
    for width in (7, 1 << 20):
        got = {r.message_id: r.v for r in live.batch_turns(c, m, one, width).select("message_id", F.col("runtime.version_id").alias("v")).collect()}
        assert got == {f"{k}-{mid[1:]}": v[2:] for k, rs in rows.items() for mid, v in turns(rs).items()}


# --- incidents -----------------------------------------------------------------------------


def test_incidents_follow_results_that_are_replaced():
    """Two steps over random results of few keys, held against what the last of each key sums up to."""
    for seed in range(40):
        rng = random.Random(seed)
        rows = [dict(key=f"k{rng.randrange(8)}", seq=s, incident_key=rng.choice(["i1", "i2", None]), processed_at=rng.randrange(10), latest=f"l{s}") for s in range(60)]
        order = rows[:]
        last, parts, done = incidents._Last(), {}, {}
        last.init(Handle())
        late = rng.sample(order, len(order))  # results may come in any order
        for a in range(0, 60, 7):
            for deltas in last.handleInputRows((0,), iter([pd.DataFrame(late[a:a + 7])]), None):
                for i, own in deltas.groupby("incident_key"):
                    if i not in parts:
                        parts[i] = incidents._Part()
                        parts[i].init(Handle())
                    for out in parts[i].handleInputRows((i, 0), iter([own]), None):
                        done[i] = out.iloc[-1]
        want = {}
        for r in rows:
            want[r["key"]] = r
        for i in ("i1", "i2"):
            own = [r for r in want.values() if r["incident_key"] == i]
            if i not in done:
                assert not own
                continue
            got = done[i]
            assert got["count"] == len(own)
            if own:
                top = max(own, key=lambda r: (r["processed_at"], r["seq"]))
                assert (got.first_seen_at, got.last_seen_at, got.max_seq, got.latest) == (min(r["processed_at"] for r in own), top["processed_at"], max(r["seq"] for r in own), top["latest"])


def test_results_that_replace_each_other_in_one_batch_are_one_change():
    last = incidents._Last()
    last.init(Handle())
    rows = [dict(key="k", seq=s, incident_key="i", processed_at=s, latest=f"l{s}") for s in (2, 1, 3)]
    out = pd.concat(last.handleInputRows((0,), iter([pd.DataFrame(rows)]), None))
    assert out[["sign", "seq", "latest"]].values.tolist() == [[1, 3, "l3"]]


def test_incidents_of_a_stream_have_the_columns_of_incidents(spark):
    batch = results.incidents(fx.results(spark, DATA).limit(50))
    parts = spark.createDataFrame([("i", 0, 1, 1, 5, 5, 7, 7, '{"message_id":"m","version":3,"violations":[]}'), ("i", 1, 1, 2, 4, 9, 8, 8, '{"message_id":"n","version":3}'), ("i", 0, 2, 0, None, None, None, None, None), ("gone", 0, 1, 0, None, None, None, None, None)], incidents._PART)
    out = incidents.incidents_of(parts)
    assert out.columns == batch.columns
    assert [(r.incident_key, r["count"], r.max_seq, r.latest_message_id) for r in out.collect()] == [("i", 2, 8, "n")]


# --- redelivery ----------------------------------------------------------------------------


def test_nothing_comes_again_before_the_wait():
    handle = Handle()
    op = redelivery._Delay(30_000)
    op.init(handle)
    assert list(op.handleInputRows((0, 0), iter([pd.DataFrame({"row": ["a", "b"]})]), clock(1_000))) == []
    assert handle.timers == [31_000]
    assert [x for pdf in op.handleExpiredTimer((0, 0), clock(31_000), None) for x in pdf["row"]] == ["a", "b"]
    assert list(op.handleExpiredTimer((0, 0), clock(61_000), None)) == []


def test_ten_deliveries_at_most(spark):
    problem = "struct<code:string,message:string,retryable:boolean,details:map<string,string>>"
    df = spark.createDataFrame([("m", ("X", "x", True, {}), 1), ("fatal", ("X", "x", False, {}), 1)], f"id string, problem {problem}, attempt int")
    tries = 1
    while True:
        df, given_up = results.retry_rejects(df)
        if df.isEmpty():
            break
        tries += 1
    assert tries == 10 and [r.id for r in given_up.collect()] == ["m"]


# --- life of a query -----------------------------------------------------------------------


def test_a_query_follows_the_topics():
    class Query:
        def __init__(self, topics):
            self.topics, self.stopped, self.failed = topics, False, None

        def exception(self):
            return self.failed

        def stop(self):
            self.stopped = True

    asked, queries, waits = [[], ["b", "a"], ["a", "b"], ["a", "c"], ["a", "c"]], [], []

    def start(names):
        queries.append(Query(names))
        return queries[-1]

    sets = pipeline.follow_topics(start, lambda: asked.pop(0), 30.0, lambda: not asked, waits.append)
    assert sets == [[], ["a", "b"], ["a", "c"]] and waits == [30.0] * 4
    assert [q.topics for q in queries] == [["a", "b"], ["a", "c"]] and all(q.stopped for q in queries)
    queries.clear()

    def broken(names):
        q = start(names)
        q.failed = RuntimeError("lost")
        return q

    with pytest.raises(RuntimeError):
        pipeline.follow_topics(broken, lambda: ["a"], 1.0)


@pytest.mark.parametrize("name", ["resumed_results", "follow_topics"])
def test_nothing_is_lost_or_twice(spark, name):
    got = sorted(map(tuple, getattr(streams, name)(spark, DATA).collect()))
    want = results.latest_results(fx.results(spark, DATA)).select("processing_key", "status", streams.violations_text())
    assert got == sorted(map(tuple, want.collect()))


def test_followed_topics_come_in_bounded_batches(spark, monkeypatch):
    """Many records of few topics are more than one micro-batch for each query, none of which holds more than its files may."""
    monkeypatch.setattr(streams, "_MOST_RECORDS", 10, raising=False)
    outs, committed = [], pipeline.committed
    monkeypatch.setattr(pipeline, "committed", lambda spark, out, name: outs.append(out) or committed(spark, out, name))
    streams.follow_topics(spark, DATA)
    batches = [r.records for r in spark.read.parquet(f"{outs[0]}/manifest").collect()]
    assert len(batches) > 2 and max(batches) <= 10 * 9 * spark.sparkContext.defaultParallelism and sum(batches) >= 800


def test_large_parts_are_written_for_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert streams._files(spark, DATA, 2) == 1 and 1 < streams._files(spark, "/root/testdata/sf0.1", 2) <= 3 * cores and streams._salts(spark) >= cores


# --- as-of joins ---------------------------------------------------------------------------


def test_as_of_equals_a_search(spark):
    rng = random.Random(8)
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 50)]), i) for i in range(80)]
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-60, 60)]), i) for i in range(200)]
    r = spark.createDataFrame(right, "k string, s long, seq long")
    df = spark.createDataFrame(left, "k string, t long, id long")
    for width in (1, 9, 1000):
        got = {x.id: x.m for x in asof.as_of(df, r, ["k"], F.col("t"), F.col("s"), [F.col("seq")], width, "m").select("id", F.col("m.seq").alias("m")).collect()}
        want = {i: max(((s, q) for k2, s, q in right if k2 == k is not None and None not in (s, t) and s <= t), default=(0, None))[1] for k, t, i in left}
        assert got == want
    assert asof.as_of(df, r.limit(0), ["k"], F.col("t"), F.col("s"), [F.col("seq")], 5, "m").where("m is not null").count() == 0


def test_no_scope_is_windowed_as_a_whole(spark, capsys):
    e = fx.config_events(spark, DATA)
    history.deactivation_conflicts(e).explain()
    for line in capsys.readouterr().out.splitlines():
        if "windowspecdefinition(scope_kind" in line.replace(" ", "").lower():
            assert "bucket" in line
