"""The runtime that each scope has loaded, from a stream of changes or from a batch of them.

Changes have seq, change (activated or cleared), at, scope_kind, scope_key,
set_id and version_id.  An activation as new as the current one or newer replaces it, an older
one is ignored; a clearing counts only for the current set and version, and
not if it is older than the activation.

A scope may hold a great share of all changes.  So each micro-batch is thinned first, in parts that know
no scope as a whole: a change is left out where the same part has a later activation of its scope that is as new or
newer.  Whatever had come of it, that activation finds nothing newer and replaces it.
"""

from __future__ import annotations

import datetime
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "scope_kind string, scope_key string, set_id string, version_id string, activated_at timestamp, loaded_at timestamp"


#: Changes that are sorted in memory at a time; of more, sorted runs are merged from files.
RUN = 50_000
_STEP = ["seq", "change", "at", "set_id", "version_id"]
#: Changes that are thinned at a time.
THIN = 200_000


def _advance(now: tuple | None, r) -> tuple | None:
    """The state (set_id, version_id, at) after a change; a time that is missing is neither newer nor older."""
    if r.change == "activated":
        return (r.set_id, r.version_id, r.at) if now is None or (now[2] is not None and r.at is not None and now[2] <= r.at) else now
    if now is None or now[2] is None or r.at is None or None in now[:2]:
        return now
    return None if (now[0], now[1]) == (r.set_id, r.version_id) and now[2] <= r.at else now


def _order(r):
    return tuple((x is None, x) if x is not None else (True,) for x in (getattr(r, c) for c in _STEP))


def _in_order(rows: Iterator[Row]) -> Iterator[Row]:
    """``rows`` by seq; no more than ``RUN`` of them, and one of each run, are held at a time."""
    def read(file):
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    files, run = [], []
    for r in rows:
        run.append(r)
        if len(run) >= RUN:
            files.append(tempfile.TemporaryFile())
            for x in sorted(run, key=_order):
                pickle.dump(x, files[-1])
            run = []
    yield from heapq.merge(sorted(run, key=_order), *map(read, files), key=_order)
    for f in files:
        f.close()


def _zoned(t: datetime.datetime | None) -> datetime.datetime | None:
    """A time with its zone: rows, first state and state give times with or without."""
    return t.astimezone() if t is not None else None


class _Cache(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "set_id string, version_id string, activated_at timestamp, loaded_at timestamp")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.current.update((initialState.set_id, initialState.version_id, _zoned(initialState.activated_at), _zoned(initialState.loaded_at)))

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.current.get() if self.current.exists() else None
        before = (held[0], held[1], _zoned(held[2]), _zoned(held[3])) if held else None
        now, loaded = (before[:3], before[3]) if before else (None, None)
        for r in _in_order(rows):
            new = _advance(now, Row(**{**r.asDict(), "at": _zoned(r.at)}))
            if new is not now and new is not None:
                loaded = datetime.datetime.now(datetime.timezone.utc)
            now = new
        if now is None:
            self.current.clear()
            yield Row(scope_kind=key[0], scope_key=key[1], set_id=None, version_id=None, activated_at=None, loaded_at=None)
        else:
            self.current.update((*now, loaded))
            yield Row(scope_kind=key[0], scope_key=key[1], set_id=now[0], version_id=now[1], activated_at=now[2], loaded_at=loaded)

    def close(self) -> None:
        pass


def _outlived(pdf: pd.DataFrame) -> np.ndarray:
    """Which changes, all with seq and time, a later activation of their scope that is as new or newer makes void."""
    scope = pdf.groupby(["scope_kind", "scope_key"], dropna=False, sort=False).ngroup().to_numpy()
    seq, at = pdf["seq"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
    order = np.lexsort((seq, scope))
    scope, seq = scope[order], seq[order]
    least = np.iinfo(np.int64).min
    up = np.where((pdf["change"] == "activated").to_numpy()[order], at[order], least)
    # The newest activation from each row on, and of that what comes after all rows of the same seq.
    newest = pd.Series(up[::-1]).groupby(scope[::-1]).cummax().to_numpy()[::-1]
    edge = np.flatnonzero(np.concatenate([np.diff(scope) != 0, [True]]) | np.concatenate([np.diff(seq) != 0, [True]])) + 1
    then = np.repeat(edge, np.diff(np.concatenate([[0], edge])))
    inside = then < len(scope)
    inside[inside] = scope[then[inside]] == scope[inside]
    later = np.full(len(scope), least)
    later[inside] = newest[then[inside]]
    out = np.empty(len(scope), bool)
    out[order] = (later > least) & (at[order] <= later)
    return out


def _thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The changes of a part without those that others outlive.

    An activation without a time stays for good once it is loaded, so it counts what is loaded in between: scopes with one, of which every part
    has a copy, keep all their changes.
    """
    kept, fresh, n, odd, gone = None, [], 0, set(), tempfile.TemporaryFile()
    where = ["scope_kind", "scope_key"]

    def thin():
        nonlocal kept, fresh, n
        pdf = pd.concat([*([kept] if kept is not None else []), *fresh], ignore_index=True)
        out = _outlived(pdf)
        pickle.dump(pdf[out], gone)
        kept, fresh, n = pdf[~out], [], 0

    for pdf in batches:
        lost = pdf["odd"] & (pdf["change"] == "activated") & pdf["timeless"]
        odd.update(pdf.loc[lost, where].drop_duplicates().itertuples(index=False, name=None))
        yield pdf[pdf["odd"] & pdf["own"]]
        fresh.append(pdf[~pdf["odd"]])
        n += len(fresh[-1])
        if n >= THIN:
            thin()
            if len(kept) >= THIN:
                # Nothing much goes: these are handed on, as any part of the changes may be thinned alone.
                yield kept
                kept = None
    if n:
        thin()
    if kept is not None:
        yield kept
    if odd:
        gone.seek(0)
        while True:
            try:
                pdf = pickle.load(gone)
            except EOFError:
                break
            yield pdf[[x in odd for x in pdf[where].itertuples(index=False, name=None)]]
    gone.close()


def _thin(events: DataFrame, parts: int) -> DataFrame:
    """The changes that can tell what a scope has loaded after them."""
    odd = F.col("seq").isNull() | F.col("at").isNull()
    part = F.pmod(F.xxhash64(*_STEP), F.lit(parts)).cast("int")
    everywhere = (F.col("change") == "activated") & F.col("at").isNull()
    df = events.select("scope_kind", "scope_key", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "change", F.coalesce(F.unix_micros("at"), F.lit(0)).alias("at"), "set_id", "version_id", odd.alias("odd"),
                       F.col("seq").isNull().alias("orderless"), F.col("at").isNull().alias("timeless"), part.alias("_own"), F.explode(F.when(everywhere, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(part))).alias("part"))
    df = df.withColumn("own", F.col("part") == F.col("_own")).drop("_own")
    df = df.repartition(parts, "part").mapInPandas(_thinned, df.schema)
    null = lambda flag, c: F.when(~F.col(flag), c)
    return df.select("scope_kind", "scope_key", null("orderless", F.col("seq")).alias("seq"), "change", null("timeless", F.timestamp_micros("at")).alias("at"), "set_id", "version_id")


def runtime_state(events: DataFrame, bootstrap: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """A row for each scope that a micro-batch touches; without version where it has been cleared.

    Changes are thinned in ``parts``, three for each core where it is not given.

    loaded_at is when the current runtime was taken over; an activation that is ignored leaves it.  ``bootstrap``, a table with the columns
    of ``runtime_state_batch``, is what scopes have loaded before the first change; a query that goes on from its checkpoint does not read it again.
    """
    first = {} if bootstrap is None else {"initialState": bootstrap.where("version_id is not null").select(*[c.split()[0] for c in STATE.split(", ")]).groupBy("scope_kind", "scope_key")}
    events = _thin(events, parts or 3 * events.sparkSession.sparkContext.defaultParallelism)
    return events.groupBy("scope_kind", "scope_key").transformWithState(statefulProcessor=_Cache(), outputStructType=STATE, outputMode="update", timeMode="None", **first)


def loaded_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What each scope has loaded, read from the state that a query over ``runtime_state`` has committed; scopes that were cleared are left out."""
    df = spark.read.format("statestore").option("stateVarName", "current").load(checkpoint)
    return df.select("key.scope_kind", "key.scope_key", "value.*")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last state of each scope; rows come sorted by scope and seq, and none but the state is held."""
    scope, now = None, None
    for pdf in batches:
        out = []
        for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
            if (r.scope_kind, r.scope_key) != scope:
                if now is not None:
                    out.append((*scope, *now))
                scope, now = (r.scope_kind, r.scope_key), None
            now = _advance(now, r)
        yield pd.DataFrame(out, columns=["scope_kind", "scope_key", "set_id", "version_id", "activated_at"])
    if now is not None:
        yield pd.DataFrame([(*scope, *now)], columns=["scope_kind", "scope_key", "set_id", "version_id", "activated_at"])


def runtime_state_batch(events: DataFrame, loaded_at: datetime.datetime | None = None) -> DataFrame:
    """The state after all changes in the order of seq; scopes without a runtime are left out.

    loaded_at is now, unless it is given.

    The newest activation of a scope replaces whatever is current when it comes,
    and nothing but a clearing removes it: both are aggregates that are combined
    before the shuffle.  Only changes that follow such a clearing, where an older
    activation may have come late, and scopes with a missing time or seq are
    folded row by row.
    """
    by = ["scope_kind", "scope_key"]
    e = events.select(*by, *_STEP).withColumn("o", F.struct(*_STEP))
    up = F.col("change") == "activated"
    newest = e.groupBy(*by).agg(F.max(F.when(up, F.struct("at", "o"))).alias("top"), F.max(F.col("at").isNull() | F.col("seq").isNull()).alias("odd"))
    top = newest.select(F.col("scope_kind").alias("k"), F.col("scope_key").alias("y"), F.col("top.at").alias("a"), F.col("top.o").alias("ao"), "odd").where("ao is not null")
    met = F.expr("scope_kind <=> k and scope_key <=> y")
    clear = e.where(~up).join(top, met & ~F.col("odd") & (F.col("set_id") == F.col("ao.set_id")) & (F.col("version_id") == F.col("ao.version_id")) & (F.col("at") >= F.col("a")) & (F.col("o") > F.col("ao")))
    clear = clear.groupBy(*by).agg(F.min("o").alias("c")).select(F.col("scope_kind").alias("ck"), F.col("scope_key").alias("cy"), "c")
    known = top.join(clear, F.expr("ck <=> k and cy <=> y"), "left").select("k", "y", "ao", "odd", "c")
    out = known.where("c is null and not odd").select(F.col("k").alias("scope_kind"), F.col("y").alias("scope_key"), "ao.set_id", "ao.version_id", F.col("ao.at").alias("activated_at"))
    # An activation that came after the clearing is older than the one cleared.
    late = e.join(known.where("c is not null or odd").select("k", "y", "c", "odd"), met & (F.col("odd") | (F.col("o") > F.col("c")))).select(*by, *_STEP)
    late = late.repartition(*by).sortWithinPartitions(*by, *[F.asc_nulls_last(c) for c in _STEP])
    folded = late.mapInPandas(_fold, STATE.rpartition(",")[0])
    return out.unionByName(folded).withColumn("loaded_at", F.current_timestamp() if loaded_at is None else F.lit(loaded_at))


def active_runtime(state: DataFrame, kind: str = "", key: str = "") -> DataFrame:
    k, y = (kind or "").strip().lower() or "global", (key or "").strip() or "default"
    return state.where((F.col("scope_kind") == k) & (F.col("scope_key") == y) & F.col("version_id").isNotNull())
