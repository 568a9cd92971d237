"""Messages judged by the runtime that is loaded at their turn, in one stateful query over changes and messages.

Both carry ``seq``, the order in which they arrive.  Each scope keeps the timeline of what it had loaded.  A message
takes what was loaded before it; one that comes while nothing is loaded waits
for the next activation, and after ``patience`` without any it goes on without a runtime, which
makes it a reject.  A message that comes late is held against the timeline as it was at its seq; a change that comes late
acts when it comes.  Timelines go back ``history``.

Changes are few and messages many, so each scope has ``salts`` keys: messages are dealt to them by hash, and every change goes to all.  A scope with a
third of all messages is thus worked on by as many tasks.  A task holds one micro-batch's messages of a key, which the source's
rate limit bounds; waiting ones lie in the state store.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.asof import as_of
from ..operators.history import scope
from ..operators.validate import judge_resolved, runtime_struct
from .runtime_state import _advance, _order

_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_TURN = "scope_kind string, scope_key string, salt int, seq long, message string, runtime string, waited boolean"
_LOW = -(1 << 62)


def with_runtimes(changes: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Changes with ``runtime``, what messages need of the version that is activated, as JSON; ``runtimes`` may hold any versions."""
    r = runtimes.select(F.col("version_id").alias("_version"), F.to_json(runtime_struct(runtimes), _FORMAT).alias("runtime"))
    return changes.join(r, changes["version_id"] == F.col("_version"), "left").drop("_version")


class Timeline:
    """What a scope had loaded from which seq on: (seq, (set_id, version_id, at, runtime), loaded_at in ms), without version where it was cleared."""

    def __init__(self, entries: list[tuple] = ()):
        self.entries = sorted(entries, key=lambda e: e[0])

    def apply(self, changes: list, now: int = 0) -> list[tuple]:
        """Takes changes in the order of seq and returns the entries that are new."""
        new = []
        for r in sorted(changes, key=_order):
            top = self.entries[-1][1] if self.entries else None
            before = top[:3] if top is not None and top[1] is not None else None
            after = _advance(before, r)
            if after is not before:
                seq = max(r.seq, self.entries[-1][0]) if self.entries else r.seq
                self.entries.append((seq, (*after, r.runtime) if after else (None, None, r.at, None), now))
                new.append(self.entries[-1])
        return new

    def at(self, seq: int) -> tuple[bool, str | None, bool]:
        """(known, runtime, waited) for a message at ``seq``."""
        i = bisect_left(self.entries, seq, key=lambda e: e[0]) - 1
        if i >= 0 and self.entries[i][1][1] is not None:
            return True, self.entries[i][1][3], False
        later = next((e for e in self.entries[i + 1:] if e[1][1] is not None), None)
        return (True, later[1][3], True) if later else (False, None, True)


def _changes_of(pdf: pd.DataFrame) -> list:
    none = lambda x: None if pd.isna(x) else x
    return [SimpleNamespace(seq=int(r.seq), change=r.change, at=None if pd.isna(r.at) else int(r.at), set_id=none(r.set_id), version_id=none(r.version_id), runtime=none(r.runtime)) for r in pdf.itertuples(index=False)]


class _Live(StatefulProcessor):
    def __init__(self, patience: int, history: int):
        self.patience, self.history = patience, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loaded = handle.getMapState("timeline", "seq long", "set_id string, version_id string, at long, runtime string, loaded_at long")
        self.waiting = handle.getListState("waiting", "seq long, message string, since long")

    def _emit(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """rows: (seq, message, runtime, waited)."""
        if rows:
            out = pd.DataFrame(rows, columns=["seq", "message", "runtime", "waited"], dtype=object).astype({"seq": "int64", "waited": "bool"})
            out.insert(0, "salt", int(key[2]))
            out.insert(0, "scope_key", key[1])
            out.insert(0, "scope_kind", key[0])
            yield out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        changes, messages = [], []
        for pdf in rows:
            is_change = pdf["change"].notna()
            changes += _changes_of(pdf[is_change])
            messages.append(pdf.loc[~is_change, ["seq", "message"]])
        now = timer_values.getCurrentProcessingTimeInMs()
        line = Timeline([(int(k[0]), tuple(v[:4]), int(v[4])) for k, v in self.loaded.iterator()])
        for seq, value, at in line.apply(changes, now):
            self.loaded.updateValue((seq,), (*value, at))
        # What was replaced longer ago than messages may be late is forgotten.
        for (seq, _, _), (_, _, replaced) in zip(line.entries[:-1], line.entries[1:], strict=True):
            if replaced + self.history < now:
                self.loaded.removeKey((seq,))
        held = [(int(s), m, int(t)) for s, m, t in self.waiting.get()] if changes and self.waiting.exists() else []
        still, out = [], []
        for s, m, t in held:
            known, runtime, waited = line.at(s)
            (out if known else still).append((s, m, runtime, waited) if known else (s, m, t))
        if held:
            self.waiting.clear()
            if still:
                self.waiting.put(still)
        yield from self._emit(key, out)
        for pdf in messages:
            out, wait = [], []
            for s, m in zip(pdf["seq"].tolist(), pdf["message"].tolist(), strict=True):
                known, runtime, waited = line.at(int(s))
                (out if known else wait).append((s, m, runtime, waited) if known else (int(s), m, now))
            if wait:
                if not self.waiting.exists():
                    self.handle.registerTimer(now + self.patience)
                self.waiting.appendList(wait)
            yield from self._emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = [(int(s), m, int(t)) for s, m, t in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        still = [x for x in held if x[2] + self.patience > now]
        if still:
            self.waiting.put(still)
            self.handle.registerTimer(min(x[2] for x in still) + self.patience)
        yield from self._emit(key, [(s, m, None, True) for s, m, t in held if t + self.patience <= now])

    def close(self) -> None:
        pass


def _sides(changes: DataFrame, messages: DataFrame, salts: int) -> DataFrame:
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    text = lambda c: F.lit(None).cast("string").alias(c)
    own = [kind.alias("scope_kind"), key.alias("scope_key")]
    c = changes.select(*own, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "seq", "change", F.unix_micros("at").alias("at"), "set_id", "version_id", "runtime", text("message"))
    m = messages.select(*own, F.pmod(F.xxhash64("message_id"), F.lit(salts)).cast("int").alias("salt"), "seq", text("change"), F.lit(None).cast("long").alias("at"), text("set_id"), text("version_id"), text("runtime"), F.to_json(F.struct(*messages.columns), _FORMAT).alias("message"))
    return c.unionByName(m)


def _unpacked(turns: DataFrame, messages: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Messages with ``runtime`` as ``resolve_runtimes`` gives it, and ``waited``."""
    shape = runtimes.select(runtime_struct(runtimes).alias("r")).schema["r"].dataType
    m = F.from_json("message", messages.schema, _FORMAT).alias("m")
    return turns.select(m, F.from_json("runtime", shape, _FORMAT).alias("runtime"), "waited").select("m.*", "runtime", "waited")


def live_turns(changes: DataFrame, messages: DataFrame, runtimes: DataFrame, salts: int = 16, patience: float = 300, history: float = 86_400) -> DataFrame:
    """Messages with the runtime of their turn, from two streams; write with output mode append.

    ``changes`` are those of ``runtime_state`` with ``runtime`` (see ``with_runtimes``); of ``runtimes`` only the schema is read.
    ``patience`` and ``history`` are seconds of processing time.
    """
    sides = _sides(changes, messages, salts).groupBy("scope_kind", "scope_key", "salt")
    turns = sides.transformWithStateInPandas(statefulProcessor=_Live(int(patience * 1000), int(history * 1000)), outputStructType=_TURN, outputMode="Append", timeMode="ProcessingTime")
    return _unpacked(turns, messages, runtimes)


def _timelines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From which seq on a scope's messages take which runtime; rows come sorted by scope and seq, and none but the last state is held."""
    names = ["scope_kind", "scope_key", "start", "runtime", "waited"]
    where, line, since = None, None, None
    for pdf in batches:
        out = []
        for r, c in zip(pdf.itertuples(index=False), _changes_of(pdf), strict=True):
            if (r.scope_kind, r.scope_key) != where:
                where, line, since = (r.scope_kind, r.scope_key), Timeline(), _LOW
            for seq, value, _ in line.apply([c]):
                if value[1] is None:
                    since = seq
                    continue
                if since is not None:
                    out.append((*where, since, value[3], True))
                out.append((*where, seq, value[3], False))
                since = None
            # A scope that stays cleared has nothing for later messages.
            line.entries = line.entries[-1:]
            if since not in (None, _LOW):
                out.append((*where, since, None, True))
        yield pd.DataFrame(out, columns=names, dtype=object).astype({"start": "int64", "waited": "bool"})


def batch_turns(changes: DataFrame, messages: DataFrame, runtimes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The same of tables: messages with the runtime of their turn; those whose scope has nothing loaded until the end are left out, as they wait."""
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    c = changes.withColumns({"scope_kind": kind, "scope_key": key}).select("scope_kind", "scope_key", "seq", "change", F.unix_micros("at").alias("at"), "set_id", "version_id", "runtime")
    c = c.repartition("scope_kind", "scope_key").sortWithinPartitions("scope_kind", "scope_key", *[F.asc_nulls_last(x) for x in ("seq", "change", "at", "set_id", "version_id")])
    lines = c.mapInPandas(_timelines, "scope_kind string, scope_key string, start long, runtime string, waited boolean")
    # Of entries with one start the last stands: one that ends a wait after one that only begins it.
    lines = lines.groupBy("scope_kind", "scope_key", "start").agg(F.max_by(F.struct("runtime", "waited"), F.col("runtime").isNotNull()).alias("r")).select("scope_kind", "scope_key", "start", "r.*")
    m = messages.select(F.struct(*messages.columns).alias("m"), kind.alias("scope_kind"), key.alias("scope_key"), "seq")
    met = as_of(m, lines, ["scope_kind", "scope_key"], F.col("seq") - 1, F.col("start"), [F.col("start")], width, "turn").where("turn.runtime is not null")
    shape = runtimes.select(runtime_struct(runtimes).alias("r")).schema["r"].dataType
    return met.select("m.*", F.from_json("turn.runtime", shape, _FORMAT).alias("runtime"), F.col("turn.waited").alias("waited"))


def judge_turns(turns: DataFrame, mode: str = "plain") -> DataFrame:
    """Messages at their turn with ``valid``, ``problem``, ``violations`` and the runtime's identity, as ``judge_messages`` gives them."""
    return judge_resolved(turns.drop("waited"), mode)
