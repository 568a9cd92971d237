"""Incidents that follow the stream of results, also where a later result takes back what an earlier one said.

Results of one processing key replace each other, the greatest seq standing.  The first step keeps the
last result of each key and says what changes: minus what counted before, plus what counts now.  The
second keeps, for an incident and a part of the keys, the results that make it up, and their count, first
and last time and latest attributes.  These parts are what the query puts out; ``incidents_of`` puts
the last ones of each incident together.  An incident with a third of all failures is spread over ``salts`` parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.results import KIND, OPEN, incident_key
from ..operators.validate import processing_key
from ..schemas import VIOLATION

_LATEST = ["message_id", "correlation_id", "processing_key", "binding_name", "topic", "scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "definition_checksum", "violations"]
_SHAPE = ", ".join(f"{c} {'bigint' if c == 'version' else f'array<{VIOLATION}>' if c == 'violations' else 'string'}" for c in _LATEST)
_DELTA = "incident_key string, salt int, key string, sign int, turn long, processed_at long, seq long, latest string"
_PART = "incident_key string, salt int, n long, count long, first_seen_at long, last_seen_at long, last_seq long, max_seq long, latest string"


def _rows(chunks: Iterator[pd.DataFrame], order: list[str], last_of: str | None = None) -> Iterator[tuple]:
    """Rows of one key in a micro-batch, in order; with ``last_of`` only the last of each value of that column."""
    pdf = pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable")
    return (pdf if last_of is None else pdf.drop_duplicates(last_of, keep="last")).itertuples(index=False)


class _Last(StatefulProcessor):
    """Keeps the last result of each processing key of one part and puts out what changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "key string", "seq long, incident_key string, processed_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        # Of a key's results in one micro-batch the last alone stays: what it replaces cancels out.
        for r in _rows(rows, ["seq"], "key"):
            before = tuple(self.last.getValue((r.key,))) if self.last.containsKey((r.key,)) else None
            if before is not None and before[0] > r.seq:
                continue
            new = None if pd.isna(r.incident_key) else r.incident_key
            if before is not None and before[1] is not None:
                out.append((before[1], key[0], r.key, -1, r.seq, before[2], before[0], None))
            if new is not None:
                out.append((new, key[0], r.key, 1, r.seq, r.processed_at, r.seq, r.latest))
            self.last.updateValue((r.key,), (int(r.seq), new, int(r.processed_at)))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DELTA.split(", ")])

    def close(self) -> None:
        pass


class _Part(StatefulProcessor):
    """Keeps the results that make up a part of an incident, and what they sum up to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "key string", "processed_at long, seq long, latest string")
        self.sums = handle.getValueState("sums", "n long, count long, first long, last long, last_seq long, max_seq long, latest string")

    @staticmethod
    def _with(s: tuple | None, at: int, seq: int, latest: str) -> tuple:
        """(count, first, last, last_seq, max_seq, latest) with a result more."""
        if s is None or s[0] == 0:
            return 1, at, at, seq, seq, latest
        newer = (at, seq) >= (s[2], s[3])
        return s[0] + 1, min(s[1], at), *((at, seq) if newer else s[2:4]), max(s[4], seq), latest if newer else s[5]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = tuple(self.sums.get()) if self.sums.exists() else (0, 0, None, None, None, None, None)
        n, s, again = held[0], held[1:], False
        for r in _rows(rows, ["turn", "sign"]):
            if r.sign > 0:
                self.members.updateValue((r.key,), (int(r.processed_at), int(r.seq), r.latest))
                s = s if again else self._with(s, int(r.processed_at), int(r.seq), r.latest)
            else:
                self.members.removeKey((r.key,))
                # What was first, last or newest is gone: the rest is gone through once, at the end.
                again = again or s[0] <= 1 or r.processed_at == s[1] or (r.processed_at, r.seq) == (s[2], s[3]) or r.seq == s[4]
                s = s if again else (s[0] - 1, *s[1:])
        if again:
            s = (0, None, None, None, None, None)
            for _, v in self.members.iterator():
                s = self._with(s, int(v[0]), int(v[1]), v[2])
        self.sums.update((n + 1, *s))
        yield pd.DataFrame([(key[0], int(key[1]), n + 1, *s)], columns=[c.split()[0] for c in _PART.split(", ")]).astype({c: "Int64" for c in ("first_seen_at", "last_seen_at", "last_seq", "max_seq")})

    def close(self) -> None:
        pass


def incident_parts(results: DataFrame, salts: int = 16) -> DataFrame:
    """Parts of incidents that change, from a stream of results with ``seq``; write with output mode append."""
    key = F.coalesce(F.nullif(processing_key(F.col("processing_key")), F.lit("")), F.col("message_id"))
    failed = F.when(F.col("status") == "failed", incident_key())
    df = results.select(F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"), key.alias("key"), "seq", failed.alias("incident_key"), F.unix_micros("processed_at").alias("processed_at"), F.to_json(F.struct(*_LATEST)).alias("latest"))
    deltas = df.groupBy("salt").transformWithStateInPandas(statefulProcessor=_Last(), outputStructType=_DELTA, outputMode="Append", timeMode="None")
    return deltas.groupBy("incident_key", "salt").transformWithStateInPandas(statefulProcessor=_Part(), outputStructType=_PART, outputMode="Append", timeMode="None")


def incidents_of(parts: DataFrame) -> DataFrame:
    """The incidents, with the columns that ``incidents`` gives, of all parts that were put out."""
    last = parts.groupBy("incident_key", "salt").agg(F.max_by(F.struct("count", "first_seen_at", "last_seen_at", "last_seq", "max_seq", "latest"), "n").alias("p")).select("incident_key", "p.*").where("count > 0")
    df = last.groupBy("incident_key").agg(F.sum("count").alias("count"), F.timestamp_micros(F.min("first_seen_at")).alias("first_seen_at"), F.timestamp_micros(F.max("last_seen_at")).alias("last_seen_at"), F.max("max_seq").alias("max_seq"), F.max_by("latest", F.struct("last_seen_at", "last_seq")).alias("latest"))
    df = df.withColumn("l", F.from_json("latest", _SHAPE))
    return df.select("incident_key", F.lit(KIND).alias("kind"), F.lit(OPEN).alias("status"), "count", "first_seen_at", "last_seen_at", "max_seq", F.col("l.message_id").alias("latest_message_id"), F.col("l.correlation_id").alias("latest_correlation_id"), F.col("l.processing_key").alias("latest_processing_key"), *[f"l.{c}" for c in _LATEST[3:]])
