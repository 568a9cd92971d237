"""Records to messages: normalise, fan out to bindings, check."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, blank, issues, last_key_wins, once, or_else, problem, trimmed, unicode_trim
from ..schemas import CONFLICT, EMPTY, INVALID, NOT_FOUND
from .topology import route_subject


def _moment(now: datetime.datetime | Column | None) -> Column:
    return F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)


def split(df: DataFrame, reject: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose problem is null, the others with ``problem``)."""
    df = df.withColumn("problem", reject)
    return df.where("problem is null").drop("problem"), df.where("problem is not null")


def normalize_records(df: DataFrame, now: datetime.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): topic, key and headers trimmed, header names in lower case, blank names dropped; published_at is now where it is null."""
    names = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(unicode_trim(e["key"])).alias("key"), unicode_trim(F.coalesce(e["value"], F.lit(""))).alias("value")))
    # Most records have no header, or one.
    none = F.array().cast("array<struct<key:string,value:string>>")
    df = once(df, _names=F.when(F.size("headers") > 0, F.filter(names, lambda e: e["key"] != "")).otherwise(none))
    later = lambda i: F.slice("_names", i + 2, F.greatest(F.size("_names") - i - 1, F.lit(0)))
    last = F.when(F.size("_names") < 2, F.col("_names")).otherwise(F.filter("_names", lambda e, i: ~F.exists(later(i), lambda o: o["key"] == e["key"])))
    out = (df.withColumn("topic", unicode_trim(F.coalesce("topic", F.lit("")))).withColumn("key", unicode_trim(F.coalesce("key", F.lit(""))))
           .withColumn("headers", F.map_from_entries(last)).withColumn("published_at", F.coalesce("published_at", _moment(now)))).drop("_names")
    return _checked(out, [("topic", F.col("topic") == "", EMPTY), ("payload", F.coalesce(F.length("payload"), F.lit(0)) == 0, EMPTY),
                          ("partition", F.col("partition") < 0, "must not be negative"), ("offset", F.col("offset") < 0, "must not be negative")], "kafka record is invalid")


def _checked(df: DataFrame, checks: list, message: str) -> tuple[DataFrame, DataFrame]:
    """(rows without a failing check, the others with ``problem``); which of them fail is told for the latter alone."""
    bad = any_of(checks)
    return df.where(~bad), df.where(bad).withColumn("problem", problem(INVALID, message, found=issues(*checks)))


def message_id(*parts: Column) -> Column:
    """``kafka:topic:partition:offset:kind:key:version_id:name``."""
    return trimmed(":", F.lit("kafka"), *[p.cast("string") for p in parts])


def _route() -> Column:
    return route_subject(F.col("scope_kind"), F.col("scope_key"), F.col("binding_name"))


def to_messages(df: DataFrame, now: datetime.datetime | None = None, source: str = "kafka") -> DataFrame:
    """Adds message_id, correlation_id, content_type, source, ingested_at and route to rows that hold a record and a binding."""
    header = lambda n: F.try_element_at("headers", F.lit(n))
    own = [F.col(c) for c in ("topic", "partition", "offset", "scope_kind", "scope_key", "version_id", "binding_name")]
    made = {"message_id": message_id(*own), "correlation_id": or_else(header("x-correlation-id")), "content_type": or_else(header("content-type"), F.lit("application/json")),
            "source": F.lower(or_else(F.lit(source), F.lit("kafka"))), "ingested_at": _moment(now) if now is not None else F.col("published_at"), "route": F.col("_route") if "_route" in df.columns else _route()}
    return once(df, **made).drop("_route").withColumn("correlation_id", F.coalesce("correlation_id", "message_id"))


BINDING = ("binding_name", "scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "definition_checksum")


def route_records(records: DataFrame, bindings: DataFrame, now: datetime.datetime | None = None, most_broadcast: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(messages, unrouted): one message for each binding of a record's topic.

    The bindings are broadcast when at most ``most_broadcast`` rows; else both
    sides are shuffled by topic.
    """
    b = bindings.select(F.col("topic").alias("_topic"), *[c for c in BINDING if c in bindings.columns], _route().alias("_route"))
    small = b.limit(most_broadcast + 1).count() <= most_broadcast
    side = F.broadcast if small else lambda x: x
    topics = side(b.select("_topic").distinct())
    hit = records.join(side(b), F.col("topic") == F.col("_topic")).drop("_topic")
    lost = records.join(topics, F.col("topic") == F.col("_topic"), "left_anti").withColumn("problem", problem(NOT_FOUND, "no active binding for topic"))
    return to_messages(hit, now), lost


def check_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects) of explicit pairs of a record (topic) and a binding (binding_topic): their topics must agree."""
    ok = unicode_trim(F.col("topic")) == unicode_trim(F.col("binding_topic"))
    return pairs.where(ok), pairs.where(~F.coalesce(ok, F.lit(False))).withColumn("problem", problem(CONFLICT, "kafka record topic does not match binding topic"))


def parse_payload(df: DataFrame) -> DataFrame:
    """Adds ``_json``, the payload as VARIANT, null where it is no JSON; what follows reads it instead of parsing again."""
    return df if "_json" in df.columns else once(last_key_wins(df), _json=F.try_parse_json("payload"))


def message_checks() -> list:
    """The checks of a message with ``_json``; paths and messages are fixed values."""
    need = [("binding.name", "binding_name"), ("binding.topic", "topic"), ("binding.scope.kind", "scope_kind"), ("binding.scope.key", "scope_key"), ("binding.config.version_id", "version_id"),
            ("origin.source", "source"), ("origin.topic", "topic"), ("metadata.message_id", "message_id")]
    empty = F.coalesce(F.length("payload"), F.lit(0)) == 0
    return [*[(f, blank(F.col(c)), EMPTY) for f, c in need], ("metadata.ingested_at", F.col("ingested_at").isNull(), "must not be zero"), ("metadata.content_type", blank(F.col("content_type")), EMPTY),
            ("payload", empty, EMPTY), ("payload", ~empty & F.col("_json").isNull(), "must be valid JSON")]


def validate_messages(df: DataFrame, parsed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects); messages keep ``_json`` if they are to go on ``parsed``."""
    ok, bad = _checked(parse_payload(df), message_checks(), "data plane message is invalid")
    return ok if parsed else ok.drop("_json"), bad.drop("_json")


def normalize_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-blank values, trimmed and sorted."""
    return df.select(unicode_trim(F.col(col)).alias(col)).where(F.col(col) != "").distinct().orderBy(col)


ENVELOPE_KINDS = ("command", "event", "request", "reply")


def validate_envelopes(df: DataFrame, kind: str, type: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes of a kind and type with valid metadata, the others)."""
    found = [("kind", ~F.coalesce(F.col("kind").isin(*ENVELOPE_KINDS), F.lit(False)), "must be one of command, event, request or reply"),
                   *[(c, F.coalesce(F.col(c), F.lit("")) == "", EMPTY) for c in ("id", "type")], ("timestamp", F.col("timestamp").isNull(), "must not be zero"),
                   ("content_type", F.coalesce("content_type", F.lit("")) == "", EMPTY), ("headers", F.exists(F.map_keys("headers"), lambda k: k == ""), "must not contain empty header keys"),
                   ("kind", (F.col("kind") != kind) | (F.col("type") != type), "is not the wanted kind and type")]
    return _checked(df, found, "envelope is invalid")


def dedup_messages(stream: DataFrame, window: str = "2 minutes", key: str = "message_id", at: str = "ingested_at") -> DataFrame:
    """The first of rows with the same key inside a window; on a batch, the first of all."""
    if stream.isStreaming:
        return stream.withWatermark(at, window).dropDuplicatesWithinWatermark([key])
    cols = stream.columns
    return stream.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(at, *[c for c in ("seq",) if c in cols])).alias("r")).select("r.*")
