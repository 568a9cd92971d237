"""Results, incidents and reports.

Results have the columns that ``evaluate`` gives; ``seq`` is the order in which
they were recorded.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, unicode_trim
from ..schemas import EMPTY, VIOLATION
from .ingest import _checked
from .validate import disposition, processing_key

KIND, OPEN = "validation.rule_violation", "open"
DEFAULT_LIMIT, MOST = 20, 100


def latest_results(results: DataFrame, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The last recorded result of each processing key (of each message where it is blank); ``columns`` are those wanted, all by default.

    Of the last results only those are given that fulfil ``where``: the others pass on nothing but that they are the last.

    A max of structs, not a window: it is aggregated before the shuffle.  Spark sorts for it, and
    passes on whole structs: keys begin alike, so a hash of them is sorted by first.
    """
    key = F.coalesce(processing_key(F.col("processing_key")), F.col("message_id"))
    keyed = results.select("*", key.alias("_key"))
    row = F.struct(*(columns or results.columns))
    last = keyed.groupBy(F.xxhash64("_key").alias("_hash"), "_key").agg(F.max_by(row if where is None else F.when(where, row), "seq").alias("r"))
    return (last if where is None else last.where("r is not null")).select("r.*")


def recent_results(results: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` recorded last."""
    return results.orderBy(F.desc("seq")).limit(n)


def _limit(limit: int | None) -> int:
    if limit is None or limit == 0:
        return DEFAULT_LIMIT
    if limit < 0 or limit > MOST:
        raise ValueError(f"limit must be between 1 and {MOST}")
    return limit


def _where(df: DataFrame, **given: str | None) -> DataFrame:
    for column, value in given.items():
        if value and value.strip():
            df = df.where(F.col(column) == value.strip())
    return df


def list_results(results: DataFrame, scope_kind: str = "global", scope_key: str = "default", binding: str | None = None, topic: str | None = None, status: str | None = None, message_id: str | None = None, correlation_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest results of a scope that pass the filters."""
    if status and status.strip().lower() not in ("passed", "failed"):
        raise ValueError("status must be one of passed or failed")
    df = _where(results, scope_kind=scope_kind, scope_key=scope_key, binding_name=binding, topic=topic, status=status and status.lower(), message_id=message_id, correlation_id=correlation_id)
    return df.orderBy(F.desc("seq")).limit(_limit(limit))


def violation_fingerprint(arr: Column) -> Column:
    """Sorted ``rule:field:operator:severity``, comma-joined; the message is left out."""
    one = lambda v: F.concat_ws(":", *[unicode_trim(F.coalesce(v[c], F.lit(""))) for c in ("rule", "field", "operator", "severity")])
    return F.array_join(F.array_sort(F.transform(arr, one)), ",")


def incident_key() -> Column:
    parts = [unicode_trim(F.coalesce(F.col(c), F.lit(""))) for c in ("scope_kind", "scope_key", "binding_name", "topic", "version_id")]
    return F.concat_ws("|", F.lit(KIND), *parts, violation_fingerprint(F.col("violations")))


def incidents(results: DataFrame) -> DataFrame:
    """Failed results by incident key: count, first and last time, and what the latest says (by time, then recording); columns that results lack are left out."""
    named = [c for c in ("message_id", "correlation_id", "processing_key") if c in results.columns]
    own = [c for c in ("binding_name", "topic", "scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "definition_checksum", "violations") if c in results.columns]
    latest = F.struct(*named, *own)
    df = results.where("status = 'failed'").groupBy(incident_key().alias("incident_key")).agg(
        F.count("*").alias("count"), F.min("processed_at").alias("first_seen_at"), F.max("processed_at").alias("last_seen_at"), F.max("seq").alias("max_seq"),
        F.max_by(latest, F.struct("processed_at", "seq")).alias("l"))
    return df.select("incident_key", F.lit(KIND).alias("kind"), F.lit(OPEN).alias("status"), "count", "first_seen_at", "last_seen_at", "max_seq",
                     *[F.col(f"l.{c}").alias(f"latest_{c}") for c in named], *[f"l.{c}" for c in own])


def list_incidents(found: DataFrame, scope_kind: str = "global", scope_key: str = "default", binding: str | None = None, topic: str | None = None, kind: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """The incidents met last, then by last_seen_at; the limit comes first, as it does where incidents are gathered."""
    if kind and kind.strip() != KIND or status and status.strip() != OPEN:
        raise ValueError("kind or status is not known")
    df = _where(found, scope_kind=scope_kind, scope_key=scope_key, binding_name=binding, topic=topic)
    return df.orderBy(F.desc("max_seq")).limit(_limit(limit)).orderBy(F.desc("last_seen_at"), F.desc("max_seq"))


def validate_incidents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents, rejects)."""
    need = [("binding.name", "binding_name"), ("binding.topic", "topic"), ("binding.scope.kind", "scope_kind"), ("binding.scope.key", "scope_key"), ("config.version_id", "version_id")]
    found = [("incident_key", blank(F.col("incident_key")), EMPTY), ("kind", F.coalesce(F.col("kind") != KIND, F.lit(True)), f"must be {KIND}"), ("status", F.coalesce(F.col("status") != OPEN, F.lit(True)), "must be open"),
                   *[(f, blank(F.col(c)), EMPTY) for f, c in need], ("count", F.coalesce(F.col("count") <= 0, F.lit(True)), "must be greater than zero"),
                   *[(c, F.col(c).isNull(), "must not be zero") for c in ("first_seen_at", "last_seen_at")], ("last_seen_at", F.col("last_seen_at") < F.col("first_seen_at"), "must not be before first_seen_at"),
                   ("latest_message_id", blank(F.col("latest_message_id")), EMPTY), ("violations", F.coalesce(F.size("violations"), F.lit(0)) <= 0, "must contain at least one item")]
    return _checked(df, found, "validation incident is invalid")


def results_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(~(F.col("status") == "passed")).alias("failed"))


def binding_summary(results: DataFrame) -> DataFrame:
    """binding_name, topic (of the newest), passed, failed (all that did not pass) and pass_rate in whole percent."""
    passed = F.count_if(F.col("status") == "passed")
    df = results.groupBy("binding_name").agg(F.max_by("topic", "seq").alias("topic"), passed.alias("passed"), (F.count("*") - passed).alias("failed"))
    return df.withColumn("pass_rate", F.round(F.lit(100) * F.col("passed") / (F.col("passed") + F.col("failed"))).cast("long")).orderBy("binding_name")


def violation_counts(results: DataFrame) -> DataFrame:
    """rule, n: the most violated first."""
    return results.select(F.explode("violations.rule").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


_ROW = f"message_id string, correlation_id string, processing_key string, status string, binding struct<name:string,topic:string>, config struct<version_id:string,version:bigint>, violations array<{VIOLATION}>"


def inspect_results(lines: DataFrame, failed_only: bool = False, latest: int | None = None) -> DataFrame:
    """Results out of JSON text (``value``, ``seq``): missing text is blank, a missing version 0, missing violations none; the newest first."""
    df = lines.select("seq", F.from_json("value", _ROW).alias("r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c.split(".")[-1] if c != "binding.name" else "binding_name")
    df = df.select("seq", *[text(c) for c in ("message_id", "correlation_id", "processing_key", "status", "binding.name", "binding.topic", "config.version_id")],
                   F.coalesce("r.config.version", F.lit(0)).cast("long").alias("version"), F.coalesce("r.violations", F.array().cast(f"array<{VIOLATION}>")).alias("violations"))
    df = df.where("status = 'failed'") if failed_only else df
    df = df.orderBy(F.desc("seq"))
    return df.limit(latest) if latest is not None else df


def presence_gate(results: DataFrame) -> DataFrame:
    """Findings (severity, message): no passed result is an error, no failed one a warning."""
    seen = results.agg(F.coalesce(F.bool_or(F.col("status") == "passed"), F.lit(False)).alias("passed"), F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("failed"))
    found = F.array(F.when(~F.col("passed"), F.struct(F.lit("error").alias("severity"), F.lit("no passed result").alias("message"))), F.when(~F.col("failed"), F.struct(F.lit("warning").alias("severity"), F.lit("no failed result").alias("message"))))
    return seen.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def retain(df: DataFrame, hours: int = 24, now: datetime.datetime | None = None, at: str = "ingested_at") -> DataFrame:
    """Rows of the last ``hours``."""
    return df.where(F.col(at) >= (F.current_timestamp() if now is None else F.lit(now)) - F.make_interval(hours=F.lit(hours)))


def retry_rejects(rejects: DataFrame, max_attempts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows to deliver again with one attempt more, rows that are given up) by problem and ``attempt``."""
    again = (disposition(F.col("problem")) == "retry") & (F.coalesce("attempt", F.lit(1)) < max_attempts)
    return rejects.where(again).withColumn("attempt", F.coalesce("attempt", F.lit(1)) + 1), rejects.where(~again)
