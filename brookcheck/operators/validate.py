"""Messages against the rules of their scope's runtime.

Rules are evaluated inside one array expression: no explode, no shuffle, no
Python.  They are normalised where the runtimes are, before the join, and the
payload is parsed once.  It is a VARIANT, so a missing key, a null, ``[]`` and the
string ``"[]"`` are told apart.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, blank, issues, let, once, or_else, print_value, problem, strip, trimmed, unicode_trim, variant_type
from ..schemas import CONFLICT, EMPTY, INTERNAL, INVALID, NOT_FOUND, UNAVAILABLE, VIOLATION
from .asof import as_of
from .history import scope
from .ingest import _checked, message_checks, parse_payload


RULES = "array<struct<name:string,field:string,operator:string,expected_value:string,severity:string>>"
#: What messages need of a runtime.
_OF_RUNTIME = ("scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "artifact", "rules", "definition_checksum")


def _checks(rules: Column) -> Column:
    """Rules with all parts trimmed and defaults filled in, as ``evaluate`` reads them."""
    text = lambda c: unicode_trim(F.coalesce(c, F.lit("")))
    return F.transform(F.coalesce(rules, F.array().cast(RULES)), lambda r: F.struct(text(r["name"]).alias("rule"), unicode_trim(r["field"]).alias("field"), F.lower(text(r["operator"])).alias("operator"), F.lower(or_else(r["severity"], F.lit("error"))).alias("severity"), text(r["expected_value"]).alias("expected")))


def _uncovered(rules: Column, capabilities: Column) -> Column:
    """Whether a rule's operator is none of the capabilities."""
    caps = F.coalesce(capabilities, F.array().cast("array<string>"))
    op = lambda r: F.lower(unicode_trim(F.coalesce(r["operator"], F.lit(""))))
    return F.coalesce(F.exists(rules, lambda r: ~F.array_contains(caps, F.concat(F.lit("rule.operator."), op(r)))), F.lit(False))


def runtime_struct(runtimes: DataFrame) -> Column:
    """What messages need of a runtime, with its rules as they are evaluated."""
    own = [c for c in _OF_RUNTIME if c in runtimes.columns]
    return F.struct(*own, _checks(F.col("rules")).alias("checks"), _uncovered(F.col("rules"), F.col("artifact.capabilities")).alias("uncovered"))


def resolve_runtimes(messages: DataFrame, runtimes: DataFrame, most_broadcast: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Adds ``runtime``, what messages need of the runtime of the normalised scope, null if there is none.

    The runtimes are broadcast when at most ``most_broadcast`` rows whose text takes at most ``most_bytes``.
    """
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    r = runtimes.select(F.col("scope_kind").alias("_kind"), F.col("scope_key").alias("_key"), runtime_struct(runtimes).alias("runtime"))
    rows, size = r.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json("runtime"))), F.lit(0))).first()
    r = F.broadcast(r) if rows <= most_broadcast and size <= most_bytes else r
    return messages.withColumn("_k", kind).withColumn("_y", key).join(r, (F.col("_k") == F.col("_kind")) & (F.col("_y") == F.col("_key")), "left").drop("_k", "_y", "_kind", "_key")


def resolve_as_of(messages: DataFrame, runtimes: DataFrame, at: str = "ingested_at", width: int = 86_400_000_000) -> DataFrame:
    """The same for a replay: the runtime that the scope had at the time ``at`` of each message, null where it had none.

    ``runtimes`` are all that were ever active, with activated_at and deactivated_at; of activations at one time the greatest version counts.
    ``width`` is in microseconds, see ``as_of``.
    """
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    r = runtimes.select(F.col("scope_kind").alias("_kind"), F.col("scope_key").alias("_key"), "activated_at", "deactivated_at", runtime_struct(runtimes).alias("runtime"))
    df = as_of(messages.withColumn("_kind", kind).withColumn("_key", key), r, ["_kind", "_key"], F.unix_micros(at), F.unix_micros("activated_at"), [F.col("runtime.version"), F.col("runtime.version_id")], width, "_found")
    held = F.col("_found.deactivated_at").isNull() | (F.col("_found.deactivated_at") > F.col(at))
    return df.select(*messages.columns, F.when(held, F.col("_found.runtime")).alias("runtime"))


def decode_payload(df: DataFrame) -> DataFrame:
    """Adds ``object`` MAP<STRING, VARIANT>, null unless the payload is a JSON object."""
    df = parse_payload(df)
    v = F.col("_json")
    return once(df, object=F.try_variant_get(v, "$", "map<string,variant>"))


def _guards(df: DataFrame, checks: list) -> list[tuple[Column, Column]]:
    """(failing condition, problem) of each guard, in order; codes and messages are fixed values."""
    runtime = df.schema["runtime"].dataType.fieldNames()
    uncovered = F.col("runtime.uncovered") if "uncovered" in runtime else _uncovered(F.col("runtime.rules"), F.col("runtime.artifact.capabilities"))
    differs = lambda a, b: F.coalesce(unicode_trim(F.col(a)) != F.col(b), F.lit(True))
    invalid = [(any_of(checks), problem(INVALID, "data plane message is invalid", found=issues(*checks)))] if checks else []
    return [(F.col("runtime").isNull(), problem(NOT_FOUND, "no active runtime for scope", True)), *invalid,
            (differs("scope_kind", "runtime.scope_kind") | differs("scope_key", "runtime.scope_key"), problem(CONFLICT, "validator runtime scope does not match data plane message")),
            (F.coalesce(unicode_trim(F.col("version_id")) != unicode_trim(F.col("runtime.version_id")), F.lit(True)), problem(CONFLICT, "validator runtime version does not match data plane message")),
            (F.col("object").isNull(), problem(INVALID, "data plane payload must be a JSON object")),
            (F.coalesce(uncovered, F.lit(False)), problem(CONFLICT, "validator runtime capability does not support configured rule operator"))]


def _first(guards: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None)
    for c, p in reversed(guards):
        out = F.when(c, p).otherwise(out)
    return out


def guard_messages(df: DataFrame, checked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of rows with ``runtime`` and ``object``: the first failing guard is the problem.

    Messages that ``validate_messages`` let through are ``checked`` and need not be again.
    """
    df = parse_payload(df)
    guards = _guards(df, [] if checked else message_checks())
    bad = F.lit(False)
    for c, _ in guards:
        bad = bad | c
    return df.where(~bad).drop("_json"), df.where(bad).withColumn("problem", _first(guards)).drop("_json")


def _value(obj: Column, rule: Column) -> Column:
    return F.try_element_at(obj, unicode_trim(rule["field"]))


def _required(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def _not_empty(v: Column) -> Column:
    empty = lambda kind: F.when(kind == "VOID", True).when(kind == "STRING", strip(v.cast("string")) == "").when(kind.startswith("ARRAY"), F.to_json(v) == "[]").when(kind.startswith("OBJECT"), F.to_json(v) == "{}").otherwise(False)
    return v.isNotNull() & ~let(variant_type(v), empty)


def _equals(v: Column, expected: Column, mode: str) -> Column:
    return F.coalesce(v.isNotNull() & (strip(print_value(v, mode)) == expected), F.lit(False))


def rule_required(obj: Column, rule: Column) -> Column:
    """The key is there and not null."""
    return let(_value(obj, rule), _required)


def rule_not_empty(obj: Column, rule: Column) -> Column:
    """There, and none of null, a blank string, [] and {}."""
    return let(_value(obj, rule), _not_empty)


def rule_equals(obj: Column, rule: Column, mode: str = "plain") -> Column:
    """There, and printed as the expected value; both trimmed."""
    return let(_value(obj, rule), lambda v: _equals(v, unicode_trim(F.coalesce(rule["expected_value"], F.lit(""))), mode))


def _violations(obj: Column, checks: Column, mode: str) -> Column:
    def message(r):
        judge = lambda v: (F.when(r["operator"] == "required", F.when(~_required(v), "field is required"))
                           .when(r["operator"] == "not_empty", F.when(~_not_empty(v), "field must not be empty"))
                           .when(r["operator"] == "equals", F.when(~_equals(v, r["expected"], mode), "field must equal expected value"))
                           .otherwise("rule operator is unsupported"))
        return let(F.try_element_at(obj, r["field"]), judge)

    def one(r):
        return let(message(r), lambda m: F.when(m.isNotNull(), F.struct(r["rule"], r["field"], r["operator"], r["severity"], m.alias("message"))))

    return F.filter(F.transform(checks, one), lambda x: x.isNotNull()).cast(f"array<{VIOLATION}>")


def violations(obj: Column, rules: Column, mode: str = "plain") -> Column:
    """ARRAY of the rules an object violates, in rule order."""
    return let(_checks(rules), lambda checks: _violations(obj, checks, mode))


def processing_key(given: Column | None = None) -> Column:
    """The given key, else seven trimmed parts joined by ``|``, blank if all are."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("message_id", "scope_kind", "scope_key", "binding_name", "topic", "version_id", "definition_checksum")]
    # Six bars alone are seven blank parts; what is built of others starts and ends with no space.
    built = F.nullif(trimmed("|", *parts), F.lit("||||||"))
    return F.coalesce(built, F.lit("")) if given is None else F.coalesce(or_else(given), built)


RESULT = ["processing_key", "message_id", "correlation_id", "binding_name", "topic", "scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "definition_checksum", "status", "violations", "processed_at", "seq"]


def evaluate(df: DataFrame, processed_at: Column | datetime.datetime | None = None, mode: str = "plain") -> DataFrame:
    """Results of guarded messages (``runtime``, ``object``, ``seq``): status is failed if any rule, of whatever severity, is violated."""
    r = lambda c: F.col(f"runtime.{c}").alias(c)
    own = [c for c in df.columns if c not in ("set_id", "config_key", "version", "definition_checksum", "runtime", "version_id")]
    normal = "checks" in df.schema["runtime"].dataType.fieldNames()
    found = _violations(F.col("object"), F.col("runtime.checks"), mode) if normal else violations(F.col("object"), F.col("runtime.rules"), mode)
    df = once(df, violations=found).select(*own, "violations", r("set_id"), r("config_key"), r("version_id"), r("version"), r("definition_checksum"))
    return _as_results(df, processed_at)


def _as_results(df: DataFrame, processed_at: Column | datetime.datetime | None) -> DataFrame:
    at = F.current_timestamp() if processed_at is None else processed_at if isinstance(processed_at, Column) else F.lit(processed_at)
    df = df.withColumn("status", F.when(F.size("violations") == 0, "passed").otherwise("failed")).withColumn("processed_at", at)
    return df.withColumn("processing_key", processing_key()).select(*RESULT)


def judge_messages(messages: DataFrame, runtimes: DataFrame, mode: str = "plain") -> DataFrame:
    """Messages with ``valid``, ``problem``, ``violations`` and the runtime's identity: all that results and rejects are read from, in one pass."""
    return judge_resolved(resolve_runtimes(messages, runtimes), mode)


def judge_resolved(messages: DataFrame, mode: str = "plain") -> DataFrame:
    """The same of messages that have their ``runtime``."""
    df = parse_payload(messages)
    checks = message_checks()
    df = once(df, _invalid=F.when(any_of(checks), problem(INVALID, "data plane message is invalid", found=issues(*checks))))
    df = decode_payload(df)
    df = once(df, problem=F.coalesce("_invalid", _first(_guards(df, []))), _found=F.when(F.col("object").isNotNull(), _violations(F.col("object"), F.col("runtime.checks"), mode)))
    own = [c for c in messages.columns if c not in ("set_id", "config_key", "version", "definition_checksum", "runtime")]
    return df.select(*own, F.col("_invalid").isNull().alias("valid"), "problem", F.col("_found").alias("violations"), *[F.coalesce(f"runtime.{c}", c).alias(c) if c in messages.columns else F.col(f"runtime.{c}").alias(c) for c in ("set_id", "config_key", "version", "definition_checksum")])


def results_of(judged: DataFrame, processed_at: Column | datetime.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of judged messages."""
    return _as_results(judged.where("problem is null"), processed_at), judged.where("problem is not null")


def validate_results(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects)."""
    need = [("message_id", "message_id"), ("binding.name", "binding_name"), ("binding.topic", "topic"), ("binding.scope.kind", "scope_kind"), ("binding.scope.key", "scope_key"), ("config.version_id", "version_id")]
    n = F.coalesce(F.size("violations"), F.lit(0))
    found = [("processing_key", blank(processing_key(F.col("processing_key"))), EMPTY), *[(f, blank(F.col(c)), EMPTY) for f, c in need],
                   ("violations", (F.col("status") == "passed") & (n > 0), "must be empty when status is passed"), ("violations", (F.col("status") == "failed") & (n <= 0), "must contain at least one item when status is failed"),
                   ("status", ~F.coalesce(F.col("status").isin("passed", "failed"), F.lit(False)), "must be one of passed or failed"), ("processed_at", F.col("processed_at").isNull(), "must not be zero")]
    return _checked(df, found, "validation result is invalid")


def disposition(p: Column) -> Column:
    """What becomes of a message: ack without problem, retry, or terminate."""
    again = F.coalesce(p["retryable"], F.lit(False)) | F.coalesce(p["code"].isin(UNAVAILABLE, INTERNAL), F.lit(False))
    return F.when(p.isNull(), "ack").when(again, "retry").otherwise("terminate")


def validate_all(messages: DataFrame, runtimes: DataFrame, processed_at: Column | datetime.datetime | None = None, mode: str = "plain", checked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of messages, which ``validate_messages`` has ``checked`` or not."""
    ok, bad = guard_messages(decode_payload(resolve_runtimes(messages, runtimes)), checked)
    return evaluate(ok, processed_at, mode), bad.drop("object")
