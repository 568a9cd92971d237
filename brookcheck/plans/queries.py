"""One query for each operator that yields a table, and the same in SQL.

Times are microseconds and arrays text, so that both engines write them alike.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import print_value
from ..operators import documents as doc
from ..operators import drift, history, ingest, results, topology, validate
from ..sources.files import shared_folder
from ..streaming import runtime_state
from . import fixtures as fx
from . import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def us(c: str) -> Column:
    return F.unix_micros(c).alias(c)


def joined(arr: str, *members: str, sep: str = ",") -> Column:
    return F.array_join(F.transform(arr, lambda v: F.concat_ws(":", *[v[m] for m in members])), sep)


def violations_text() -> Column:
    return joined("violations", "rule", "field", "operator", "severity", "message").alias("violations")


def issues_text(arr: str) -> Column:
    return F.array_join(F.transform(arr, lambda v: F.concat_ws("=", v["field"], v["message"])), ";")


# --- records and messages -------------------------------------------------------------


@register(f"WITH {q.REC} SELECT topic, key, part AS partition, off AS \"offset\", seq, coalesce(correlation_header, '') AS correlation, epoch_us(published_at) AS published_at FROM rec")
def normalize_records(spark, d):
    ok, _ = ingest.normalize_records(fx.records(spark, d))
    return ok.select("topic", "key", "partition", "offset", "seq", F.coalesce(F.try_element_at("headers", F.lit("x-correlation-id")), F.lit("")).alias("correlation"), us("published_at"))


@register("SELECT event_id AS seq, concat_ws(';', CASE WHEN event_type = 'error' THEN 'topic=must not be empty' END, CASE WHEN event_id % 10 = 0 THEN 'payload=must not be empty' END, CASE WHEN event_id % 15 = 0 THEN 'partition=must not be negative' END) AS issues FROM events WHERE event_type = 'error' OR event_id % 10 = 0 OR event_id % 15 = 0")
def reject_records(spark, d):
    e = fx.view(spark, d, "events")
    r = e.select(F.when(F.col("event_type") == "error", " \t").otherwise(F.col("event_type")).alias("topic"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("props")).alias("payload"), F.create_map().cast("map<string,string>").alias("headers"),
                 F.when(F.col("event_id") % 15 == 0, -1).otherwise(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("published_at"), F.col("event_id").alias("seq"))
    _, bad = ingest.normalize_records(r)
    return bad.select("seq", issues_text("problem.issues").alias("issues"))


@register(f"WITH {q.REC} SELECT DISTINCT topic FROM rec")
def normalize_values(spark, d):
    return ingest.normalize_values(fx.records(spark, d), "topic")


@register("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'error') AND event_id % 9 <> 0 AND event_id % 8 <> 0")
def validate_envelopes(spark, d):
    e = fx.view(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "shout").otherwise("event").alias("kind"), F.when(F.col("event_type") == "error", "other").otherwise("received").alias("type"),
                                           F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("application/json").alias("content_type"),
                                           F.create_map(F.when(F.col("event_id") % 8 == 0, "").otherwise("h"), F.lit("x")).alias("headers"))
    return ingest.validate_envelopes(e, "event", "received")[0].select("event_id")


@register(f"WITH {q.MSG} SELECT message_id, correlation_id, topic, binding_name, scope_kind, scope_key, version_id, 'application/json' AS content_type, 'kafka' AS source, 'dataplane.ingestion.received.' || scope_kind || '.' || scope_key || '.' || binding_name AS route, seq FROM mj")
def route_records(spark, d):
    return fx.messages(spark, d).select("message_id", "correlation_id", "topic", "binding_name", "scope_kind", "scope_key", "version_id", "content_type", "source", "route", "seq")


@register(f"WITH {q.REC} SELECT topic, off AS \"offset\", seq, 'SYS_NOT_FOUND' AS code FROM rec WHERE topic = 'events.error'")
def unrouted_records(spark, d):
    ok, _ = ingest.normalize_records(fx.records(spark, d))
    return ingest.route_records(ok, fx.bindings(spark))[1].select("topic", "offset", "seq", "problem.code")


@register("SELECT event_id, event_type = 'click' AS agrees, CASE WHEN event_type = 'click' THEN NULL ELSE 'SYS_CONFLICT' END AS code FROM events")
def check_pairs(spark, d):
    e = fx.view(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.col("event_type")).alias("topic"), F.lit("click").alias("binding_topic"))
    ok, bad = ingest.check_pairs(e)
    return ok.select("event_id", F.lit(True).alias("agrees"), F.lit(None).cast("string").alias("code")).unionByName(bad.select("event_id", F.lit(False).alias("agrees"), "problem.code"))


@register(f"WITH {q.MSG} SELECT message_id, seq, CASE WHEN j IS NULL THEN 'payload=must be valid JSON' ELSE '' END AS issues FROM mj")
def validate_messages(spark, d):
    ok, bad = ingest.validate_messages(fx.messages(spark, d))
    return ok.select("message_id", "seq", F.lit("").alias("issues")).unionByName(bad.select("message_id", "seq", issues_text("problem.issues").alias("issues")))


@register(f"WITH {q.MSG} SELECT message_id, min(seq) AS seq FROM mj GROUP BY message_id")
def dedup_messages(spark, d):
    return ingest.dedup_messages(fx.messages(spark, d)).select("message_id", "seq")


# --- validation -----------------------------------------------------------------------


@register(f"WITH {q.MSG} SELECT message_id, seq, version_id FROM mj WHERE j IS NOT NULL")
def resolve_runtimes(spark, d):
    return validate.resolve_runtimes(fx.valid_messages(spark, d), fx.runtimes(spark)).select("message_id", "seq", F.col("runtime.version_id").alias("version_id"))


@register(f"WITH {q.MSG} SELECT message_id, seq, CASE WHEN json_type(j) = 'OBJECT' THEN CAST(len(json_keys(j)) AS BIGINT) END AS n_keys FROM mj WHERE j IS NOT NULL")
def decode_payload(spark, d):
    return validate.decode_payload(fx.valid_messages(spark, d)).select("message_id", "seq", F.when(F.col("object").isNotNull(), F.size("object")).cast("long").alias("n_keys"))


def _spoiled(spark, d):
    """Messages with another scope spelling, another version and unknown scopes, by offset."""
    m = fx.messages(spark, d)
    o = F.col("offset")
    m = m.withColumn("scope_kind", F.when(o % 5 == 0, F.upper("scope_kind")).when(o % 5 == 1, "nowhere").otherwise(F.col("scope_kind"))).withColumn("version_id", F.when(o % 5 == 2, "ver-old").otherwise(F.col("version_id")))
    return validate.guard_messages(validate.decode_payload(validate.resolve_runtimes(m, fx.runtimes(spark))))


_GUARD = f"""{q.MSG}, g AS (SELECT seq, binding_name, v, CASE WHEN off % 5 = 1 THEN 'SYS_NOT_FOUND' WHEN j IS NULL THEN 'VAL_INVALID_ARGUMENT' WHEN off % 5 IN (0, 2) THEN 'SYS_CONFLICT' WHEN json_type(j) <> 'OBJECT' THEN 'VAL_INVALID_ARGUMENT' END AS code,
  CASE WHEN off % 5 = 1 THEN 'no active runtime for scope' WHEN j IS NULL THEN 'data plane message is invalid' WHEN off % 5 = 0 THEN 'validator runtime scope does not match data plane message' WHEN off % 5 = 2 THEN 'validator runtime version does not match data plane message' WHEN json_type(j) <> 'OBJECT' THEN 'data plane payload must be a JSON object' END AS message FROM mj)"""


@register(f"WITH {_GUARD} SELECT seq, binding_name, v, code, message FROM g WHERE code IS NOT NULL")
def guard_messages(spark, d):
    return _spoiled(spark, d)[1].select("seq", "binding_name", F.substring("config_key", 5, 1).alias("v"), "problem.code", "problem.message")


@register(f"WITH {_GUARD} SELECT seq, binding_name, v, CASE WHEN code IS NULL THEN 'ack' WHEN code = 'SYS_NOT_FOUND' THEN 'retry' ELSE 'terminate' END AS disposition FROM g")
def disposition(spark, d):
    ok, bad = _spoiled(spark, d)
    cols = ["seq", "binding_name", F.substring("config_key", 5, 1).alias("v")]
    return ok.select(*cols, F.lit("ack").alias("disposition")).unionByName(bad.select(*cols, validate.disposition(F.col("problem")).alias("disposition")))


def _objects(spark, d):
    return validate.decode_payload(fx.records(spark, d)).where("object is not null")


def _rule(field, expected=""):
    return {"field": F.lit(field), "expected_value": F.lit(expected)}


_OBJ = f"WITH {q.REC}, o AS (SELECT seq, try_cast(payload AS JSON) AS j FROM rec), p AS (SELECT * FROM o WHERE j IS NOT NULL AND json_type(j) = 'OBJECT')"


@register(f"{_OBJ} SELECT seq, coalesce(json_type(j, '$.user_id'), 'NULL') <> 'NULL' AS ok FROM p")
def rule_required(spark, d):
    return _objects(spark, d).select("seq", validate.rule_required(F.col("object"), _rule("user_id")).alias("ok"))


@register(f"{_OBJ} SELECT seq, trim(json_extract_string(j, '$.event_type')) <> '' AS type_ok, json_array_length(j, '$.tags') > 0 AS tags_ok, coalesce(json_type(j, '$.user_id'), 'NULL') <> 'NULL' AS user_ok FROM p")
def rule_not_empty(spark, d):
    ok = lambda f: validate.rule_not_empty(F.col("object"), _rule(f))
    return _objects(spark, d).select("seq", ok("event_type").alias("type_ok"), ok("tags").alias("tags_ok"), ok("user_id").alias("user_ok"))


@register(f"{_OBJ} SELECT seq, json_extract_string(j, '$.event_type') = 'click' AS type_ok, coalesce(json_extract_string(j, '$.event_id') = '12', false) AS id_ok FROM p")
def rule_equals(spark, d):
    ok = lambda f, x: validate.rule_equals(F.col("object"), _rule(f, x))
    return _objects(spark, d).select("seq", ok("event_type", " click ").alias("type_ok"), ok("event_id", "12").alias("id_ok"))


@register(f"{_OBJ} SELECT seq, coalesce(json_extract_string(j, '$.user_id'), CASE WHEN json_type(j, '$.user_id') = 'NULL' THEN '<nil>' END) AS user_id, json_extract_string(j, '$.event_type') AS event_type FROM p")
def print_values(spark, d):
    return _objects(spark, d).select("seq", print_value(F.try_element_at("object", F.lit("user_id"))).alias("user_id"), print_value(F.try_element_at("object", F.lit("event_type"))).alias("event_type"))


_RES_COLS = "processing_key, message_id, correlation_id, binding_name, topic, scope_kind, scope_key, set_id, config_key, version_id, version, status, violations, epoch_us(processed_at) AS processed_at, seq"


def _results_out(df):
    return df.select("processing_key", "message_id", "correlation_id", "binding_name", "topic", "scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "status", violations_text(), us("processed_at"), "seq")


@register(f"{_OBJ} SELECT seq, 'odd:event_type:matches:error:rule operator is unsupported' AS violations FROM p")
def unknown_operator(spark, d):
    rules = F.array(F.struct(F.lit(" odd ").alias("name"), F.lit("event_type").alias("field"), F.lit(" Matches ").alias("operator"), F.lit("x").alias("expected_value"), F.lit("").alias("severity")))
    return _objects(spark, d).select("seq", validate.violations(F.col("object"), rules).alias("violations")).select("seq", violations_text())


# Numbers as the scientific form writes them, of values that follow from event_id.
@register("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1e+06' WHEN 1 THEN '1e-05' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN '[' || event_id || ' <nil> x]' WHEN 4 THEN 'map[a:' || event_id || ' b:true]' ELSE '0.25' END AS printed FROM events WHERE event_id < 1000000""")
def printed_values(spark, d):
    e = fx.view(spark, d, "events").where("event_id < 1000000")
    k, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = (F.when(k == 0, "1000000").when(k == 1, "0.00001").when(k == 2, i).when(k == 3, F.concat(F.lit("["), i, F.lit(', null, "x"]')))
            .when(k == 4, F.concat(F.lit('{"b": true, "a": '), i, F.lit("}"))).otherwise("2.5e-1"))
    return e.select("event_id", print_value(F.parse_json(text), "compat").alias("printed"))


@register(f"WITH {q.RES} SELECT {_RES_COLS} FROM res")
def evaluate(spark, d):
    return _results_out(fx.results(spark, d))


@register(f"WITH {q.RES} SELECT seq, binding_name, v, processing_key FROM res")
def processing_keys(spark, d):
    return fx.results(spark, d).select("seq", "binding_name", F.substring("config_key", 5, 1).alias("v"), validate.processing_key(F.lit(" ")).alias("processing_key"))


@register(f"WITH {q.RES} SELECT seq, binding_name, v, concat_ws(';', CASE WHEN off % 3 = 0 AND status = 'failed' THEN 'violations=must be empty when status is passed' END, CASE WHEN off % 3 = 1 AND status = 'passed' THEN 'violations=must contain at least one item when status is failed' END, CASE WHEN off % 3 = 2 THEN 'status=must be one of passed or failed' END) AS issues FROM res WHERE off % 3 = 2 OR (off % 3 = 0 AND status = 'failed') OR (off % 3 = 1 AND status = 'passed')")
def validate_results(spark, d):
    r = fx.results(spark, d)
    off = F.col("seq") % 10_000_000
    r = r.withColumn("status", F.when(off % 3 == 0, "passed").when(off % 3 == 1, "failed").otherwise("maybe"))
    return validate.validate_results(r)[1].select("seq", "binding_name", F.substring("config_key", 5, 1).alias("v"), issues_text("problem.issues").alias("issues"))


# --- results and incidents ------------------------------------------------------------


def _latest(spark, d, *columns):
    return results.latest_results(fx.results(spark, d), list(columns) or None)


@register(f"WITH {q.LATEST} SELECT {_RES_COLS} FROM latest")
def latest_results(spark, d):
    return _results_out(_latest(spark, d))


@register(f"WITH {q.LATEST} SELECT seq, status FROM latest WHERE scope_kind = 'global' ORDER BY seq DESC LIMIT 200")
def recent_results(spark, d):
    return results.recent_results(_latest(spark, d, "scope_kind", "seq", "status").where("scope_kind = 'global'"), 200).select("seq", "status")


@register(f"WITH {q.LATEST} SELECT {_RES_COLS} FROM latest WHERE scope_kind = 'global' AND scope_key = 'default' AND topic = 'events.click' AND status = 'failed' ORDER BY seq DESC LIMIT 50")
def list_results(spark, d):
    return _results_out(results.list_results(_latest(spark, d), topic="events.click", status="failed", limit=50))


@register(f"WITH {q.LATEST} SELECT processing_key, fingerprint FROM latest")
def violation_fingerprint(spark, d):
    return _latest(spark, d).select("processing_key", results.violation_fingerprint(F.col("violations")).alias("fingerprint"))


@register(f"WITH {q.LATEST} SELECT processing_key, incident_key FROM latest WHERE status = 'failed'")
def incident_key(spark, d):
    return results.latest_results(fx.results(spark, d), ["processing_key", "scope_kind", "scope_key", "binding_name", "topic", "version_id", "violations"], F.col("status") == "failed").select("processing_key", results.incident_key().alias("incident_key"))


_INC_COLS = "incident_key, count, epoch_us(first_seen_at) AS first_seen_at, epoch_us(last_seen_at) AS last_seen_at, max_seq, latest_message_id, latest_correlation_id, binding_name, topic, scope_kind, scope_key, violations"


def _incidents(spark, d):
    """Incidents of the latest results, which pass on only what incidents tell here, and only where they failed."""
    columns = ["message_id", "correlation_id", "binding_name", "topic", "scope_kind", "scope_key", "version_id", "status", "violations", "processed_at", "seq"]
    return results.incidents(results.latest_results(fx.results(spark, d), columns, F.col("status") == "failed"))


def _incidents_out(df):
    return df.select("incident_key", "count", us("first_seen_at"), us("last_seen_at"), "max_seq", "latest_message_id", "latest_correlation_id", "binding_name", "topic", "scope_kind", "scope_key", violations_text())


@register(f"WITH {q.INC} SELECT {_INC_COLS} FROM inc")
def incidents(spark, d):
    return _incidents_out(_incidents(spark, d))


@register(f"WITH {q.INC} SELECT {_INC_COLS} FROM inc WHERE scope_kind = 'global' AND scope_key = 'default' ORDER BY max_seq DESC LIMIT 5")
def list_incidents(spark, d):
    return _incidents_out(results.list_incidents(_incidents(spark, d), limit=5))


@register(f"WITH {q.INC} SELECT incident_key, 'count=must be greater than zero' AS issues FROM inc WHERE count % 2 = 1")
def validate_incidents(spark, d):
    df = _incidents(spark, d).withColumn("count", F.when(F.col("count") % 2 == 1, 0).otherwise(F.col("count")))
    return results.validate_incidents(df)[1].select("incident_key", issues_text("problem.issues").alias("issues"))


@register(f"WITH {q.LATEST} SELECT count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status <> 'passed') AS failed FROM latest")
def results_summary(spark, d):
    return results.results_summary(_latest(spark, d, "status"))


@register(f"WITH {q.LATEST} SELECT binding_name, arg_max(topic, seq) AS topic, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status <> 'passed') AS failed, CAST(round(100.0 * count(*) FILTER (status = 'passed') / count(*)) AS BIGINT) AS pass_rate FROM latest GROUP BY binding_name")
def binding_summary(spark, d):
    return results.binding_summary(_latest(spark, d))


@register(f"WITH {q.LATEST}, x AS (SELECT unnest(['user', 'type', 'tags', 'is_purchase']) AS rule, unnest([bad_user, bad_type, bad_tags, bad_purchase]) AS bad FROM latest) SELECT rule, count(*) AS n FROM x WHERE bad GROUP BY rule")
def violation_counts(spark, d):
    return results.violation_counts(_latest(spark, d))


@register(f"WITH {q.LATEST} SELECT seq, message_id, CASE WHEN off % 2 = 0 THEN '' ELSE correlation_id END AS correlation_id, binding_name, topic, CASE WHEN off % 3 = 0 THEN 0 ELSE version END AS version, violations FROM latest WHERE status = 'failed' AND v = 'a' ORDER BY seq DESC LIMIT 300")
def inspect_results(spark, d):
    r = _latest(spark, d).where("config_key = 'key-a'")
    off = F.col("seq") % 10_000_000
    line = F.to_json(F.struct("message_id", F.when(off % 2 == 1, F.col("correlation_id")).alias("correlation_id"), "status", F.struct(F.col("binding_name").alias("name"), "topic").alias("binding"),
                              F.struct("version_id", F.when(off % 3 != 0, F.col("version")).alias("version")).alias("config"), F.when(F.size("violations") > 0, F.col("violations")).alias("violations")))
    return results.inspect_results(r.select("seq", line.alias("value")), failed_only=True, latest=300).select("seq", "message_id", "correlation_id", "binding_name", "topic", "version", violations_text())


@register(f"WITH {q.LATEST} SELECT 'error' AS severity, 'no passed result' AS message FROM latest WHERE bad_tags HAVING count(*) FILTER (status = 'passed') = 0")
def presence_gate(spark, d):
    return results.presence_gate(_latest(spark, d, "status", "violations").where(F.exists("violations", lambda v: v["rule"] == "tags")))


@register(f"WITH {q.MSG} SELECT message_id, seq FROM mj WHERE published_at >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 24 HOUR")
def retain(spark, d):
    return results.retain(fx.messages(spark, d), 24, datetime.datetime(2024, 1, 8)).select("message_id", "seq")


@register(f"WITH {_GUARD} SELECT seq, binding_name, v, CASE WHEN code = 'SYS_NOT_FOUND' AND seq % 12 < 10 THEN 'again' ELSE 'given up' END AS outcome, CAST(CASE WHEN code = 'SYS_NOT_FOUND' AND seq % 12 < 10 THEN seq % 12 + 1 ELSE seq % 12 END AS INT) AS attempt FROM g WHERE code IS NOT NULL")
def retry_rejects(spark, d):
    bad = _spoiled(spark, d)[1].withColumn("attempt", (F.col("seq") % 12).cast("int"))
    again, over = results.retry_rejects(bad)
    cols = ["seq", "binding_name", F.substring("config_key", 5, 1).alias("v")]
    return again.select(*cols, F.lit("again").alias("outcome"), "attempt").unionByName(over.select(*cols, F.lit("given up").alias("outcome"), "attempt"))


# --- config documents -----------------------------------------------------------------


@register(f"WITH {q.SRC} SELECT k AS c_custkey, format, sha256(format || ':' || content) AS source_checksum, concat_ws(';', CASE WHEN content = '' THEN 'source.content=must not be empty' END, CASE WHEN format = 'xml' THEN 'source.format=must be one of json or yaml' END) AS issues FROM k")
def normalize_sources(spark, d):
    return doc.normalize_sources(fx.sources(spark, d)).select("c_custkey", "format", doc.source_checksum(F.col("format"), F.col("content")).alias("source_checksum"), issues_text("source_issues").alias("issues"))


@register(f"WITH {q.SRC} SELECT k AS c_custkey, CASE WHEN content IN ('', '{{bad') THEN NULL WHEN k % 11 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN content IN ('', '{{bad') THEN NULL WHEN k % 13 = 0 THEN 0 ELSE 2 END AS n_bindings, content IN ('', '{{bad') AS bad FROM k WHERE format <> 'xml'")
def parse_documents(spark, d):
    df = doc.parse_documents(doc.normalize_sources(fx.sources(spark, d)).where("format <> 'xml'"))
    return df.select("c_custkey", F.col("metadata.name").alias("name"), F.when(F.col("bindings").isNotNull(), F.size("bindings")).alias("n_bindings"), (F.size("parse_issues") > 0).alias("bad"))


@register(f"WITH {q.SRC} SELECT k AS c_custkey, CASE WHEN k % 11 = 0 THEN '' ELSE c_name END AS name, 'seg' AS labels, 'string,' || CASE WHEN k % 19 = 0 THEN 'money' ELSE 'number' END AS types, 'required,' || op2 AS operators, ',' || CASE WHEN k % 3 = 0 THEN 'warn' WHEN k % 23 = 0 THEN 'fatal' ELSE '' END AS severities FROM op WHERE format <> 'xml' AND content NOT IN ('', '{{bad')")
def normalize_documents(spark, d):
    df = doc.normalize_documents(doc.parse_documents(doc.normalize_sources(fx.sources(spark, d)).where("format <> 'xml'")).where("size(parse_issues) = 0"))
    return df.select("c_custkey", F.col("metadata.name").alias("name"), F.array_join(F.map_keys("metadata.labels"), ",").alias("labels"), F.array_join("fields.type", ",").alias("types"), F.array_join("rules.operator", ",").alias("operators"), F.array_join("rules.severity", ",").alias("severities"))


@register(f"WITH {q.SRC} SELECT k AS c_custkey, diagnostics FROM diag")
def diagnose_documents(spark, d):
    return fx.verdicts(spark, d).select("c_custkey", issues_text("diagnostics").alias("diagnostics"))


@register(f"WITH {q.SRC} SELECT k AS c_custkey, diagnostics = '' AS valid, CASE WHEN diagnostics = '' THEN definition_checksum END AS definition_checksum FROM canon")
def validate_documents(spark, d):
    return fx.verdicts(spark, d).select("c_custkey", "valid", "definition_checksum")


@register(f"WITH {q.SRC} SELECT k AS c_custkey, CASE WHEN op2 = 'required' THEN 'rule.operator.required' WHEN op2 < 'required' THEN 'rule.operator.' || op2 || ',rule.operator.required' END AS capabilities, op2 = 'equals' AS supports_equals FROM op WHERE diagnostics = ''")
def capabilities(spark, d):
    c = doc.capabilities(F.col("rules"))
    return fx.verdicts(spark, d).where("valid").select("c_custkey", F.array_join(c, ",").alias("capabilities"), doc.supports_operator(c, F.lit(" EQUALS ")).alias("supports_equals"))


@register("SELECT c_custkey, CASE WHEN c_mktsegment < 'a' THEN c_mktsegment || ',a' ELSE 'a,' || c_mktsegment END AS capabilities FROM customer")
def normalize_capabilities(spark, d):
    arr = F.array(F.lit(" a "), F.col("c_mktsegment"), F.lit(" "), F.lit("a"), F.lit(None).cast("string"))
    return fx.view(spark, d, "customer").select("c_custkey", F.array_join(doc.normalize_capabilities(arr), ",").alias("capabilities"))


@register(f"WITH {q.SRC} SELECT k AS c_custkey, 'artifact-ver-' || k AS id, 'runtime/v1' AS schema_version, sha256(sha256(format || ':' || content) || ':' || definition_checksum) AS checksum, 'memory://configctl/artifacts/set-' || k || '/ver-' || k AS storage_ref, 'validator:v1' AS runtime_loader, 0 AS n_issues FROM canon WHERE diagnostics = ''")
def compile_versions(spark, d):
    return fx.versions_of_documents(spark, d).select("c_custkey", "artifact.id", "artifact.schema_version", "artifact.checksum", "artifact.storage_ref", "artifact.runtime_loader", F.size("artifact_issues").alias("n_issues"))


# --- config history -------------------------------------------------------------------


@register(f"WITH {q.EV} SELECT seq, event, event_id, version_id FROM e")
def read_config_events(spark, d):
    return fx.config_events(spark, d).select("seq", "event", "event_id", "version_id")


@register(f"WITH {q.EV} SELECT seq FROM ev WHERE trim(event_id) = ''")
def reject_config_events(spark, d):
    return history.check_events(fx.config_events(spark, d, checked=False))[1].select("seq")


@register(f"WITH {q.VER} SELECT version_id, set_id, lifecycle, epoch_us(updated_at) AS updated_at FROM life")
def current_lifecycle(spark, d):
    return history.current_lifecycle(fx.config_events(spark, d)).select("version_id", "set_id", "lifecycle", us("updated_at"))


@register(f"""WITH {q.EV}, t AS (SELECT seq, version_id, event, {q.STATE} AS to_state, lag({q.STATE}) OVER (PARTITION BY version_id ORDER BY occurred_at, seq) AS from_state FROM e)
SELECT * FROM t WHERE NOT coalesce(CASE to_state WHEN 'draft' THEN from_state IS NULL WHEN 'validated' THEN from_state = 'draft' WHEN 'compiled' THEN from_state = 'validated' WHEN 'active' THEN from_state IN ('compiled', 'inactive')
  WHEN 'inactive' THEN from_state = 'active' WHEN 'archived' THEN from_state IN ('draft', 'validated', 'compiled', 'inactive', 'rejected') WHEN 'rejected' THEN from_state IN ('draft', 'validated') END, false)""")
def audit_transitions(spark, d):
    return history.audit_transitions(fx.config_events(spark, d))


# Of odd orders only drafts and validations have come so far.
@register(f"WITH {q.VER}, n AS (SELECT *, {q.STATE} AS state, row_number() OVER (PARTITION BY version_id ORDER BY occurred_at DESC, seq DESC) AS k FROM e WHERE seq % 10 <= 1 OR (seq // 10) % 2 = 0), o AS (SELECT set_id, count(*) AS candidates FROM n WHERE k = 1 AND state IN ('draft', 'validated') GROUP BY set_id) SELECT set_id, candidates FROM o WHERE candidates > 1")
def open_candidate_conflicts(spark, d):
    e = fx.config_events(spark, d).where("seq % 10 <= 1 or (seq div 10) % 2 = 0")
    return history.open_candidate_conflicts(history.current_lifecycle(e))


@register(f"WITH {q.VER} SELECT version_id, set_id, version FROM ver")
def number_versions(spark, d):
    return fx.versions(spark, d).select("version_id", "set_id", "version")


@register(f"WITH {q.VER} SELECT set_id, max(version) AS version, arg_max(version_id, version) AS version_id, arg_max(lifecycle, version) AS lifecycle FROM ver GROUP BY set_id")
def latest_versions(spark, d):
    return history.latest_versions(fx.versions(spark, d)).select("set_id", "version", "version_id", "lifecycle")


_IV_COLS = "set_id, version_id, scope_kind, scope_key, epoch_us(activated_at) AS activated_at, epoch_us(deactivated_at) AS deactivated_at"


def _intervals_out(df):
    return df.select("set_id", "version_id", "scope_kind", "scope_key", us("activated_at"), us("deactivated_at"))


@register(f"WITH {q.IV} SELECT {_IV_COLS} FROM iv")
def activation_intervals(spark, d):
    return _intervals_out(fx.intervals(spark, d))


@register(f"WITH {q.IV}, x AS (SELECT *, lag(event) OVER w AS pe, lag(version_id) OVER w AS pv FROM ad WINDOW w AS (PARTITION BY scope_kind, scope_key ORDER BY pos, seq)) SELECT seq, version_id FROM x WHERE event = 'config.deactivated' AND NOT coalesce(pe = 'config.activated' AND pv = version_id, false)")
def deactivation_conflicts(spark, d):
    return history.deactivation_conflicts(fx.config_events(spark, d)).select("seq", "version_id")


@register(f"WITH {q.IV} SELECT {_IV_COLS} FROM iv WHERE scope_kind = 'tenant' AND scope_key = 't7' AND activated_at <= TIMESTAMP '1997-01-01' AND (deactivated_at IS NULL OR deactivated_at > TIMESTAMP '1997-01-01')")
def active_by_scope(spark, d):
    return _intervals_out(history.active_by_scope(fx.intervals(spark, d), " Tenant ", "t7", datetime.datetime(1997, 1, 1)))


@register(f"""WITH {q.RES}, mid AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS mid FROM events)
SELECT mj.message_id, mj.seq, CASE WHEN epoch_us(mj.published_at) < mid THEN 'SYS_CONFLICT' ELSE coalesce(status, 'VAL_INVALID_ARGUMENT') END AS outcome
FROM mj CROSS JOIN mid LEFT JOIN res ON res.message_id = mj.message_id AND res.seq = mj.seq WHERE mj.j IS NOT NULL""")
def resolve_as_of(spark, d):
    """A replay: messages judged by the version active at their time; in the first half an older one, which they do not name."""
    now = fx.runtimes(spark)
    mid = fx.view(spark, d, "events").agg(F.timestamp_micros(F.expr("(unix_micros(cast(min(ts) as timestamp)) + unix_micros(cast(max(ts) as timestamp))) div 2")).alias("mid"))
    both = now.crossJoin(F.broadcast(mid))
    old = both.withColumn("version_id", F.concat("version_id", F.lit("0"))).withColumn("version", F.lit(0).cast("long")).withColumn("activated_at", F.lit(datetime.datetime(1970, 1, 1))).withColumn("deactivated_at", F.col("mid"))
    new = both.withColumn("activated_at", F.col("mid")).withColumn("deactivated_at", F.lit(None).cast("timestamp"))
    judged = validate.judge_resolved(validate.resolve_as_of(fx.valid_messages(spark, d), old.unionByName(new).drop("mid")))
    return judged.select("message_id", "seq", F.coalesce("problem.code", F.when(F.size("violations") == 0, "passed").otherwise("failed")).alias("outcome"))


# A message for each order: in the scope of its customer, days after the order.
_LATER = "SELECT o_orderkey, 'tenant' AS scope_kind, 't' || CAST(o_custkey % 50 AS {S}) AS scope_key, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 2000) * INTERVAL '1' HOUR AS at FROM orders"


@register(f"""WITH {q.IV}, m AS ({_LATER.replace('{S}', 'VARCHAR')})
SELECT o_orderkey, version_id, epoch_us(activated_at) AS activated_at FROM m LEFT JOIN iv ON iv.scope_kind = m.scope_kind AND iv.scope_key = m.scope_key AND iv.activated_at <= m.at AND (iv.deactivated_at IS NULL OR iv.deactivated_at > m.at)""")
def activation_as_of(spark, d):
    """The version each of many messages met, by an as-of join."""
    m = spark.sql(fx._fixture(_LATER, "orders"), orders=fx.view(spark, d, "orders"))
    return history.activation_as_of(m, fx.intervals(spark, d), "at").select("o_orderkey", "activation.version_id", F.unix_micros("activation.activated_at").alias("activated_at"))


@register(f"WITH {q.IV} SELECT {_IV_COLS} FROM iv WHERE version_id = 'ver-38'")
def activations_of(spark, d):
    return _intervals_out(history.activations_of(fx.intervals(spark, d), "ver-38"))


@register(f"WITH {q.RUN} SELECT version_id, scopes FROM act")
def active_scopes(spark, d):
    return history.active_scopes(fx.intervals(spark, d)).select("version_id", joined("scopes", "scope_kind", "scope_key").alias("scopes")).withColumn("scopes", F.replace("scopes", F.lit(":"), F.lit("/")))


@register(f"WITH {q.IV} SELECT seq, count(*) FILTER (deactivated_at IS NULL) OVER (PARTITION BY version_id) - CASE WHEN deactivated_at IS NULL THEN 1 ELSE 0 END > 0 AS other_active FROM iv")
def has_other_active(spark, d):
    return history.has_other_active(fx.intervals(spark, d)).select("seq", "other_active")


@register(f"WITH {q.RUN} SELECT version_id, set_id, version, lifecycle, epoch_us(created_at) AS created_at, coalesce(scopes, '') AS scopes FROM ver LEFT JOIN act USING (version_id)")
def list_versions(spark, d):
    df = history.list_versions(fx.versions(spark, d), fx.intervals(spark, d))
    return df.select("version_id", "set_id", "version", "lifecycle", us("created_at"), F.replace(joined("scopes", "scope_kind", "scope_key"), F.lit(":"), F.lit("/")).alias("scopes"))


@register(f"WITH {q.RUN} SELECT version_id, set_id, version, lifecycle, coalesce(scopes, '') AS scopes FROM ver LEFT JOIN act USING (version_id) WHERE version_id = 'ver-38'")
def get_version(spark, d):
    return history.get_version(fx.versions(spark, d), fx.intervals(spark, d), " ver-38 ").select("version_id", "set_id", "version", "lifecycle", F.replace(joined("scopes", "scope_kind", "scope_key"), F.lit(":"), F.lit("/")).alias("scopes"))


@register(f"WITH {q.VER} SELECT set_id, min(config_key) AS config_key, count(*) AS versions, epoch_us(min(created_at)) AS created_at FROM ver GROUP BY set_id")
def list_sets(spark, d):
    return history.list_sets(fx.versions(spark, d)).select("set_id", "config_key", "versions", us("created_at"))


@register(f"WITH {q.VER} SELECT set_id, count(*) AS versions FROM ver WHERE set_id IN (SELECT set_id FROM ver WHERE version_id = 'ver-38') GROUP BY set_id")
def get_set(spark, d):
    return history.get_set(fx.versions(spark, d), version_id="ver-38").select("set_id", "versions")


@register(f"WITH {q.RUN} SELECT version_id, scope_kind, scope_key, epoch_us(activated_at) AS activated_at, artifact_id, definition_checksum FROM rt")
def runtime_projections(spark, d):
    return fx.order_runtimes(spark, d).select("version_id", "scope_kind", "scope_key", us("activated_at"), F.col("artifact.id").alias("artifact_id"), "definition_checksum")


@register(f"WITH {q.RUN} SELECT binding_name, topic, version_id, scope_kind, scope_key FROM bd")
def ingestion_bindings(spark, d):
    return fx.order_bindings(spark, d).select("binding_name", "topic", "version_id", "scope_kind", "scope_key")


@register(f"WITH {q.RUN} SELECT version_id, scope_kind, scope_key, artifact_checksum FROM rt")
def compact_runtimes(spark, d):
    return history.compact_runtimes(fx.order_runtimes(spark, d)).select("version_id", "scope_kind", "scope_key", F.col("artifact.checksum").alias("artifact_checksum"))


@register(f"WITH {q.IV} SELECT {_IV_COLS} FROM iv WHERE scope_kind = 'tenant' AND scope_key = 'extra'")
def scope_filter(spark, d):
    return _intervals_out(history.scope_filter(fx.intervals(spark, d), "Tenant", " extra "))


_CHANGES = f"{q.IV}, x AS (SELECT *, lead(activated_at) OVER (PARTITION BY scope_kind, scope_key ORDER BY activated_at, seq) AS nx FROM iv), ch AS (SELECT 'activated' AS change, activated_at AS pos, scope_kind, scope_key, set_id, version_id, seq FROM x UNION ALL SELECT 'cleared', deactivated_at, scope_kind, scope_key, set_id, version_id, seq FROM x WHERE deactivated_at IS NOT NULL AND (nx IS NULL OR deactivated_at < nx))"


@register(f"WITH {_CHANGES} SELECT change, epoch_us(pos) AS pos, scope_kind, scope_key, version_id FROM ch")
def runtime_changes(spark, d):
    return history.runtime_changes(fx.intervals(spark, d)).select("change", F.unix_micros("at").alias("pos"), "scope_kind", "scope_key", "version_id")


# Activations and deactivations as a change feed; in seq order the fold keeps the newest activation of a scope that no matching, later clearing removed.
@register(f"""WITH {q.IV}, a AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY pos DESC, seq DESC) AS rn FROM ad),
top AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY pos DESC, seq DESC) AS rk FROM ad WHERE event = 'config.activated')
SELECT scope_kind, scope_key, set_id, version_id, epoch_us(pos) AS activated_at FROM top t WHERE rk = 1
  AND NOT EXISTS (SELECT 1 FROM ad c WHERE c.event = 'config.deactivated' AND c.scope_kind = t.scope_kind AND c.scope_key = t.scope_key AND c.version_id = t.version_id AND c.set_id = t.set_id AND (c.pos > t.pos OR c.pos = t.pos AND c.seq > t.seq))""")
def runtime_state_batch(spark, d):
    kind, key = history.scope(F.col("scope_kind"), F.col("scope_key"))
    e = fx.config_events(spark, d).where("event in ('config.activated', 'config.deactivated')")
    e = e.select("seq", F.when(F.col("event") == "config.activated", "activated").otherwise("cleared").alias("change"), F.coalesce("activated_at", "deactivated_at").alias("at"), kind.alias("scope_kind"), key.alias("scope_key"), "set_id", "version_id")
    # Arrival in order of time.
    e = e.withColumn("seq", F.expr("unix_seconds(at) div 3600 * 1000000000") + F.col("seq"))
    return runtime_state.runtime_state_batch(e).select("scope_kind", "scope_key", "set_id", "version_id", us("activated_at"))


@register(f"WITH {q.IV}, top AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY pos DESC, seq DESC) AS rk FROM ad WHERE event = 'config.activated' AND scope_kind = 'tenant' AND scope_key = 'extra') SELECT version_id, set_id FROM top WHERE rk = 1")
def active_runtime(spark, d):
    e = fx.config_events(spark, d).where("event = 'config.activated'")
    e = e.select((F.expr("unix_seconds(activated_at) div 3600 * 1000000000") + F.col("seq")).alias("seq"), F.lit("activated").alias("change"), F.col("activated_at").alias("at"), F.lower(F.trim("scope_kind")).alias("scope_kind"), F.trim("scope_key").alias("scope_key"), "set_id", "version_id")
    return runtime_state.active_runtime(runtime_state.runtime_state_batch(e), "tenant", "extra").select("version_id", "set_id")


# --- topology -------------------------------------------------------------------------


@register(f"WITH {q.RUN}, x AS (SELECT * FROM bd UNION ALL SELECT * FROM bd WHERE set_id < 'set-2' AND binding_name = 'audit'), n AS (SELECT *, count(*) OVER (PARTITION BY scope_kind, scope_key, version_id, binding_name) AS k FROM x) SELECT binding_name, version_id, scope_kind, scope_key, CASE WHEN k > 1 THEN 'SYS_CONFLICT' ELSE '' END AS code FROM n")
def binding_index(spark, d):
    b = fx.order_bindings(spark, d)
    ok, bad = topology.binding_index(b.unionByName(b.where("set_id < 'set-2' and binding_name = 'audit'")))
    cols = ["binding_name", "version_id", "scope_kind", "scope_key"]
    return ok.select(*cols, F.lit("").alias("code")).unionByName(bad.select(*cols, "problem.code"))


@register(f"WITH {q.RUN} SELECT topic, count(*) AS n_bindings, min(scope_kind || '/' || scope_key) AS first_scope FROM bd GROUP BY topic")
def topic_topology(spark, d):
    return topology.topic_topology(fx.order_bindings(spark, d)).select("topic", "n_bindings", F.concat_ws("/", F.col("bindings")[0]["scope_kind"], F.col("bindings")[0]["scope_key"]).alias("first_scope"))


@register("SELECT p_partkey, 'dataplane.ingestion.received.' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '.' || CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') END || '.' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS route FROM part")
def route_subject(spark, d):
    p = fx.view(spark, d, "part")
    key = F.when(F.col("p_partkey") % 5 == 0, " #!").otherwise(F.col("p_type"))
    return p.select("p_partkey", topology.route_subject(F.col("p_brand"), key, F.concat(F.lit(" "), "p_name")).alias("route"))


_KEY = "scope_kind || '|' || scope_key || '|' || set_id || '|' || config_key || '|' || version_id || '|' || version || '|' || definition_checksum || '|' || artifact_id || '|runtime/v1|' || artifact_checksum || '|memory://x|validator:v1'"


@register(f"WITH {q.RUN}, x AS (SELECT *, {_KEY} AS identity FROM rt) SELECT 'runtime_missing' AS problem, identity FROM x WHERE scope_key < 't2' AND NOT scope_key > 't3' UNION ALL SELECT 'runtime_without_binding', identity FROM x WHERE scope_key > 't3'")
def runtime_drift(spark, d):
    b, r = fx.order_topology(spark, d)
    return topology.runtime_drift(b.where("not scope_key > 't3'"), r.where("scope_key >= 't2'"))


@register(f"WITH {q.RUN} SELECT DISTINCT scope_kind, scope_key, version_id FROM bd")
def canonical_runtimes(spark, d):
    return topology.canonical_runtimes(fx.order_bindings(spark, d)).select("scope_kind", "scope_key", "version_id")


@register(f"""WITH {q.RUN}, l AS (SELECT md5('runtime|' || {_KEY} || '|rule.operator.required') AS h FROM rt UNION ALL SELECT md5('binding|' || {_KEY} || '|rule.operator.required|' || binding_name || '|' || topic) FROM bd)
SELECT sha256(count(*) || ':' || CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR)) AS signature FROM l""")
def runtime_signature(spark, d):
    return topology.runtime_signature(*fx.order_topology(spark, d))


@register(f"WITH {q.RUN} SELECT scope_kind || ':' || scope_key || ':' || version_id || ':' || artifact_id AS ref FROM rt")
def runtime_refs(spark, d):
    return topology.runtime_refs(fx.order_runtimes(spark, d))


@register(f"WITH {q.RUN}, r AS (SELECT scope_key, scope_kind || ':' || scope_key || ':' || version_id || ':' || artifact_id AS ref FROM rt) SELECT 'removed' AS side, ref FROM r WHERE scope_key > 't3' UNION ALL SELECT 'added', ref FROM r WHERE scope_key < 't2'")
def topology_changed(spark, d):
    b, r = fx.order_topology(spark, d)
    return topology.topology_changed((b, r.where("scope_key >= 't2'")), (b, r.where("not scope_key > 't3'")))


@register(f"WITH {q.RUN} SELECT DISTINCT scope_kind, scope_key FROM bd WHERE scope_key < 't2'")
def stale_runtimes(spark, d):
    b, r = fx.order_topology(spark, d)
    return topology.stale_runtimes(b, r.where("scope_key >= 't2'"))


# --- drift ----------------------------------------------------------------------------


def _snapshots(spark, d):
    before = fx.view(spark, d, "orders")
    new = before.where("o_orderkey % 100 = 2").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    after = before.where("o_orderkey % 100 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).unionByName(new)
    return before, after


_DIFF = "d AS (SELECT o_orderkey, 'removed' AS change, '' AS changed FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, 'modified', 'o_totalprice' FROM orders WHERE o_orderkey % 100 = 1 UNION ALL SELECT o_orderkey + 1000000000, 'added', '' FROM orders WHERE o_orderkey % 100 = 2)"


@register(f"WITH {_DIFF} SELECT * FROM d")
def snapshot_diff(spark, d):
    return drift.snapshot_diff(*_snapshots(spark, d), ["o_orderkey"]).select("o_orderkey", "change", F.array_join("changed", ",").alias("changed"))


@register(f"WITH {_DIFF} SELECT * FROM d")
def diff_snapshots(spark, d):
    """The same rows from two written snapshots, of which only buckets with different digests are read."""
    at = shared_folder(spark, "snapshots")
    for name, df in zip(("before", "after"), _snapshots(spark, d), strict=True):
        drift.write_snapshot(df, f"{at}/{name}", ["o_orderkey"], 256)
    return drift.diff_snapshots(spark, f"{at}/before", f"{at}/after", ["o_orderkey"]).select("o_orderkey", "change", F.array_join("changed", ",").alias("changed"))


@register(f"WITH {_DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) > 0 AS has_changes FROM d")
def diff_totals(spark, d):
    return drift.diff_totals(drift.snapshot_diff(*_snapshots(spark, d), ["o_orderkey"]))


def _contracts(spark, d):
    """Parts as entities with fields: some lose one, some gain one, some change a type."""
    p = fx.view(spark, d, "part")
    field = lambda n, t: F.struct(F.lit(n).alias("name"), t.alias("type"))
    k = F.col("p_partkey")
    before = p.select(k.alias("entity"), F.array(field("id", F.lit("integer")), field("name", F.lit("string"))).alias("fields"))
    kind = F.when(k % 4 == 1, "number").otherwise("integer")
    after = p.select(k.alias("entity"), F.when(k % 4 == 0, F.array(field("id", kind))).when(k % 4 == 2, F.array(field("id", kind), field("name", F.lit("string")), field("size", F.lit("integer")))).otherwise(F.array(field("id", kind), field("name", F.lit("string")))).alias("fields"))
    return before, after


_FIELDS = "f AS (SELECT p_partkey AS entity, 'name' AS field, 'field_removed' AS change, 'string' AS before_type, NULL AS after_type FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'size', 'field_added', NULL, 'integer' FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, 'id', 'type_changed', 'integer', 'number' FROM part WHERE p_partkey % 4 = 1)"


@register(f"WITH {_FIELDS} SELECT * FROM f")
def field_diff(spark, d):
    return drift.field_diff(*_contracts(spark, d))


@register("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderpriority > '3') AS added FROM orders WHERE o_orderpriority > '3' GROUP BY o_custkey")
def list_diff(spark, d):
    o = fx.view(spark, d, "orders")
    after = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    before = after.withColumn("p", F.filter("p", lambda x: x <= "3"))
    return drift.list_diff(before, after, ["o_custkey"], "p").select("o_custkey", F.array_join("added", ",").alias("added"))


_FOUND = f"{_FIELDS}, c AS (SELECT p_partkey AS entity, 'warning' AS severity, 'entity removed' AS reason FROM part WHERE p_partkey % 20 = 4 UNION ALL SELECT entity, CASE change WHEN 'field_removed' THEN 'critical' ELSE 'warning' END, CASE change WHEN 'field_removed' THEN 'field removed' ELSE 'type changed' END FROM f WHERE change <> 'field_added' AND entity % 20 <> 4)"


def _found(spark, d):
    gone = fx.view(spark, d, "part").where("p_partkey % 20 = 4").select(F.col("p_partkey").alias("entity"), F.lit("removed").alias("change"))
    return drift.classify_drift(gone, drift.field_diff(*_contracts(spark, d)))


@register(f"WITH {_FOUND} SELECT * FROM c")
def classify_drift(spark, d):
    return _found(spark, d)


@register(f"WITH {_FOUND} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, 'drifted' AS verdict FROM c")
def drift_verdict(spark, d):
    return drift.drift_verdict(_found(spark, d))


@register("WITH n AS (SELECT o_orderpriority AS kind, count(*) AS n_before, count(*) FILTER (o_orderkey % 10 <> 0) AS n_after FROM orders GROUP BY 1), w AS (SELECT count(*) AS k FROM orders WHERE o_orderkey % 10 = 3) SELECT 'info' AS severity, kind, n_before, n_after, n_after - n_before AS delta FROM n WHERE abs(n_after - n_before) > CASE WHEN kind = '5-LOW' THEN 1000000000 ELSE 0 END UNION ALL SELECT 'warning', 'added without rules', 0, k, k FROM w WHERE k >= 3")
def stats_delta(spark, d):
    o = fx.view(spark, d, "orders")
    return drift.stats_delta(o, o.where("o_orderkey % 10 <> 0"), {"5-LOW": 1_000_000_000}, "o_orderpriority", o.where("o_orderkey % 10 = 3"))
