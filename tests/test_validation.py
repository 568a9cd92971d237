from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from brookcheck.operators import results, validate

T = datetime.datetime(2026, 1, 1)
RULE = "struct<name:string,field:string,operator:string,expected_value:string,severity:string>"
REQUIRED = [("order", "order_id", "required", "", ""), ("status", "status", "not_empty", "", "")]


def run(spark, payload, rules, caps=("rule.operator.required", "rule.operator.not_empty", "rule.operator.equals"), kind="global", version="v1", messages=None):
    rows = messages or [("m1", 1, payload, T)]
    m = spark.createDataFrame([(i, s, p, t, "orders", "topic", kind, "default", version, "kafka", "application/json", "c") for i, s, p, t in rows],
                              "message_id string, seq long, payload string, ingested_at timestamp, binding_name string, topic string, scope_kind string, scope_key string, version_id string, source string, content_type string, correlation_id string")
    r = spark.createDataFrame([("global", "default", "set", "key", "v1", 1, "sum", (list(caps),), rules)], f"scope_kind string, scope_key string, set_id string, config_key string, version_id string, version long, definition_checksum string, artifact struct<capabilities:array<string>>, rules array<{RULE}>")
    ok, bad = validate.validate_all(m, r, F.col("ingested_at"))
    return ok, bad


def test_pass(spark):
    ok, _ = run(spark, '{"order_id":"1","status":"approved"}', REQUIRED)
    r = ok.first()
    assert r.status == "passed" and r.processing_key == "m1|global|default|orders|topic|v1|sum"


def test_two_violations(spark):
    r = run(spark, '{"status":""}', REQUIRED)[0].first()
    assert r.status == "failed" and [v.message for v in r.violations] == ["field is required", "field must not be empty"]


def test_equals_and_severity(spark):
    v = run(spark, '{"status":"pending"}', [("s", "status", "equals", "approved", "warn")])[0].first().violations
    assert [(x.operator, x.severity) for x in v] == [("equals", "warn")]
    assert run(spark, '{"status":"pending"}', [("s", "status", "equals", "approved", "")])[0].first().violations[0].severity == "error"


@pytest.mark.parametrize(("how", "code", "retry"), [({"caps": ("rule.operator.required",)}, "SYS_CONFLICT", False), ({"kind": "GLOBAL"}, "SYS_CONFLICT", False), ({"kind": "other"}, "SYS_NOT_FOUND", True), ({"version": "v0"}, "SYS_CONFLICT", False)])
def test_guards(spark, how, code, retry):
    ok, bad = run(spark, "{}", REQUIRED, **how)
    r = bad.select("problem", validate.disposition(F.col("problem")).alias("d")).first()
    assert ok.isEmpty() and (r.problem.code, r.problem.retryable) == (code, retry) and r.d == ("retry" if retry else "terminate")


@pytest.mark.parametrize("payload", ["null", "[1]", '"s"', "{bad", ""])
def test_payloads_that_are_no_object(spark, payload):
    ok, bad = run(spark, payload, REQUIRED)
    assert ok.isEmpty() and bad.first().problem.code == "VAL_INVALID_ARGUMENT"


@pytest.mark.parametrize(("payload", "required", "filled"), [("{}", 0, 0), ('{"x":null}', 0, 0), ('{"x":"[]"}', 1, 1), ('{"x":[]}', 1, 0), ('{"x":[null]}', 1, 1), ('{"x":{}}', 1, 0), ('{"x":" \\t\\u00a0"}', 1, 0), ('{"x":0}', 1, 1), ('{"x":false}', 1, 1), ('{"X":1}', 0, 0)])
def test_required_and_not_empty(spark, payload, required, filled):
    ok, _ = run(spark, payload, [("a", "x", "required", "", ""), ("b", "x", "not_empty", "", "")])
    assert [v.rule for v in ok.first().violations] == ["a"] * (1 - required) + ["b"] * (1 - filled)


def test_names_with_dots_and_quotes(spark):
    ok, _ = run(spark, '{"a.b":1,"c\\"d":2}', [("a", "a.b", "required", "", ""), ("b", 'c"d', "equals", "2", ""), ("c", "a", "required", "", "")])
    assert [v.rule for v in ok.first().violations] == ["c"]


def test_the_last_of_repeated_keys_counts(spark):
    ok, _ = run(spark, '{"x":1,"x":2}', [("a", "x", "equals", "2", "")])
    assert ok.first().status == "passed"


def test_incidents_and_redelivery(spark):
    at = lambda s: T + datetime.timedelta(seconds=s)
    ok, _ = run(spark, None, REQUIRED, messages=[("msg-1", 1, '{"status":"x"}', at(10)), ("msg-2", 2, '{"status":"x"}', at(20)), ("msg-3", 3, '{"order_id":1,"status":"x"}', at(30)), ("msg-2", 4, '{"status":"x"}', at(20))])
    latest = results.latest_results(ok)
    assert sorted(r.seq for r in latest.collect()) == [1, 3, 4]
    (i,) = results.incidents(latest).collect()
    assert (i["count"], i.latest_message_id, i.first_seen_at, i.last_seen_at) == (2, "msg-2", at(10), at(20))
    s = results.results_summary(latest).first()
    assert (s.total, s.passed, s.failed) == (3, 1, 2)
    assert results.validate_incidents(results.incidents(latest))[1].isEmpty() and validate.validate_results(latest)[1].isEmpty()
    assert results.presence_gate(latest).isEmpty()
    assert [r.severity for r in results.presence_gate(latest.limit(0)).collect()] == ["error", "warning"]


def test_limits(spark):
    ok, _ = run(spark, "{}", REQUIRED)
    assert results.list_results(ok, scope_kind="nowhere").isEmpty()
    with pytest.raises(ValueError):
        results.list_results(ok, limit=101)
    with pytest.raises(ValueError):
        results.list_results(ok, status="odd")


def test_a_replay_meets_the_version_of_its_time(spark):
    import datetime

    from brookcheck.operators import validate

    day = lambda d: datetime.datetime(2026, 1, d)
    cols = "scope_kind string, scope_key string, set_id string, config_key string, version_id string, version long, artifact struct<capabilities:array<string>>, rules array<struct<name:string,field:string,operator:string,expected_value:string,severity:string>>, definition_checksum string, activated_at timestamp, deactivated_at timestamp"
    r = [("tenant", "a", "s", "k", v, n, (["rule.operator.required"],), [("r", f"f{n}", "required", "", "error")], "c", day(a), day(b) if b else None) for v, n, a, b in (("v1", 1, 2, 4), ("v2", 2, 4, 6), ("v3", 3, 9, None))]
    m = [(str(i), " Tenant", "a", day(i)) for i in range(1, 12)] + [("none", "tenant", "b", day(5)), ("null", "tenant", "a", None)]
    runtimes = spark.createDataFrame(r, cols)
    got = {x.message_id: x.v for x in validate.resolve_as_of(spark.createDataFrame(m, "message_id string, scope_kind string, scope_key string, ingested_at timestamp"), runtimes).selectExpr("message_id", "runtime.version_id as v").collect()}
    want = {str(i): None if i < 2 or 6 <= i < 9 else "v1" if i < 4 else "v2" if i < 6 else "v3" for i in range(1, 12)}
    assert got == want | {"none": None, "null": None}


def test_latest_results_that_failed(spark):
    """Results that passed pass on nothing, and one that failed before counts no more; incidents do without columns that are not there."""
    rows = [("a", "m1", "failed", 1), ("a", "m1", "passed", 2), ("b", "m2", "passed", 1), ("b", "m2", "failed", 2), (" ", "m3", "failed", 3), (None, "m4", "passed", 4)]
    df = spark.createDataFrame(rows, "processing_key string, message_id string, status string, seq long")
    violation = F.array(F.struct(*[F.lit(x).alias(x) for x in ("rule", "field", "operator", "severity", "message")]))
    parts = ("scope_kind", "scope_key", "binding_name", "topic", "version_id", "definition_checksum")
    full = df.withColumns({c: F.lit("x") for c in parts}).withColumns({"violations": violation, "processed_at": F.col("seq").cast("timestamp")})
    got = results.latest_results(full, ["message_id", "status", "seq"], F.col("status") == "failed").collect()
    assert sorted(map(tuple, got)) == [("m2", "failed", 2), ("m3", "failed", 3)]
    one = results.incidents(full.drop("processing_key").where("status = 'failed'")).collect()
    assert len(one) == 1 and one[0]["count"] == 3 and one[0].latest_message_id == "m3" and "latest_processing_key" not in one[0]
