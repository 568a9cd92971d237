"""Inputs of the registered queries, derived from the supplied tables by the same SQL in Spark and in DuckDB."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, history, ingest, topology, validate
from ..sources.files import shared_folder

NOW = datetime.datetime(2024, 6, 1)

#: Records: the events table, with defects that follow from event_id.  {S} is the engine's text type.
RECORDS = """
SELECT 'events.' || event_type AS topic, CAST(user_id AS {S}) AS key,
       CASE WHEN event_id % 101 = 0 THEN '{{bad'
            WHEN event_id % 103 = 0 THEN '[1]'
            ELSE '{{"event_id":' || CAST(event_id AS {S})
                 || CASE WHEN event_id % 7 = 0 THEN ''
                         WHEN event_id % 13 = 0 THEN ',"user_id":null'
                         ELSE ',"user_id":' || CAST(user_id AS {S}) END
                 || ',"event_type":"' || CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END || '"'
                 || ',"tags":' || CASE WHEN event_id % 17 = 0 THEN '[]' ELSE '["t"]' END
                 || ',"props":' || props || '}}' END AS payload,
       CASE WHEN event_id % 3 = 0 THEN 'corr-' || CAST(event_id AS {S}) END AS correlation_header,
       CAST(user_id % 4 AS INT) AS part, event_id AS off, ts AS published_at
FROM events"""

RULES_A = [("user", "user_id", "required", "", "error"), ("type", "event_type", "not_empty", "", "error"), ("tags", "tags", "not_empty", "", "warn")]
RULES_B = [("is_purchase", "event_type", "equals", "purchase", "")]
BINDINGS = [("clicks", "events.click", "a"), ("views", "events.view", "a"), ("purchases", "events.purchase", "a"), ("purchases", "events.purchase", "b"), ("signups", "events.signup", "b")]
SCOPES = {"a": ("global", "default"), "b": ("tenant", "br")}


def _document(v: str) -> str:
    rules = [dict(zip(("name", "field", "operator", "expected_value", "severity"), r, strict=True)) for r in (RULES_A if v == "a" else RULES_B)]
    fields = [{"name": n, "type": "string"} for n in ("user_id", "event_type", "tags")]
    return json.dumps({"metadata": {"name": f"set-{v}"}, "bindings": [{"name": n, "topic": t} for n, t, x in BINDINGS if x == v], "fields": fields, "rules": rules})


_COMPILED: dict[str, tuple] = {}


def runtimes(spark: SparkSession) -> DataFrame:
    """The two active versions, compiled from their documents once in an application, as a deployed table would be."""
    app = spark.sparkContext.applicationId
    if app not in _COMPILED:
        df = _compiled(spark)
        _COMPILED[app] = (df.collect(), df.schema)
    return spark.createDataFrame(*_COMPILED[app])


def _compiled(spark: SparkSession) -> DataFrame:
    rows = [(f"set-{v}", f"key-{v}", f"ver-{v}", 1, *SCOPES[v], datetime.datetime(2024, 1, 1), "json", _document(v)) for v in "ab"]
    df = spark.createDataFrame(rows, "set_id string, config_key string, version_id string, version long, scope_kind string, scope_key string, activated_at timestamp, format string, content string")
    df = documents.compile_versions(documents.validate_documents(df))
    return df.select("scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "artifact", "activated_at", "bindings", "fields", "rules", "definition_checksum")


def bindings(spark: SparkSession) -> DataFrame:
    return history.ingestion_bindings(runtimes(spark))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table dealt out to all cores: a file is read by no more tasks than it has row groups, of up to a million rows each.

    By key, as Spark sorts what it deals out in turn.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, key)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with ``seq``, and a second delivery of every fiftieth."""
    df = spark.sql(_fixture(RECORDS, "events"), events=spread(view(spark, sf_dir, "events"), "event_id"))
    headers = F.when(F.col("correlation_header").isNotNull(), F.create_map(F.lit(" X-Correlation-Id "), F.col("correlation_header"))).otherwise(F.create_map().cast("map<string,string>"))
    df = df.select("topic", "key", "payload", headers.alias("headers"), F.col("part").alias("partition"), F.col("off").alias("offset"), F.col("published_at").cast("timestamp").alias("published_at"), F.col("off").alias("seq"))
    again = F.when(F.col("offset") % 50 == 0, F.array("seq", F.col("seq") + 10_000_000)).otherwise(F.array("seq"))
    return df.select(*[c for c in df.columns if c != "seq"], F.explode(again).alias("seq"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = ingest.normalize_records(records(spark, sf_dir))
    return ingest.route_records(ok, bindings(spark))[0]


def valid_messages(spark: SparkSession, sf_dir: str, parsed: bool = False) -> DataFrame:
    return ingest.validate_messages(messages(spark, sf_dir), parsed)[0]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recorded results, redeliveries too."""
    return validate.validate_all(valid_messages(spark, sf_dir, parsed=True), runtimes(spark), F.col("ingested_at") + F.expr("INTERVAL 1 SECOND"), checked=True)[0]


#: Config documents: one per customer, with defects that follow from the key.
SOURCES = """
SELECT c_custkey, 'key-' || CAST(c_custkey AS {S}) AS config_key,
  CASE WHEN c_custkey % 29 = 0 THEN 'xml' WHEN c_custkey % 6 = 0 THEN ' JSON ' WHEN c_custkey % 6 = 1 THEN 'yaml' ELSE 'json' END AS format,
  CASE WHEN c_custkey % 31 = 0 THEN '{{bad' WHEN c_custkey % 37 = 0 THEN '  ' ELSE
  '{{"metadata":{{"name":"' || CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END || '","description":" d ","labels":{{"seg":"' || c_mktsegment || '","tier":" "}}}},"bindings":['
  || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '{{"name":"b1","topic":"t' || CAST(c_nationkey AS {S}) || '"}},{{"name":"' || CASE WHEN c_custkey % 7 = 0 THEN 'b1' ELSE 'b2' END || '","topic":"' || CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'u' || CAST(c_nationkey AS {S}) END || '"}}' END
  || '],"fields":[{{"name":"id","type":" STRING ","required":true}},{{"name":"amount","type":"' || CASE WHEN c_custkey % 19 = 0 THEN 'money' ELSE 'number' END || '"}}],"rules":[{{"name":"r1","field":"id","operator":"Required"}},{{"name":"r2","field":"'
  || CASE WHEN c_custkey % 5 = 0 THEN 'ghost' ELSE 'amount' END || '","operator":"' || CASE WHEN c_custkey % 4 = 0 THEN 'equals' WHEN c_custkey % 4 = 1 THEN 'not_empty' WHEN c_custkey % 4 = 2 THEN 'matches' ELSE 'required' END
  || '","expected_value":"' || CASE WHEN c_custkey % 8 = 0 THEN '' ELSE '<5>' END || '","severity":"' || CASE WHEN c_custkey % 3 = 0 THEN 'WARN' WHEN c_custkey % 23 = 0 THEN 'fatal' ELSE '' END || '"}}]}}' END AS content
FROM customer"""


def _fixture(text: str, table: str) -> str:
    """Fixture text as Spark SQL with a table argument: other braces stay doubled."""
    return text.replace("{S}", "STRING").replace(f"FROM {table}", f"FROM {{{table}}}")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_fixture(SOURCES, "customer"), customer=spread(view(spark, sf_dir, "customer"), "c_custkey"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.validate_documents(sources(spark, sf_dir))


def versions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid documents as compiled versions, each active in its segment's scope."""
    df = verdicts(spark, sf_dir).where("valid").withColumn("set_id", F.concat(F.lit("set-"), F.col("c_custkey").cast("string"))).withColumn("version_id", F.concat(F.lit("ver-"), F.col("c_custkey").cast("string"))).withColumn("version", F.lit(1).cast("long"))
    return documents.compile_versions(df)


#: Config events: up to seven for every order, a version of its customer's set; some break the rules.
EVENTS = """
SELECT o_orderkey * 10 + k AS seq, event, CASE WHEN o_orderkey % 97 = 0 AND k = 1 THEN ' ' ELSE 'e' || CAST(o_orderkey * 10 + k AS {S}) END AS event_id,
  CAST(o_orderdate AS TIMESTAMP) + k * INTERVAL '1' HOUR AS occurred_at, 'set-' || CAST(o_custkey AS {S}) AS set_id, 'key-' || CAST(o_custkey AS {S}) AS config_key,
  'ver-' || CAST(o_orderkey AS {S}) AS version_id, CAST(1 AS BIGINT) AS version,
  CASE WHEN k = 4 AND o_orderkey % 19 = 0 THEN 'tenant' WHEN o_custkey % 5 = 0 THEN ' GLOBAL ' ELSE 'tenant' END AS scope_kind,
  CASE WHEN k = 4 AND o_orderkey % 19 = 0 THEN 'extra' WHEN o_custkey % 5 = 0 THEN '' ELSE 't' || CAST(o_custkey % 50 AS {S}) END AS scope_key,
  CASE WHEN event = 'config.activated' THEN CAST(o_orderdate AS TIMESTAMP) + k * INTERVAL '1' HOUR END AS activated_at,
  CASE WHEN event = 'config.deactivated' THEN CAST(o_orderdate AS TIMESTAMP) + k * INTERVAL '1' HOUR END AS deactivated_at
FROM (
  SELECT *, 0 AS k, 'config.draft_created' AS event FROM orders
  UNION ALL SELECT *, 1 AS k, 'config.validated' AS event FROM orders WHERE o_orderkey % 23 <> 0
  UNION ALL SELECT *, 2 AS k, 'config.compiled' AS event FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT *, 3 AS k, 'config.activated' AS event FROM orders WHERE o_orderkey % 11 > 1
  UNION ALL SELECT *, 4 AS k, 'config.activated' AS event FROM orders WHERE o_orderkey % 19 = 0
  UNION ALL SELECT *, 5 AS k, 'config.deactivated' AS event FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT *, 6 AS k, 'config.archived' AS event FROM orders WHERE o_orderkey % 14 = 0
  UNION ALL SELECT *, 7 AS k, 'config.rejected' AS event FROM orders WHERE o_orderkey % 11 = 0)"""


def config_events(spark: SparkSession, sf_dir: str, checked: bool = True) -> DataFrame:
    df = spark.sql(_fixture(EVENTS, "orders"), orders=view(spark, sf_dir, "orders"))
    return history.check_events(df)[0] if checked else df


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.activation_intervals(config_events(spark, sf_dir))


def versions(spark: SparkSession, sf_dir: str, intervals: DataFrame | None = None) -> DataFrame:
    """Versions with lifecycle, numbered in their set, and a small document."""
    e = config_events(spark, sf_dir)
    created = e.where("event = 'config.draft_created'").select("version_id", F.col("occurred_at").alias("created_at"), "seq")
    df = history.current_lifecycle(e, intervals).drop("version").join(created, "version_id")
    return history.number_versions(df).drop("seq", "updated_at")


def versions_with_documents(spark: SparkSession, sf_dir: str, intervals: DataFrame | None = None) -> DataFrame:
    """Versions whose document is that of a binding for each of two topics."""
    b = F.array(F.struct(F.lit("orders").alias("name"), F.concat(F.lit("t."), F.col("set_id")).alias("topic")), F.struct(F.lit("audit").alias("name"), F.lit("t.audit").alias("topic")))
    art = F.struct(F.concat(F.lit("artifact-"), F.col("version_id")).alias("id"), F.lit("runtime/v1").alias("schema_version"), F.md5("version_id").alias("checksum"), F.lit("memory://x").alias("storage_ref"), F.lit("validator:v1").alias("runtime_loader"), F.array(F.lit("rule.operator.required")).alias("capabilities"))
    fields = F.array(F.struct(F.lit("id").alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required")))
    rules = F.array(F.struct(F.lit("r").alias("name"), F.lit("id").alias("field"), F.lit("required").alias("operator"), F.lit("").alias("expected_value"), F.lit("error").alias("severity")))
    return versions(spark, sf_dir, intervals).withColumns({"bindings": b, "fields": fields, "rules": rules, "artifact": art, "definition_checksum": F.md5(F.concat(F.lit("d"), F.col("version_id")))})


def order_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: they are few, and bindings, runtimes and what compares them would each derive them anew from all events."""
    held = _written(intervals(spark, sf_dir).where("deactivated_at is null"), "open")
    return _written(history.runtime_projections(versions_with_documents(spark, sf_dir, held), held), "runtimes")


def _written(df: DataFrame, name: str) -> DataFrame:
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def order_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_topology(spark, sf_dir)[0]


def order_topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bindings, runtimes) of the versions of orders."""
    r = order_runtimes(spark, sf_dir)
    return history.ingestion_bindings(r), r


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_bindings(spark, sf_dir)
    return df.withColumn("route", topology.route_subject(F.col("scope_kind"), F.col("scope_key"), F.col("binding_name")))
