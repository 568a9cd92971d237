"""Config documents: parse, normalise, diagnose, checksum, compile."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import blank, canonical_json, issues, once, or_else, unicode_trim
from ..schemas import DOCUMENT, EMPTY, FIELD_TYPES, ISSUES, OPERATORS, SEVERITIES


def normalize_sources(df: DataFrame) -> DataFrame:
    """``format`` in lower case and trimmed, ``content`` trimmed, and ``source_issues`` of blank content or another format than json and yaml."""
    df = df.withColumn("format", F.lower(unicode_trim(F.coalesce("format", F.lit(""))))).withColumn("content", unicode_trim(F.coalesce("content", F.lit(""))))
    return df.withColumn("source_issues", issues(("source.content", F.col("content") == "", EMPTY), ("source.format", ~F.col("format").isin("json", "yaml"), "must be one of json or yaml")))


def source_checksum(fmt: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", fmt, content), 256)


@F.pandas_udf(StringType())
def _yaml_to_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import json

    import yaml

    # The same loader in C, where PyYAML is built with it: six times faster.
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text):
        try:
            value = yaml.load(text, Loader=loader)
            return json.dumps(value, default=str) if isinstance(value, dict) else None
        except Exception:
            return None

    for s in batches:
        yield s.map(one, na_action="ignore")


def parse_documents(df: DataFrame) -> DataFrame:
    """The members of the document in ``content``, and ``parse_issues`` where its text or the type of a known member is wrong.

    YAML goes through a pandas UDF that writes JSON; only its rows do.
    """
    text = F.when(F.col("format") == "yaml", F.col("_yaml")).otherwise(F.col("content"))
    yaml = df.where("format = 'yaml'").withColumn("_yaml", _yaml_to_json("content"))
    rest = df.where("format is null or format <> 'yaml'").withColumn("_yaml", F.lit(None).cast("string"))
    df = rest.unionByName(yaml).withColumn("_json", text).drop("_yaml")
    parsed = F.from_json("_json", DOCUMENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = once(df, _doc=parsed)
    ok = F.col("_json").isNotNull() & F.col("_doc").isNotNull() & F.col("_doc._bad").isNull() & F.coalesce(F.schema_of_variant(F.try_parse_json("_json")).startswith("OBJECT"), F.lit(False))
    what = F.when(F.col("format") == "yaml", "must be valid YAML").otherwise("must be valid JSON")
    wrong = F.array(F.struct(F.lit("source.content").alias("field"), what.alias("message")))
    df, ok = once(df, _ok=ok), F.col("_ok")
    members = [F.when(ok, F.col(f"_doc.{m}")).alias(m) for m in ("metadata", "bindings", "fields", "rules")]
    return df.select(*[c for c in df.columns if c not in ("_json", "_doc", "_ok")], *members, F.when(ok, F.array().cast(ISSUES)).otherwise(wrong).alias("parse_issues"))


def _clean(c: Column) -> Column:
    return unicode_trim(F.coalesce(c, F.lit("")))


def normalize_documents(df: DataFrame) -> DataFrame:
    """Every string trimmed; type, operator and severity in lower case; labels with a blank key or value dropped."""
    labels = F.col("metadata.labels")
    pairs = F.transform(F.map_entries(labels), lambda e: F.struct(_clean(e["key"]).alias("key"), _clean(e["value"]).alias("value")))
    df = once(df, _pairs=F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != "")))
    # Keys that trimming makes equal: the last wins.
    later = lambda i: F.slice("_pairs", i + 2, F.greatest(F.size("_pairs") - i - 1, F.lit(0)))
    last = F.filter("_pairs", lambda e, i: ~F.exists(later(i), lambda o: o["key"] == e["key"]))
    labels = F.when(labels.isNotNull(), F.map_from_entries(last))
    meta = F.struct(_clean(F.col("metadata.name")).alias("name"), _clean(F.col("metadata.description")).alias("description"), labels.alias("labels"))
    of = lambda arr, one: F.when(F.col(arr).isNotNull(), F.transform(arr, one))
    low = lambda c: F.lower(_clean(c))
    made = {"metadata": meta,
            "bindings": of("bindings", lambda b: F.struct(_clean(b["name"]).alias("name"), _clean(b["topic"]).alias("topic"))),
            "fields": of("fields", lambda f: F.struct(_clean(f["name"]).alias("name"), low(f["type"]).alias("type"), F.coalesce(f["required"], F.lit(False)).alias("required"))),
            "rules": of("rules", lambda r: F.struct(_clean(r["name"]).alias("name"), _clean(r["field"]).alias("field"), low(r["operator"]).alias("operator"), _clean(r["expected_value"]).alias("expected_value"), low(r["severity"]).alias("severity")))}
    out = once(df, **{f"_{m}": c for m, c in made.items()})
    return out.select(*[F.col(f"_{c}").alias(c) if c in made else c for c in df.columns if c != "_pairs"])


def _each(array: str, prefix: str, checks) -> Column:
    """Issues of all elements; ``checks(element, earlier elements)`` gives (suffix, failing condition, message)."""
    arr = F.coalesce(F.col(array), F.array())

    def one(x, i):
        path = F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit("]."))
        found = [F.when(bad, F.struct(F.concat(path, F.lit(suffix)).alias("field"), F.lit(message).alias("message"))) for suffix, bad, message in checks(x, F.slice(arr, F.lit(1), i))]
        return F.filter(F.array(*found), lambda d: d.isNotNull())

    return F.flatten(F.transform(arr, one))


def diagnose_documents(df: DataFrame) -> DataFrame:
    """``diagnostics`` of normalised documents, in the order in which they are checked; paths and messages are fixed values."""
    seen = lambda before, member, value: (value != "") & F.exists(before, lambda o: o[member] == value)
    names = F.transform(F.coalesce(F.col("fields"), F.array()), lambda f: f["name"])
    top = F.array(
        F.when(F.coalesce(F.col("metadata.name"), F.lit("")) == "", F.struct(F.lit("metadata.name").alias("field"), F.lit(EMPTY).alias("message"))),
        *[F.when(F.coalesce(F.size(m), F.lit(0)) <= 0, F.struct(F.lit(m).alias("field"), F.lit(f"must contain at least one {m[:-1]}").alias("message"))) for m in ("bindings", "fields", "rules")])
    bindings = _each("bindings", "bindings", lambda b, before: [
        ("name", b["name"] == "", EMPTY), ("topic", b["topic"] == "", EMPTY),
        ("name", seen(before, "name", b["name"]), "must be unique"), ("topic", seen(before, "topic", b["topic"]), "must be unique")])
    fields = _each("fields", "fields", lambda f, before: [
        ("name", f["name"] == "", EMPTY), ("type", ~f["type"].isin(*FIELD_TYPES), "must be one of string, integer, number, boolean or timestamp"),
        ("name", seen(before, "name", f["name"]), "must be unique")])
    rules = _each("rules", "rules", lambda r, before: [
        ("name", r["name"] == "", EMPTY), ("field", r["field"] == "", EMPTY),
        ("field", (r["field"] != "") & ~F.array_contains(F.filter(names, lambda n: n != ""), r["field"]), "must reference an existing field"),
        ("operator", ~r["operator"].isin(*OPERATORS), "must be one of required, not_empty or equals"),
        ("severity", ~r["severity"].isin("", *SEVERITIES), "must be one of error or warn"),
        ("expected_value", (r["operator"] == "equals") & (r["expected_value"] == ""), "must not be empty when operator is equals"),
        ("name", seen(before, "name", r["name"]), "must be unique")])
    return once(df, diagnostics=F.concat(F.filter(top, lambda d: d.isNotNull()), bindings, fields, rules))


def definition_checksum() -> Column:
    """SHA-256 of the canonical JSON of the members of a normalised document."""
    return F.sha2(canonical_json(), 256)


def validate_documents(df: DataFrame) -> DataFrame:
    """From sources to verdicts: ``valid``, ``diagnostics`` (those of the source, of parsing, or of the document) and, if valid, ``definition_checksum``."""
    df = diagnose_documents(normalize_documents(parse_documents(normalize_sources(df))))
    early = F.concat("source_issues", F.when(F.size("source_issues") > 0, F.array().cast(ISSUES)).otherwise(F.col("parse_issues")))
    df = once(df, _found=F.when(F.size(early) > 0, early).otherwise(F.col("diagnostics"))).drop("source_issues", "parse_issues", "diagnostics").withColumnRenamed("_found", "diagnostics")
    df = df.withColumn("valid", F.size("diagnostics") == 0)
    return once(df, definition_checksum=F.when(F.col("valid"), definition_checksum()))


def capabilities(rules: Column) -> Column:
    """Sorted distinct ``rule.operator.*`` of the rules."""
    ops = F.filter(F.transform(rules, lambda r: F.lower(_clean(r["operator"]))), lambda o: o != "")
    return F.array_sort(F.array_distinct(F.transform(ops, lambda o: F.concat(F.lit("rule.operator."), o))))


def normalize_capabilities(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(arr, _clean), lambda c: c != "")))


def supports_operator(caps: Column, operator: Column) -> Column:
    return F.array_contains(normalize_capabilities(caps), F.concat(F.lit("rule.operator."), F.lower(_clean(operator))))


def compile_versions(df: DataFrame) -> DataFrame:
    """``artifact`` and ``artifact_issues`` for versions (set_id, version_id, format, content, document members, definition_checksum).

    Columns artifact_id, schema_version, storage_ref, runtime_loader and compiler_version are taken where they are given and not blank.
    """
    given = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    sums = F.sha2(F.concat_ws(":", source_checksum(F.col("format"), F.col("content")), F.col("definition_checksum")), 256)
    art = F.struct(
        or_else(given("artifact_id"), F.concat(F.lit("artifact-"), F.col("version_id"))).alias("id"),
        or_else(given("schema_version"), F.lit("runtime/v1")).alias("schema_version"), sums.alias("checksum"),
        or_else(given("storage_ref"), F.concat(F.lit("memory://configctl/artifacts/"), F.col("set_id"), F.lit("/"), F.col("version_id"))).alias("storage_ref"),
        or_else(given("runtime_loader"), F.lit("validator:v1")).alias("runtime_loader"), capabilities(F.col("rules")).alias("capabilities"),
        or_else(given("compiler_version"), F.lit("configctl-sync/v1")).alias("compiler_version"))
    checks = [(f"artifact.{n}", blank(F.col(f"artifact.{n}")), EMPTY) for n in ("id", "schema_version", "checksum", "storage_ref", "runtime_loader")]
    return once(df, artifact=art).withColumn("artifact_issues", issues(*checks))
