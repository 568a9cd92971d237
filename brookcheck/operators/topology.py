"""Bindings by topic, routes, and drift between bindings and runtimes.

Bindings have binding_name, topic and a runtime's columns: scope_kind,
scope_key, set_id, config_key, version_id, version, definition_checksum and
artifact.  Runtimes have the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, issues, problem, token, unicode_trim
from ..schemas import CONFLICT, EMPTY, INVALID

ROUTE = "dataplane.ingestion.received"


def route_subject(kind: Column, key: Column, name: Column) -> Column:
    return F.concat_ws(".", F.lit(ROUTE), token(kind), token(key), token(name))


def binding_index(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings in order, rejects): required parts, and one binding of a name for a scope and version."""
    need = [("binding.topic", "topic"), ("binding.name", "binding_name"), ("runtime.scope.kind", "scope_kind"), ("runtime.scope.key", "scope_key"), ("runtime.config.version_id", "version_id")]
    found = issues(*[(f, blank(F.col(c)), EMPTY) for f, c in need])
    key = [unicode_trim(F.col(c)) for c in ("scope_kind", "scope_key", "version_id", "binding_name")]
    df = bindings.withColumn("_issues", found).withColumn("_twice", F.count("*").over(W.partitionBy(*key)) > 1)
    bad = F.when(F.size("_issues") > 0, problem(INVALID, "active ingestion binding is invalid", found=F.col("_issues"))).when(F.col("_twice"), problem(CONFLICT, "duplicate active ingestion binding"))
    df = df.withColumn("problem", bad).drop("_issues", "_twice")
    ok = df.where("problem is null").drop("problem").orderBy("topic", "scope_kind", "scope_key", "binding_name", "version_id")
    return ok, df.where("problem is not null")


def topic_topology(bindings: DataFrame) -> DataFrame:
    """topic, n_bindings, bindings (sorted structs of scope, name and version).

    A row holds all bindings of its topic, as is asked for: of a topic that very many
    versions bind, take ``binding_index`` instead, which has a row for each.
    """
    one = F.struct("scope_kind", "scope_key", "binding_name", "version_id")
    return bindings.groupBy(unicode_trim(F.col("topic")).alias("topic")).agg(F.count("*").alias("n_bindings"), F.sort_array(F.collect_list(one)).alias("bindings"))


_PARTS = ("scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "definition_checksum", "artifact.id", "artifact.schema_version", "artifact.checksum", "artifact.storage_ref", "artifact.runtime_loader")
_NEEDED = ("scope_kind", "scope_key", "version_id", "definition_checksum", "artifact.id", "artifact.checksum", "artifact.runtime_loader")


def runtime_identity() -> Column:
    """Twelve trimmed parts joined by ``|``; null where a needed one is blank."""
    key = F.concat_ws("|", *[unicode_trim(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in _PARTS])
    missing = F.lit(False)
    for p in _NEEDED:
        missing = missing | blank(F.col(p))
    return F.when(~missing, key)


def runtime_drift(bindings: DataFrame, runtimes: DataFrame) -> DataFrame:
    """problem, identity: bindings whose runtime the summary lacks, runtimes without binding, and rows whose identity is incomplete."""
    # Each side is read once: four joins and filters would read both several times.
    side = lambda df, bound: df.select(runtime_identity().alias("identity"), F.lit(bound).alias("bound"))
    seen = side(bindings, True).unionByName(side(runtimes, False)).groupBy("identity").agg(F.bool_or("bound").alias("b"), F.bool_or(~F.col("bound")).alias("r"))
    known = F.col("identity").isNotNull()
    found = F.array(F.when(known & ~F.col("r"), "runtime_missing"), F.when(known & ~F.col("b"), "runtime_without_binding"), F.when(~known & F.col("b"), "binding_runtime_invalid"), F.when(~known & F.col("r"), "runtime_invalid"))
    return seen.select(F.explode(F.array_compact(found)).alias("problem"), "identity")


def _order(df: DataFrame) -> DataFrame:
    return df.orderBy("scope_kind", "scope_key", "version_id", "definition_checksum", "artifact.id", "artifact.checksum")


def canonical_runtimes(bindings: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """The runtimes in order; without a summary those of the bindings, each once."""
    if runtimes is not None and not runtimes.isEmpty():
        return _order(runtimes)
    df = bindings.drop("binding_name", "topic", "fields").withColumn("_key", runtime_identity())
    return _order(df.dropDuplicates(["_key"]).drop("_key"))


def runtime_signature(bindings: DataFrame, runtimes: DataFrame) -> DataFrame:
    """``signature``: one hash that changes with any row, whatever their order."""
    caps = F.array_join("artifact.capabilities", ",")
    parts = [unicode_trim(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in ("scope_kind", "scope_key", "set_id", "config_key", "version_id", "version", "definition_checksum", "artifact.id", "artifact.schema_version", "artifact.checksum", "artifact.storage_ref", "artifact.runtime_loader")]
    r = runtimes.select(F.concat_ws("|", F.lit("runtime"), *parts, caps).alias("line"))
    b = bindings.select(F.concat_ws("|", F.lit("binding"), *parts, caps, unicode_trim(F.col("binding_name")), unicode_trim(F.col("topic"))).alias("line"))
    digest = F.md5("line")
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    # Sums of digests don't depend on the order of rows and are made where the rows are.
    return r.unionByName(b).agg(F.when(F.count("*") > 0, F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13)), 256)).otherwise("").alias("signature"))


def runtime_refs(runtimes: DataFrame) -> DataFrame:
    return _order(runtimes).select(F.concat_ws(":", *[unicode_trim(F.col(c)) for c in ("scope_kind", "scope_key", "version_id", "artifact.id")]).alias("ref"))


def topology_changed(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """side (removed or added) and ref of runtimes that differ between two loads of (bindings, runtimes)."""
    a, b = runtime_refs(before[1]), runtime_refs(after[1])
    return a.exceptAll(b).select(F.lit("removed").alias("side"), "ref").unionByName(b.exceptAll(a).select(F.lit("added").alias("side"), "ref"))


def stale_runtimes(bindings: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Scopes with active bindings and no loaded runtime."""
    return bindings.select("scope_kind", "scope_key").distinct().join(runtimes.select("scope_kind", "scope_key").distinct(), ["scope_kind", "scope_key"], "left_anti")
