"""What changed between two snapshots of a table or of contracts, and how bad it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], format_before: int = 1, format_after: int = 1) -> DataFrame:
    """keys and change (added, removed or modified) of the rows that differ; ``changed`` lists their differing columns.

    Rows meet in one full outer join; values are compared null-safely.  Snapshots
    of different formats or columns are refused.
    """
    if format_before != format_after:
        raise ValueError("snapshots of different format versions cannot be compared")
    if set(before.columns) != set(after.columns):
        raise ValueError("snapshots have different columns")
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_a")) if rest else before.select(*keys, F.lit(True).alias("_a"))
    b = after.select(*keys, F.struct(*rest).alias("_b")) if rest else after.select(*keys, F.lit(True).alias("_b"))
    df = a.join(b, keys, "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in rest]).cast("array<string>"), lambda c: c.isNotNull())
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(differ) > 0, "modified")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return df.select(*keys, change.alias("change"), F.when(both, differ).otherwise(F.array().cast("array<string>")).alias("changed")).where("change is not null")


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.to_json(F.struct(*sorted(keys)), _EXACT)), F.lit(buckets)).cast("int"))


def bucket_digests(df: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """_bucket, rows, high, low: sums of 128-bit digests of the rows of each bucket of keys; no row order, so nothing is sorted or gathered."""
    digest = F.md5(F.to_json(F.struct(*sorted(df.columns)), _EXACT))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"))
    return _bucket(df, keys, buckets).groupBy("_bucket").agg(F.count("*").alias("rows"), half(1).alias("high"), half(17).alias("low"))


def write_snapshot(df: DataFrame, path: str, keys: list[str], buckets: int = 1024, format_version: int = 1) -> None:
    """A snapshot that ``diff_snapshots`` reads: rows in a folder for each bucket of keys, and the digests of all buckets."""
    _bucket(df, keys, buckets).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    named = bucket_digests(df, keys, buckets).select("*", F.lit(buckets).alias("buckets"), F.lit(format_version).alias("format"), F.lit(",".join(sorted(keys))).alias("keys"))
    named.coalesce(1).write.parquet(f"{path}/digests")


def differing_buckets(before: DataFrame, after: DataFrame) -> list[int]:
    """Buckets whose digests differ, sorted; there are no more of them than a snapshot has buckets."""
    names = ["rows", "high", "low"]
    a, b = (df.select("_bucket", F.struct(*names).alias(n)) for df, n in ((before, "_a"), (after, "_b")))
    return sorted(r[0] for r in a.join(b, "_bucket", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("_bucket").collect())


def diff_snapshots(spark: SparkSession, before: str, after: str, keys: list[str]) -> DataFrame:
    """``snapshot_diff`` of two written snapshots, over the buckets whose digests differ; files of others are not opened.

    Snapshots of other keys, numbers of buckets or formats are refused.
    """
    a, b = (spark.read.parquet(f"{p}/digests") for p in (before, after))
    kinds = {tuple(r) for df in (a, b) for r in df.select("buckets", "format", "keys").distinct().collect()}
    if len(kinds) > 1 or kinds and next(iter(kinds))[2] != ",".join(sorted(keys)):
        raise ValueError("snapshots of different keys, buckets or format versions cannot be compared")
    differ = differing_buckets(a, b)
    rows = [spark.read.parquet(f"{p}/rows").where(F.col("_bucket").isin(differ)).drop("_bucket") for p in (before, after)]
    return snapshot_diff(*rows, keys)


def diff_totals(diff: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return diff.agg(n("added"), n("removed"), n("modified"), (F.count("*") > 0).alias("has_changes"))


def field_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity, field, change (field_added, field_removed, type_changed), before_type, after_type for rows (entity, fields)."""
    one = lambda df, t: df.select("entity", F.inline(F.transform("fields", lambda f: F.struct(f["name"].alias("field"), f["type"].alias(t)))))
    df = one(before, "before_type").join(one(after, "after_type"), ["entity", "field"], "full_outer")
    change = F.when(F.col("before_type").isNull(), "field_added").when(F.col("after_type").isNull(), "field_removed").when(F.col("before_type") != F.col("after_type"), "type_changed")
    return df.withColumn("change", change).where("change is not null").select("entity", "field", "change", "before_type", "after_type")


def list_diff(before: DataFrame, after: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Elements that an array column gained and lost, by key; keys without a difference are left out."""
    a, b = before.select(*keys, F.col(col).alias("_a")), after.select(*keys, F.col(col).alias("_b"))
    none = F.array().cast(before.schema[col].dataType)
    x, y = F.coalesce("_a", none), F.coalesce("_b", none)
    df = a.join(b, keys, "full_outer").select(*keys, F.array_sort(F.array_except(y, x)).alias("added"), F.array_sort(F.array_except(x, y)).alias("removed"))
    return df.where((F.size("added") > 0) | (F.size("removed") > 0))


def classify_drift(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """entity, severity, reason: removed entities (of entity, change) are warnings, a changed kind and removed fields critical, changed types alone warnings, additions nothing."""
    f = fields.groupBy("entity").agg(F.bool_or(F.col("change") == "field_removed").alias("gone"), F.bool_or(F.col("change") == "type_changed").alias("typed"))
    f = f.select("entity", F.when(F.col("gone"), "critical").when(F.col("typed"), "warning").alias("severity"), F.when(F.col("gone"), "field removed").otherwise("type changed").alias("reason"))
    e = entities.select("entity", F.when(F.col("change") == "kind_changed", "critical").when(F.col("change") == "removed", "warning").alias("severity"), F.concat(F.lit("entity "), F.replace(F.col("change"), F.lit("_"), F.lit(" "))).alias("reason"))
    gone = entities.where("change = 'removed'").select("entity")
    return e.unionByName(f.join(gone, "entity", "left_anti")).where("severity is not null")


def drift_verdict(findings: DataFrame) -> DataFrame:
    """critical, warning and info counts, and verdict: drifted, mild or clean."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    df = findings.agg(n("critical"), n("warning"), n("info"))
    return df.withColumn("verdict", F.when(F.col("critical") > 0, "drifted").when(F.col("warning") > 0, "mild").otherwise("clean"))


def stats_delta(before: DataFrame, after: DataFrame, thresholds: dict[str, int], kind: str = "kind", without_rules: DataFrame | None = None, most_added: int = 3) -> DataFrame:
    """severity, kind, before, after, delta: kinds of entities whose number moved by more than their threshold, and a warning for many added entities (``without_rules``) that no rule set covers."""
    a, b = before.groupBy(kind).agg(F.count("*").alias("n_before")), after.groupBy(kind).agg(F.count("*").alias("n_after"))
    df = a.join(b, kind, "full_outer").na.fill(0, ["n_before", "n_after"]).withColumn("delta", F.col("n_after") - F.col("n_before"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col(kind)) if thresholds else F.lit(None)
    out = df.where(F.abs("delta") > F.coalesce(limit, F.lit(0))).select(F.lit("info").alias("severity"), F.col(kind).alias("kind"), "n_before", "n_after", "delta")
    if without_rules is not None:
        many = without_rules.agg(F.count("*").alias("n")).where(F.col("n") >= most_added)
        out = out.unionByName(many.select(F.lit("warning").alias("severity"), F.lit("added without rules").alias("kind"), F.lit(0).cast("long").alias("n_before"), F.col("n").alias("n_after"), F.col("n").alias("delta")))
    return out
