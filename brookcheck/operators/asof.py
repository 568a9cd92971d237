"""As-of joins: each row with the last row of its key that is not after it.

Keys may be as few as one, so neither side is windowed by key.  Positions are cut
into buckets of ``width``.  In a bucket a row on the right reaches to
the next one there; what was last before the bucket is carried in, found among
one row for each bucket.  Rows on the left then meet
the stretches of their own key and bucket alone, one of which holds them: an
equi-join with a range, which adaptive execution splits where one key has a great share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def carried(ends: DataFrame, by: list[str], value: str, forward: bool = True) -> DataFrame:
    """``value`` of ``ends`` (one row for each ``by`` and ``bucket``) of the last bucket before each, or the next after it, that has one."""
    order = F.asc("bucket") if forward else F.desc("bucket")
    return ends.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: Column, start: Column, order: list[Column], width: int, name: str) -> DataFrame:
    """``left`` with ``name``, the row (struct) of ``right`` with the same ``by`` and the greatest ``start``, then ``order``, that is not above ``at``; null where there is none.

    ``at`` and ``start`` are BIGINT.  Rows of ``right`` with a null in ``by`` or ``start`` match nothing, rows of ``left`` with one there get null.
    ``width`` is a stretch of positions in which a key has few rows on the right: a row on the left is held against each of them.
    """
    key = [f"_{i}" for i in range(len(by))]
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    r = right.select(*[F.col(b).alias(k) for b, k in zip(by, key, strict=True)], start.alias("_start"), F.struct(*order).alias("_order"), F.struct(*right.columns).alias(name)).where("_start is not null").withColumn("bucket", bucket(F.col("_start")))
    l = left.select("*", *[F.col(b).alias(k) for b, k in zip(by, key, strict=True)], at.alias("_at")).withColumn("bucket", bucket(F.col("_at")))  # noqa: E741
    inside = W.partitionBy(*key, "bucket").orderBy("_start", "_order")
    own = r.withColumn("_end", F.coalesce(F.lead("_start").over(inside), F.lit(_HIGH))).where("_start < _end")
    # One row for each bucket that either side has: the last row of the right there, and with it what came before the bucket and where its own rows begin.
    ends = r.groupBy(*key, "bucket").agg(F.max_by(name, F.struct("_start", "_order")).alias(name), F.min("_start").alias("_end"))
    needed = l.where("_at is not null").select(*key, "bucket").distinct().withColumn(name, F.lit(None).cast(r.schema[name].dataType)).withColumn("_end", F.lit(None).cast("long"))
    ends = ends.unionByName(needed).groupBy(*key, "bucket").agg(F.first(name, ignorenulls=True).alias(name), F.coalesce(F.first("_end", ignorenulls=True), F.lit(_HIGH)).alias("_end"))
    before = carried(ends, key, name).where(F.col(name).isNotNull()).withColumn("_start", F.lit(_LOW).cast("long"))
    cols = [*key, "bucket", "_start", "_end", name]
    stretches = own.select(*cols).unionByName(before.select(*cols)).toDF(*[f"r{c}" for c in key], "rbucket", "_start", "_end", name)
    met = (F.col("bucket") == F.col("rbucket")) & (F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end"))
    for k in key:
        met = met & (F.col(k) == F.col(f"r{k}"))
    return l.join(stretches, met, "left").select(*left.columns, name)
