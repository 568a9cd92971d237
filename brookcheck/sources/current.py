"""The current result of each processing key as a table that is kept up, and logs that are kept to an age and a size.

The log of results (``write_results``) stays the truth.  The table is dealt by key into
``buckets`` folders; a batch reads and rewrites only the buckets that its keys fall into.  Results that come
twice, or late, change nothing: the greatest seq stands.  A bucket that was lost while it was being replaced
is made again from the log by ``rebuild_current``.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.results import latest_results
from ..operators.validate import processing_key

BUCKETS = 64


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def bucket(buckets: int = BUCKETS):
    key = F.coalesce(F.nullif(processing_key(F.col("processing_key")), F.lit("")), F.col("message_id"))
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge_results(batch: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Takes a batch of results with ``seq`` into the table at ``path`` and returns the buckets that it rewrote, sorted.

    A table keeps the number of buckets it was begun with.  An empty batch rewrites nothing.
    """
    spark = batch.sparkSession
    new = latest_results(batch).withColumn("bucket", bucket(buckets)).persist()
    try:
        # As many rows as there are buckets.
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if not touched:
            return []
        both = new
        if exists(spark, path):
            both = new.unionByName(spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)))
        merged = latest_results(both.drop("bucket")).withColumn("bucket", bucket(buckets))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return touched
    finally:
        new.unpersist()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def rebuild_current(log: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The table made anew from the whole log, and put in place of what is at ``path`` once it is whole."""
    spark = log.sparkSession
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    latest_results(log).withColumn("bucket", bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(beside)
    _delete(spark, path)
    at, fs = _path(spark, beside)
    fs.rename(at, _path(spark, path)[0])


def day_sizes(spark: SparkSession, path: str, day: str = "date") -> DataFrame:
    """(day, bytes) of a table partitioned by day: what its files take, found without reading rows."""
    files = spark.read.parquet(path).select(day, "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy(day).agg(F.sum("file_size").alias("bytes"))


def expired(sizes: DataFrame, hours: int = 24, most_bytes: int = 256 << 20, now: datetime.datetime | None = None, day: str = "date") -> DataFrame:
    """The days of ``sizes`` that go, with their bytes: those that end ``hours`` ago or before, and the oldest until no more than ``most_bytes`` are left.

    One row for each day is ordered; the newest day goes only by its age.
    """
    newest_first = W.orderBy(F.desc(day))
    running = F.sum("bytes").over(newest_first.rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = F.date_add(day, 1).cast("timestamp")
    old = ends <= (F.current_timestamp() if now is None else F.lit(now)) - F.make_interval(hours=F.lit(hours))
    sizes = sizes.withColumn("_running", running).withColumn("_rank", F.row_number().over(newest_first))
    return sizes.where(old | ((F.col("_running") > most_bytes) & (F.col("_rank") > 1))).select(day, "bytes")


def retain_days(spark: SparkSession, path: str, hours: int = 24, most_bytes: int = 256 << 20, now: datetime.datetime | None = None, day: str = "date") -> list[datetime.date]:
    """Deletes the folders of the days that expire; returns those days, sorted."""
    gone = sorted(r[day] for r in expired(day_sizes(spark, path, day), hours, most_bytes, now, day).where(F.col(day).isNotNull()).collect())
    for d in gone:
        _delete(spark, f"{path.rstrip('/')}/{day}={d.isoformat()}")
    return gone
