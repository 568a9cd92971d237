"""Sources and sinks: Kafka where its connector is there, files of the same shape elsewhere."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once, problem, unicode_trim
from ..operators.history import check_events
from ..schemas import INVALID, RECORD

EVENT = "seq bigint, event string, event_id string, occurred_at timestamp, correlation_id string, set_id string, config_key string, version_id string, version bigint, scope_kind string, scope_key string, activated_at timestamp, deactivated_at timestamp, reason string"


def read_records(spark: SparkSession, source: dict, topics: list[str], streaming: bool = False) -> DataFrame:
    """Records of ``topics``: ``source`` is {"format": "kafka", options…} or {"format": "parquet" or "json", "path": …}."""
    options = {k: v for k, v in source.items() if k not in ("format", "path")}
    reader = (spark.readStream if streaming else spark.read).format(source["format"]).options(**options)
    if source["format"] != "kafka":
        return reader.schema(RECORD).load(source["path"]).where(F.col("topic").isin(*topics))
    df = reader.option("subscribe", ",".join(sorted(topics))).option("includeHeaders", "true").load()
    headers = F.map_from_entries(F.transform(F.coalesce("headers", F.array()), lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return df.select("topic", F.col("key").cast("string"), F.col("value").cast("string").alias("payload"), headers.alias("headers"), "partition", "offset", F.col("timestamp").alias("published_at"))


def read_topics(spark: SparkSession, source: dict, topics: list[str], streaming: bool = False) -> DataFrame:
    """Records of ``topics`` from a folder for each (``topic=…`` under ``source["path"]``): files of other topics are not read, and not marked as read either.

    A query that is started again on its checkpoint with further topics thus finds theirs from the first file on, as it does with a broker.
    """
    if source["format"] == "kafka":
        return read_records(spark, source, topics, streaming)
    options = {k: v for k, v in source.items() if k not in ("format", "path")}
    reader = (spark.readStream if streaming else spark.read).format(source["format"]).options(**options).option("basePath", source["path"])
    names = ",".join("".join(f"\\{c}" if c in "{},*?[]\\" else c for c in t) for t in sorted(topics))
    df = reader.schema(RECORD).load(f"{source['path'].rstrip('/')}/topic={{{names}}}")
    return df.select(*[c.split()[0] for c in RECORD.split(", ") if not c.startswith("string")])


def read_config_events(spark: SparkSession, path: str, streaming: bool = False, format: str = "parquet") -> DataFrame | tuple[DataFrame, DataFrame]:
    """(events, rejects) of an event log."""
    return check_events((spark.readStream if streaming else spark.read).format(format).schema(EVENT).load(path))


def write_messages(df: DataFrame, path: str, mode: str = "append") -> None:
    """A folder for each route."""
    df.write.mode(mode).partitionBy("route").parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """An append log by day; ``latest_results`` is its current view."""
    df.withColumn("date", F.to_date("processed_at")).write.mode(mode).partitionBy("date").parquet(path)


def write_rejects(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def outgoing_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): topic, header names and header values trimmed, headers without a name dropped, published_at now where it is null; a record without topic is refused."""
    pairs = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(unicode_trim(e["key"]).alias("key"), unicode_trim(F.coalesce(e["value"], F.lit(""))).alias("value")))
    df = once(df, _pairs=F.filter(pairs, lambda e: e["key"] != ""))
    later = lambda i: F.slice("_pairs", i + 2, F.greatest(F.size("_pairs") - i - 1, F.lit(0)))
    last = F.filter("_pairs", lambda e, i: ~F.exists(later(i), lambda o: o["key"] == e["key"]))
    df = df.withColumn("topic", unicode_trim(F.coalesce("topic", F.lit("")))).withColumn("headers", F.map_from_entries(last)).withColumn("published_at", F.coalesce("published_at", F.current_timestamp())).drop("_pairs")
    return df.where("topic <> ''"), df.where("topic = ''").withColumn("problem", problem(INVALID, "topic is required"))


def write_records(df: DataFrame, target: dict, mode: str = "append") -> DataFrame:
    """Writes records with key, headers and time to Kafka, or to files; returns those refused.

    Spark's Kafka sink cannot set a record's time: it goes along as the header ``published_at``, in ISO 8601.
    """
    df, refused = outgoing_records(df)
    if target["format"] == "kafka":
        for_kafka(df).write.format("kafka").options(**{k: v for k, v in target.items() if k != "format"}).save()
    else:
        # Text formats would cut times to milliseconds.
        df.write.mode(mode).format(target["format"]).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(target["path"])
    return refused


def for_kafka(df: DataFrame) -> DataFrame:
    """topic, key, value and headers as Spark's Kafka sink takes them."""
    time = F.struct(F.lit("published_at").alias("key"), F.date_format(F.to_utc_timestamp("published_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").cast("binary").alias("value"))
    headers = F.transform(F.map_entries(F.map_filter("headers", lambda k, v: k != "published_at")), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
    return df.select("topic", "key", F.col("payload").alias("value"), F.concat(headers, F.array(time)).alias("headers"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or in local mode a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='brookcheck-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
