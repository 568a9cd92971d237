"""Registered queries that run a stream to its end over files and return what it left."""

from __future__ import annotations

import datetime
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import history, ingest, results, validate
from ..schemas import RECORD
from ..sources import current, files
from ..sources.files import read_records, read_topics, shared_folder
from ..streaming import incidents, live, pipeline, redelivery, runtime_state
from . import fixtures as fx
from . import sql as q
from .queries import register, us, violations_text

def _files(spark, d, parts):
    """In how many files each of ``parts`` of the records is written, to be a micro-batch that all cores work on; one where there are few."""
    return max(1, min(3 * spark.sparkContext.defaultParallelism, fx.view(spark, d, "events").count() // (20_000 * parts)))


def _salts(spark):
    """Parts of a keyed state, several for each core."""
    return 4 * spark.sparkContext.defaultParallelism


#: Records in a file that a stream reads, at most: with a bound on files, what a micro-batch holds does not grow with the table.
_MOST_RECORDS = 50_000


_TOPICS = [f"events.{t}" for t in ("click", "error", "purchase", "signup", "view")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@register(f"WITH {q.LATEST} SELECT processing_key, status, violations, epoch_us(processed_at - INTERVAL 1 SECOND) AS processed_at FROM latest")
def stream_results(spark, d):
    """The whole pipeline as one streaming query; results are read from its sink."""
    at = shared_folder(spark, "stream")
    fx.records(spark, d).select(*[c.split()[0] for c in RECORD.split(", ") if not c.startswith("string")]).write.parquet(f"{at}/in")
    b, r = fx.bindings(spark), fx.runtimes(spark)
    records = read_records(spark, {"format": "parquet", "path": f"{at}/in"}, _TOPICS, streaming=True)
    pipeline.start_pipeline(records, lambda: (b, r), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return results.latest_results(spark.read.parquet(f"{at}/out/results").drop("date", "batch"), ["processing_key", "status", "violations", "processed_at"]).select("processing_key", "status", violations_text(), us("processed_at"))


@register(f"WITH {q.LATEST} SELECT processing_key, status, violations FROM latest")
def resumed_results(spark, d):
    """The pipeline fails in its second batch of three, when all is written and before that is noted, and is started again on its checkpoint."""
    at = shared_folder(spark, "resume")
    df = fx.records(spark, d).select(*[c.split()[0] for c in RECORD.split(", ") if not c.startswith("string")])
    n = _files(spark, d, 3)
    for part in range(3):
        df.where(F.col("offset") % 3 == part).repartition(n).write.mode("append").parquet(f"{at}/in")
    b, r = fx.bindings(spark), fx.runtimes(spark)
    failures = []

    def fail(batch_id):
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("killed")

    for _ in range(2):
        records = read_records(spark, {"format": "parquet", "path": f"{at}/in", "maxFilesPerTrigger": n}, _TOPICS, streaming=True)
        query = pipeline.start_pipeline(records, lambda: (b, r), f"{at}/out", f"{at}/checkpoint", written=fail)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if failures != [1]:
                raise
    return results.latest_results(pipeline.committed(spark, f"{at}/out", "results").drop("date", "batch"), ["processing_key", "status", "violations"]).select("processing_key", "status", violations_text())


@register(f"WITH {q.LATEST} SELECT processing_key, status, violations FROM latest")
def follow_topics(spark, d):
    """Two topics are bound at first and the others while the stream runs: their records are read from the start, the rest not again."""
    at = shared_folder(spark, "follow")
    fx.records(spark, d).select(*[c.split()[0] for c in RECORD.split(", ") if not c.startswith("string")]).write.partitionBy("topic").option("maxRecordsPerFile", _MOST_RECORDS).parquet(f"{at}/in")
    b, r = fx.bindings(spark), fx.runtimes(spark)
    asked = [b.where("topic in ('events.click', 'events.view')"), b]
    bound, queries = [], []

    def topics():
        bound.append(asked.pop(0) if asked else b)
        return pipeline.topics_of(bound[-1])

    def start(names):
        records = read_topics(spark, {"format": "parquet", "path": f"{at}/in", "maxFilesPerTrigger": 9 * spark.sparkContext.defaultParallelism}, names, streaming=True)
        queries.append(pipeline.start_pipeline(records, lambda: (bound[-1], r), f"{at}/out", f"{at}/checkpoint"))
        return queries[-1]

    # Between two questions each query reads all there is.
    pipeline.follow_topics(start, topics, ended=lambda: len(queries) == 2 and queries[-1].awaitTermination() is None, sleep=lambda _: queries[-1].awaitTermination())
    return results.latest_results(pipeline.committed(spark, f"{at}/out", "results").drop("date", "batch"), ["processing_key", "status", "violations"]).select("processing_key", "status", violations_text())


@register(f"WITH {q.LATEST} SELECT processing_key, status, violations FROM latest")
def refresh_topology(spark, d):
    """Two micro-batches; the second refresh fails, and the topology of the first stays."""
    at = shared_folder(spark, "refresh")
    df = fx.records(spark, d).select(*[c.split()[0] for c in RECORD.split(", ") if not c.startswith("string")])
    n = _files(spark, d, 2)
    for part in (0, 1):
        df.where(F.col("offset") % 2 == part).repartition(n).write.mode("append").parquet(f"{at}/in")
    loaded = [(fx.bindings(spark), fx.runtimes(spark))]
    records = read_records(spark, {"format": "parquet", "path": f"{at}/in", "maxFilesPerTrigger": n}, _TOPICS, streaming=True)
    pipeline.start_pipeline(records, loaded.pop, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return results.latest_results(spark.read.parquet(f"{at}/out/results").drop("date", "batch"), ["processing_key", "status", "violations"]).select("processing_key", "status", violations_text())


@register(f"WITH {q.MSG} SELECT message_id, seq, 'dataplane.ingestion.received.' || scope_kind || '.' || scope_key || '.' || binding_name AS route FROM mj WHERE j IS NOT NULL")
def write_messages(spark, d):
    """Messages as they come back from their sink, a folder for each route."""
    at = shared_folder(spark, "messages")
    files.write_messages(fx.valid_messages(spark, d).drop("headers"), at)
    return spark.read.parquet(at).select("message_id", "seq", "route")


@register(f"WITH {q.REC} SELECT topic, coalesce(correlation_header, '') AS correlation, off AS \"offset\", epoch_us(published_at) AS published_at FROM rec WHERE off % 11 <> 0")
def write_records(spark, d):
    """Records as they come back from the sink; those without topic are refused."""
    at = shared_folder(spark, "records")
    df = fx.records(spark, d).withColumn("topic", F.when(F.col("offset") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "topic"))).drop("seq")
    files.write_records(df, {"format": "json", "path": at})
    back = read_records(spark, {"format": "json", "path": at}, _TOPICS)
    return back.select("topic", F.coalesce(F.try_element_at("headers", F.lit("X-Correlation-Id")), F.lit("")).alias("correlation"), "offset", us("published_at"))


@register(f"WITH {q.MSG} SELECT message_id, seq, 'VAL_INVALID_ARGUMENT' AS code FROM mj WHERE j IS NULL")
def write_rejects(spark, d):
    """Rejected messages as they come back from their sink."""
    at = shared_folder(spark, "rejects")
    files.write_rejects(ingest.validate_messages(fx.messages(spark, d))[1], at)
    return spark.read.parquet(at).select("message_id", "seq", "problem.code")


def _changes(spark, d):
    kind, key = history.scope(F.col("scope_kind"), F.col("scope_key"))
    e = fx.config_events(spark, d).where("event in ('config.activated', 'config.deactivated')").withColumn("at", F.coalesce("activated_at", "deactivated_at"))
    change = F.when(F.col("event") == "config.activated", "activated").otherwise("cleared")
    # Arrival in order of time.
    seq = F.expr("unix_seconds(at) div 3600 * 1000000000") + F.col("seq")
    return e.select(seq.alias("seq"), change.alias("change"), "at", kind.alias("scope_kind"), key.alias("scope_key"), "set_id", "version_id")


def _drained(spark, df, name, mode):
    """All rows a stateful query emits."""
    at = shared_folder(spark, name)
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/out/batch={i}")
    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


class _rocks:
    """The session as keyed state needs it, as long as a query starts: its state store, and no batches without data, which timers would ask for without end."""

    SET = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in self.SET}
        for k, v in self.SET.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


def _turns(spark, d):
    """(changes, messages, runtimes): an old version is loaded a quarter through, cleared halfway, and the present one loaded after three quarters."""
    now = fx.runtimes(spark)
    both = now.unionByName(now.withColumn("version_id", F.concat("version_id", F.lit("0"))))
    top = fx.view(spark, d, "events").agg(F.max("event_id").alias("top"))
    steps = spark.createDataFrame([(1, "activated", "0"), (2, "cleared", "0"), (3, "activated", "")], "step int, change string, old string")
    c = now.select("scope_kind", "scope_key", "set_id", "version_id", "activated_at").crossJoin(F.broadcast(steps)).crossJoin(F.broadcast(top))
    c = c.select(F.expr("step * (top div 4)").alias("seq"), "change", (F.col("activated_at") + F.make_dt_interval(hours="step")).alias("at"), "scope_kind", "scope_key", "set_id", F.concat("version_id", "old").alias("version_id"))
    return live.with_runtimes(c, both), fx.valid_messages(spark, d).drop("headers"), both


def _turns_out(df):
    outcome = F.coalesce("problem.code", F.when(F.size("violations") == 0, "passed").otherwise("failed")).alias("outcome")
    return df.select("message_id", "seq", "loaded", "waited", outcome)


def _judged(turns):
    known = turns.select(F.col("message_id").alias("_id"), F.col("seq").alias("_seq"), F.col("runtime.version_id").alias("loaded"), "waited")
    return live.judge_turns(turns).join(known, (F.col("message_id") == F.col("_id")) & (F.col("seq") == F.col("_seq")))


_LIVE = f"""WITH {q.RES}, top AS (SELECT max(event_id) // 4 AS quarter FROM events)
SELECT mj.message_id, mj.seq, mj.version_id || CASE WHEN mj.seq <= 2 * quarter THEN '0' ELSE '' END AS loaded, mj.seq <= quarter OR mj.seq > 2 * quarter AND mj.seq <= 3 * quarter AS waited,
  CASE WHEN mj.seq <= 2 * quarter THEN 'SYS_CONFLICT' ELSE coalesce(status, 'VAL_INVALID_ARGUMENT') END AS outcome
FROM mj CROSS JOIN top LEFT JOIN res ON res.message_id = mj.message_id AND res.seq = mj.seq WHERE mj.j IS NOT NULL"""


@register(_LIVE)
def batch_turns(spark, d):
    """Messages judged by the runtime that was loaded at their turn, from tables."""
    return _turns_out(_judged(live.batch_turns(*_turns(spark, d))))


@register(_LIVE)
def live_turns(spark, d):
    """The same from two streams in one keyed query, in five micro-batches."""
    at = shared_folder(spark, "live")
    changes, messages, runtimes = _turns(spark, d)
    quarter = fx.view(spark, d, "events").agg(F.max("event_id")).first()[0] // 4
    # Changes of a part are there with its messages, or before them: a part with fewer files lets the next begin, never a later one.
    n = {"changes": 1, "messages": _files(spark, d, 4)}
    for k in range(5):
        for name, df in (("changes", changes), ("messages", messages)):
            part = (F.col("seq") > (k - 1) * quarter) & (F.col("seq") <= k * quarter) if k < 4 else F.col("seq") > 3 * quarter
            df.where(part).repartition(n[name]).write.mode("append").parquet(f"{at}/{name}")
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n[name]).parquet(f"{at}/{name}")
    with _rocks(spark):
        turns = live.live_turns(read("changes", changes), read("messages", messages), runtimes, salts=_salts(spark))
        out = _drained(spark, turns, "turns", "append")
    return _turns_out(_judged(out))


@register(f"""WITH {q.IV}, top AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY pos DESC, seq DESC) AS rk FROM ad WHERE event = 'config.activated')
SELECT scope_kind, scope_key, set_id, version_id, epoch_us(pos) AS activated_at FROM top t WHERE rk = 1
  AND NOT EXISTS (SELECT 1 FROM ad c WHERE c.event = 'config.deactivated' AND c.scope_kind = t.scope_kind AND c.scope_key = t.scope_key AND c.version_id = t.version_id AND c.set_id = t.set_id AND (c.pos > t.pos OR c.pos = t.pos AND c.seq > t.seq))""")
def stream_runtime_state(spark, d):
    """The stateful cache over the change feed in one micro-batch."""
    at = shared_folder(spark, "changes")
    df = _changes(spark, d)
    df.write.parquet(at)
    with _rocks(spark):
        state = _drained(spark, runtime_state.runtime_state(spark.readStream.schema(df.schema).parquet(at)), "runtime_state", "update")
    return state.where("version_id is not null").select("scope_kind", "scope_key", "set_id", "version_id", us("activated_at"))


_RUNTIMES = f"""WITH {q.IV}, top AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY pos DESC, seq DESC) AS rk FROM ad WHERE event = 'config.activated')
SELECT scope_kind, scope_key, set_id, version_id, epoch_us(pos) AS activated_at FROM top t WHERE rk = 1
  AND NOT EXISTS (SELECT 1 FROM ad c WHERE c.event = 'config.deactivated' AND c.scope_kind = t.scope_kind AND c.scope_key = t.scope_key AND c.version_id = t.version_id AND c.set_id = t.set_id AND (c.pos > t.pos OR c.pos = t.pos AND c.seq > t.seq))"""


@register(_RUNTIMES)
def loaded_runtimes(spark, d):
    """What scopes have loaded, read from a query's committed state; it began with the first half of the changes as a table and followed the second as a stream."""
    at = shared_folder(spark, "loaded")
    df = _changes(spark, d)
    df.write.parquet(f"{at}/all")
    every = spark.read.parquet(f"{at}/all")
    half = every.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    every.where(F.col("seq") > half).write.parquet(f"{at}/in")
    begun = runtime_state.runtime_state_batch(every.where(F.col("seq") <= half), datetime.datetime(2024, 1, 1))
    with _rocks(spark):
        stream = runtime_state.runtime_state(spark.readStream.schema(df.schema).parquet(f"{at}/in"), begun)
        stream.writeStream.foreachBatch(lambda batch, i: batch.write.format("noop").mode("overwrite").save()).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return runtime_state.loaded_state(spark, f"{at}/checkpoint").select("scope_kind", "scope_key", "set_id", "version_id", us("activated_at"))


@register(f"WITH {q.INC} SELECT incident_key, count, epoch_us(first_seen_at) AS first_seen_at, epoch_us(last_seen_at) AS last_seen_at FROM inc")
def stream_incidents(spark, d):
    """Counts that grow with the stream, after redeliveries inside the window were dropped."""
    at = shared_folder(spark, "results")
    df = fx.results(spark, d)
    df.write.parquet(at)
    stream = ingest.dedup_messages(spark.readStream.schema(df.schema).parquet(at), "2 minutes", "processing_key", "processed_at")
    seen = _drained(spark, pipeline.incidents_stream(stream), "incidents", "update")
    last = seen.groupBy("incident_key").agg(F.max_by(F.struct("count", "first_seen_at", "last_seen_at"), "count").alias("l"))
    return last.select("incident_key", "l.*").select("incident_key", "count", us("first_seen_at"), us("last_seen_at"))


# A second delivery finds nothing wrong: what failed at first is no incident any more.
_MENDED = q.INC.replace("FROM rk)", "FROM (SELECT * REPLACE (CASE WHEN seq >= 10000000 THEN 'passed' ELSE status END AS status) FROM rk))")


@register(f"WITH {_MENDED} SELECT incident_key, count, epoch_us(first_seen_at) AS first_seen_at, epoch_us(last_seen_at) AS last_seen_at, max_seq, latest_message_id, latest_correlation_id, binding_name, topic, scope_kind, scope_key FROM inc")
def live_incidents(spark, d):
    """Incidents with their latest attributes from a stream, in three micro-batches; the last takes back what redeliveries mend."""
    at = shared_folder(spark, "results")
    df = fx.results(spark, d)
    mended = F.col("seq") >= 10_000_000
    df = df.withColumn("status", F.when(mended, "passed").otherwise(F.col("status"))).withColumn("violations", F.when(mended, F.array().cast(df.schema["violations"].dataType)).otherwise(F.col("violations")))
    n = _files(spark, d, 2)
    for part in (~mended & (F.col("seq") % 2 == 0), ~mended & (F.col("seq") % 2 == 1), mended):
        df.where(part).repartition(n).write.mode("append").parquet(at)
    with _rocks(spark):
        parts = _drained(spark, incidents.incident_parts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(at), salts=_salts(spark)), "incident_parts", "append")
    out = incidents.incidents_of(parts)
    return out.select("incident_key", "count", us("first_seen_at"), us("last_seen_at"), "max_seq", "latest_message_id", "latest_correlation_id", "binding_name", "topic", "scope_kind", "scope_key")


@register(f"""WITH {q.MSG} SELECT message_id, seq, attempt, true AS waited FROM (SELECT message_id, seq, unnest(range(2, CASE WHEN seq % 3 = 0 THEN 4 ELSE 5 END)) AS attempt FROM mj WHERE j IS NOT NULL AND scope_kind = 'tenant')""")
def redeliver_rejects(spark, d):
    """Every delivery of messages whose runtime is missing: again after a wait each time, until it is there (a third of them, at the third delivery) or after four."""
    wait, most, at = 0.5, 4, shared_folder(spark, "redeliver")
    lost = validate.judge_messages(fx.valid_messages(spark, d), fx.runtimes(spark).where("scope_kind = 'global'")).where("problem is not null and scope_kind = 'tenant'")
    rejects = lost.select("message_id", "seq", "problem", F.lit(1).alias("attempt"), F.current_timestamp().alias("rejected_at"))
    rejects.write.parquet(f"{at}/in")
    rejects = spark.read.schema(rejects.schema).parquet(f"{at}/in")
    third = F.col("seq") % 3 == 0
    due = rejects.agg(F.sum(F.when(third, 2).otherwise(most - 1))).first()[0] or 0
    again, _ = redelivery.redeliveries(spark.readStream.schema(rejects.schema).parquet(f"{at}/in"), most, wait, salts=_salts(spark))
    rows = {}

    def deliver(batch, i):
        now = F.current_timestamp()
        batch = batch.withColumn("waited", now >= F.col("rejected_at") + F.make_dt_interval(secs=F.lit(wait))).persist()
        n = batch.count()
        if n:
            batch.drop("problem").write.mode("overwrite").parquet(f"{at}/out/batch={i}")
        # Counted once they are written.
        rows[i] = n
        # Those without a runtime are rejected again.
        lost = batch.where(~(third & (F.col("attempt") >= 3))).drop("waited").withColumn("rejected_at", now)
        if n and not lost.isEmpty():
            lost.write.mode("append").parquet(f"{at}/in")
        batch.unpersist()

    shape = again.drop("problem").withColumn("waited", F.lit(True)).schema
    with _rocks(spark):
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
        query = again.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{at}/checkpoint").trigger(processingTime="200 milliseconds").start()
    try:
        # However long it takes: a query that fails ends the wait, and one that is due a delivery makes it.
        while query.isActive and sum(rows.copy().values()) < due:
            time.sleep(0.2)
        if query.exception() is not None:
            raise query.exception()
        if sum(rows.values()) < due:
            raise RuntimeError(f"the query ended after {sum(rows.values())} of {due} deliveries")
    finally:
        query.stop()
    delivered = spark.read.schema(shape).parquet(f"{at}/out") if due else spark.createDataFrame([], shape)
    return delivered.select("message_id", "seq", F.col("attempt").cast("long").alias("attempt"), "waited")


@register(f"WITH {q.LATEST} SELECT processing_key, status, violations, seq FROM latest")
def merge_results(spark, d):
    """The current results after four batches were merged into their buckets, redeliveries last."""
    at = shared_folder(spark, "current")
    df = fx.results(spark, d)
    df.write.parquet(f"{at}/log")
    log = spark.read.parquet(f"{at}/log")
    for part in (*(f"seq < 10000000 and seq % 3 = {k}" for k in range(3)), "seq >= 10000000"):
        current.merge_results(log.where(part), f"{at}/table", 8)
    return current.read_current(spark, f"{at}/table").select("processing_key", "status", violations_text(), "seq")


@register(f"WITH {q.RES}, day AS (SELECT *, CAST(processed_at AS DATE) AS d FROM rk), top AS (SELECT max(d) AS top FROM day) SELECT message_id, seq, status FROM day, top WHERE d >= top - INTERVAL 9 DAY")
def retain_days(spark, d):
    """The log of results with its last ten days, after folders of older ones were dropped by age."""
    at = shared_folder(spark, "retain")
    files.write_results(fx.results(spark, d), at)
    top = spark.read.parquet(at).agg(F.max("date")).first()[0]
    now = datetime.datetime.combine(top + datetime.timedelta(days=1), datetime.time())
    current.retain_days(spark, at, hours=240, most_bytes=1 << 50, now=now)
    return spark.read.parquet(at).select("message_id", "seq", "status")
