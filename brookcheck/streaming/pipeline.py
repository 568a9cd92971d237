"""Records to results in one streaming query."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import dedup_messages, normalize_records, route_records
from ..operators.results import incident_key
from ..operators.topology import runtime_signature
from ..operators.validate import judge_messages, results_of
from ..sources.files import shared_folder, write_messages, write_rejects, write_results

_log = logging.getLogger(__name__)


class Topology:
    """The bindings and runtimes that a stream works with.

    ``refresh()`` gives both; it is asked again ``interval`` seconds after it was last asked. What
    it gives is written to the shared folder, so that it stays as it is, and
    replaces what was there only if its signature differs.  A refresh that
    fails leaves the last topology in place; only the first must succeed.
    """

    def __init__(self, refresh: Callable[[], tuple[DataFrame, DataFrame]], interval: float = 0.0, clock: Callable[[], float] = time.monotonic):
        self.refresh, self.interval, self.clock = refresh, interval, clock
        self.loaded: tuple[DataFrame, DataFrame] | None = None
        self.signature, self.asked, self.swaps = None, None, 0
        self.failure: Exception | None = None

    def current(self) -> tuple[DataFrame, DataFrame]:
        if self.loaded is None or self.clock() - self.asked >= self.interval:
            self.asked = self.clock()
            try:
                self._load()
                self.failure = None
            except Exception as e:
                if self.loaded is None:
                    raise
                self.failure = e
                _log.warning("refresh failed, the last topology stays: %s", e)
        return self.loaded

    def _load(self) -> None:
        bindings, runtimes = self.refresh()
        signature = runtime_signature(bindings, runtimes).first()["signature"]
        if self.loaded is not None and signature == self.signature:
            return
        kept = []
        for name, df in (("bindings", bindings), ("runtimes", runtimes)):
            at = shared_folder(df.sparkSession, name)
            df.write.parquet(at)
            kept.append(df.sparkSession.read.schema(df.schema).parquet(at))
        self.loaded, self.signature, self.swaps = tuple(kept), signature, self.swaps + 1


def process(records: DataFrame, bindings: DataFrame, runtimes: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, results, rejects) of records with ``seq``, the same on a batch and on a micro-batch.

    Messages are parsed and judged once; ``hold`` is given the judged messages that all three are read from.
    """
    ok, bad = normalize_records(records)
    routed, lost = route_records(ok, bindings)
    judged = hold(judge_messages(routed, runtimes))
    results, refused = results_of(judged, F.col("ingested_at"))
    messages = judged.where("valid").select(*routed.columns)
    cols = ["topic", "key", "payload", "seq", "problem"]
    return messages, results, bad.select(*cols).unionByName(lost.select(*cols)).unionByName(refused.select(*cols))


def start_pipeline(records: DataFrame, refresh: Callable[[], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, trigger: dict | None = None, window: str | None = None, interval: float = 0.0, written: Callable[[int], None] = lambda batch_id: None) -> StreamingQuery:
    """Starts records → messages, results and rejects under ``out``.

    ``refresh()`` gives (bindings, runtimes) and is asked anew by the first
    micro-batch that starts ``interval`` seconds or more after it was last asked, so that changed rules take effect; where it fails
    the last topology stays (see ``Topology``).  Delivery is at least once:
    a batch that is repeated writes its folder again, and ``latest_results``
    keeps one result of each key.  With ``window``, records that repeat topic,
    partition and offset inside it are dropped first.

    Once all of a batch is written, a row of ``manifest`` says so: ``committed`` reads batches that have one. After that ``written`` is
    called with the batch's number, before Spark notes the batch as done.  A query that fails anywhere before that is started again on the
    same checkpoint, repeats the batch over the same records and replaces what it had left.
    """
    if window:
        where = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
        records = dedup_messages(records.withColumn("_where", where), window, "_where", "published_at").drop("_where")
    topology = refresh if isinstance(refresh, Topology) else Topology(refresh, interval)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = [batch.withColumn("seq", F.lit(batch_id) * F.lit(1 << 40) + F.col("offset")).persist()]

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        try:
            messages, results, rejects = process(held[0], *topology.current(), hold)
            write_messages(messages.drop("headers"), f"{out}/messages/batch={batch_id}", "overwrite")
            write_results(results, f"{out}/results/batch={batch_id}", "overwrite")
            write_rejects(rejects, f"{out}/rejects/batch={batch_id}", "overwrite")
            done = held[0].agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
            done.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/batch={batch_id}")
            written(batch_id)
        finally:
            for df in held:
                df.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The messages, results or rejects of the batches under ``out`` that were written whole."""
    whole = spark.read.parquet(f"{out}/manifest").select("batch").distinct()
    return spark.read.parquet(f"{out}/{name}").join(F.broadcast(whole), "batch", "left_semi")


def topics_of(bindings: DataFrame) -> list[str]:
    """The topics that have a binding, sorted: as many as a consumer subscribes to."""
    return sorted(r.topic for r in bindings.select("topic").where("topic is not null").distinct().collect())


def follow_topics(start: Callable[[list[str]], StreamingQuery], topics: Callable[[], list[str]], interval: float = 30.0, ended: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> list[list[str]]:
    """Keeps a query over the topics that are bound, until ``ended``; returns the topic sets it was started with.

    ``topics()`` is asked every ``interval`` seconds.  Where the set has changed, the query is stopped and ``start`` makes
    another one over the new set, on the same checkpoint: a batch that was under way is repeated, what was read is not read again, and topics that are new are read from their start.
    Without topics nothing runs.  A query that failed raises; one that came to its end (``availableNow``) is started again with the next set.
    """
    now, query, sets = None, None, []
    while True:
        wanted = sorted(set(topics()))
        if wanted != now:
            if query is not None:
                query.stop()
            query, now = (start(wanted) if wanted else None), wanted
            sets.append(wanted)
        if query is not None and query.exception() is not None:
            raise query.exception()
        if ended():
            if query is not None:
                query.stop()
            return sets
        sleep(interval)


def incidents_stream(results: DataFrame) -> DataFrame:
    """Incident counts that grow with the stream; write with output mode update, after the messages were deduplicated."""
    return results.where("status = 'failed'").groupBy(incident_key().alias("incident_key")).agg(F.count("*").alias("count"), F.min("processed_at").alias("first_seen_at"), F.max("processed_at").alias("last_seen_at"))
