"""Rows that come out again after a wait, for messages that are delivered once more.

What arrives in one micro-batch is due at one time: it is kept together, in
``salts`` parts, each with one timer, so nothing has to be searched for what is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.results import retry_rejects

_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class _Delay(StatefulProcessor):
    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.wait)
        for pdf in rows:
            self.held.appendList([(x,) for x in pdf["row"].tolist()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunk = []
        for (row,) in self.held.get():
            chunk.append(row)
            if len(chunk) == 10_000:
                yield pd.DataFrame({"row": chunk})
                chunk = []
        if chunk:
            yield pd.DataFrame({"row": chunk})
        self.held.clear()

    def close(self) -> None:
        pass


def delay(df: DataFrame, wait: float = 30.0, salts: int = 16) -> DataFrame:
    """The rows of a stream, not before ``wait`` seconds of processing time; write with output mode append.

    Rows come out in the first micro-batch after that, for which the query has to run on without data
    (``spark.sql.streaming.noDataMicroBatches.enabled``, as it is by default) or get more.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), _FORMAT).alias("row")).select("row", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), F.unix_millis(F.current_timestamp()).alias("came"))
    out = rows.groupBy("salt", "came").transformWithStateInPandas(statefulProcessor=_Delay(int(wait * 1000)), outputStructType="row string", outputMode="Append", timeMode="ProcessingTime")
    return out.select(F.from_json("row", df.schema, _FORMAT).alias("r")).select("r.*")


def redeliveries(rejects: DataFrame, max_attempts: int = 10, wait: float = 30.0, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows to deliver again after ``wait`` seconds, with one attempt more; rows that are given up at once) of a stream of rejects with ``attempt``."""
    again, given_up = retry_rejects(rejects, max_attempts)
    return delay(again, wait, salts), given_up
