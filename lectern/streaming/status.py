"""The state of every document under ingest, kept by key across restarts.

Events are rows (doc_id, event, error, at): `started`, `done`, `failed`. A document's state is processing, completed, failed or stuck:
one that was started and not heard of for a while is stuck, which a timer tells. Events may come late, twice or in any order within a batch; what
happened before the last event known changes nothing. A document that is started again is processed again, and counts its attempts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

STATES = {"started": "processing", "done": "completed", "failed": "failed"}
OUTPUT = "doc_id string, state string, error string, attempts int, at timestamp"
KEPT = "state string, error string, attempts int, at timestamp"
#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Tracker(StatefulProcessor):
    """One document's state; emits a row whenever it changes."""

    def __init__(self, stuck_after: float):
        self.stuck_after = stuck_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("document", KEPT)

    def _row(self, key, state, error, attempts, at) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "state": [state], "error": [error], "attempts": pd.array([attempts], "int32"), "at": [pd.Timestamp(at)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, error, attempts, last = self.kept.get() if self.kept.exists() else (None, None, 0, None)
        before = state, attempts, last
        told = pd.concat(list(rows)).sort_values("at", kind="stable")
        order = {"started": 0, "failed": 1, "done": 2}
        for event, reason, at in sorted(zip(told["event"], told["error"], told["at"], strict=True), key=lambda r: (r[2], order.get(r[0], 3))):
            if event not in STATES or (last is not None and (at < pd.Timestamp(last) or (at == pd.Timestamp(last) and STATES[event] == state))):
                continue
            state, error, last = STATES[event], reason if event == "failed" and isinstance(reason, str) else None, at.to_pydatetime()
            attempts += event == "started"
        if (state, attempts, last) == before:
            return
        self.kept.update((state, error, attempts, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "processing":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.stuck_after))
        yield self._row(key, state, error, attempts, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.kept.exists():
            state, _, attempts, last = self.kept.get()
            if state == "processing":
                self.kept.update(("stuck", None, attempts, last))
                yield self._row(key, "stuck", None, attempts, last)

    def close(self) -> None:
        pass


def changes(events: DataFrame, stuck_after: float = 600.0) -> DataFrame:
    """(doc_id, state, error, attempts, at): a row for every change of a document's state. The session's state store must be STORE."""
    rows = events.select(F.col("doc_id").cast("string").alias("doc_id"), "event", F.col("error").cast("string").alias("error"), "at")
    return rows.groupBy("doc_id").transformWithStateInPandas(Tracker(stuck_after), OUTPUT, "Update", "ProcessingTime")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, stuck_after: float = 600.0, interval: str | None = None):
    """A started query that follows the event files of a folder and adds changes of state to `out`.

    With an interval it goes on, and timers go off by themselves; else it ends with the files there are, and timers go off when more come.
    """
    spark.conf.set(*STORE)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    # batches without data, which timers ask for, would never end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(interval is not None).lower())
    events = spark.readStream.schema("doc_id string, event string, error string, at timestamp").parquet(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")  # a batch that is run again replaces itself

    return changes(events, stuck_after).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, state, error, attempts, at): every document's last state."""
    last = Window.partitionBy("doc_id").orderBy(F.desc("epoch"))
    rows = spark.read.schema(OUTPUT + ", epoch long").parquet(out)
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("doc_id", "state", "error", "attempts", "at")


def counts(states: DataFrame) -> DataFrame:
    """(state, n) over all documents."""
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


class Progress(StreamingQueryListener):
    """The last progress reports of all queries: (name or id, batch, rows, rows a second, milliseconds)."""

    def __init__(self, keep: int = 1000):
        self.reports: deque = deque(maxlen=keep)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.reports.append((p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception
