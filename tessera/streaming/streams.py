"""The row-level operators over streams, counts with bounded state, observed counts, several sinks, and metrics by epoch."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.label import category_map, severity_cascade5
from ..functions.text import norm_category, sanitize_text
from ..operators.split import threshold_split


def clean_label(stream: DataFrame, text: str = "text", key: str = "seed_id") -> DataFrame:
    """Cleans, labels and splits arriving rows; no state."""
    x = stream.withColumn("cleaned_text", sanitize_text(F.col(text)))
    return x.withColumn("severity", severity_cascade5(F.col("cleaned_text"))["severity"]).withColumn("split", threshold_split(F.col(key)))


def quarantine(stream: DataFrame, category: str = "raw_category") -> DataFrame:
    """Adds known: False sends a row to the quarantine sink."""
    x = stream.withColumn("raw_label", norm_category(F.col(category)))
    return x.join(F.broadcast(category_map(stream)), "raw_label", "left").withColumn("known", F.col("department_code").isNotNull())


def running_metrics(stream: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean by tumbling window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), by, "n", "mean")


def dedupe_ids(stream: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> str:
    """Everything that is available now, to Parquet. Returns the run's id."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return str(query.runId)


class Tally(StreamingQueryListener):
    """The sums of a named observation over a stream's batches; a batch that is run again counts once.

    Add it with spark.streams.addListener() before the stream starts; run_counted() does all of it.
    """

    def __init__(self, name: str):
        self.name, self.batches, self.ended, self.changed = name, {}, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if row := event.progress.observedMetrics.get(self.name):
            self.batches[str(event.progress.runId), event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def totals(self, run: str, seconds: float = 60.0) -> dict[str, int]:
        """The sums of a run that has ended; events come a little later than the end itself."""
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"no end of stream {run} was told within {seconds} seconds")
        out: dict[str, int] = {}
        for (own, _), row in self.batches.items():
            for k, v in row.items() if own == run else ():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def run_counted(stream: DataFrame, path: str, checkpoint: str, name: str) -> dict[str, int]:
    """run_once(), and the sums of the stream's observation of that name."""
    tally = Tally(name)
    stream.sparkSession.streams.addListener(tally)
    try:
        return tally.totals(run_once(stream, path, checkpoint))
    finally:
        stream.sparkSession.streams.removeListener(tally)


def run_split(stream: DataFrame, sinks: dict[str, tuple[str, Column]], checkpoint: str, sure: Callable[[str, int], None] = lambda name, batch: None) -> None:
    """Everything that is available now, to several Parquet tables, each with its folder and its condition on the rows.

    A batch goes to a folder of its own number in each table, and replaces what a failed try of that batch has left there: after a
    restart in the middle of a batch no table has a row twice, and none lacks one. The tables have a column batch.
    sure is called after each table's write.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, (path, condition) in sinks.items():
                batch.where(condition).write.mode("overwrite").parquet(f"{path}/batch={number}")
                sure(name, number)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quarantine_sinks(known: str, unknown: str) -> dict[str, tuple[str, Column]]:
    """The two tables of quarantine(): rows of a known category, and the rest."""
    return {"known": (known, F.col("known")), "quarantine": (unknown, ~F.col("known"))}


EPOCHS = "key string, epoch bigint, loss double, accuracy double, n bigint"


class EpochMetrics(StatefulProcessor):
    """Running metrics of each key, reset when a new epoch begins.

    Input: key, epoch, loss (mean over n rows), n, correct, time. The totals of an epoch go out when a row of a later one comes, or when the
    watermark has passed its last row by `idle_ms`. Rows of epochs that have gone out come too late and are dropped.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("epoch", "epoch bigint, loss double, n bigint, correct bigint, last bigint, open boolean")

    @staticmethod
    def _row(key: tuple, s: tuple) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "epoch": [s[0]], "loss": [s[1] / s[2] if s[2] else 0.0], "accuracy": [s[3] / s[2] if s[2] else 0.0], "n": [s[2]]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        # sums of each epoch in this batch, however many rows there are
        new: dict[int, list] = {}
        for x in rows:
            for epoch, own in x.groupby("epoch"):
                t = new.setdefault(int(epoch), [0.0, 0, 0, 0])
                t[0] += float((own["loss"] * own["n"]).sum())
                t[1] += int(own["n"].sum())
                t[2] += int(own["correct"].sum())
                t[3] = max(t[3], int(own["time"].max().timestamp() * 1000))
        s = tuple(self.state.get()) if self.state.exists() else None
        for epoch, (loss, n, correct, last) in sorted(new.items()):
            if s and (epoch < s[0] or (epoch == s[0] and not s[5])):
                continue
            if s and epoch == s[0]:
                s = (epoch, s[1] + loss, s[2] + n, s[3] + correct, max(s[4], last), True)
                continue
            if s and s[5]:
                yield self._row(key, s)
            s = (epoch, loss, n, correct, last, True)
        if s and s[5]:
            for t in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(s[4] + self.idle_ms)
        if s:
            self.state.update(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        s = tuple(self.state.get()) if self.state.exists() else None
        if s and s[5]:
            self.state.update((*s[:5], False))
            yield self._row(key, s)

    def close(self) -> None:
        pass


#: Arbitrary state with timers needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def epoch_metrics(stream: DataFrame, key: str, epoch: str, loss: str, n: str, correct: str, time: str, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """key, epoch, loss (mean over rows), accuracy, n: one row for each epoch of each key that has ended. State: one row a key.

    The session's state store must be RocksDB (streams.ROCKSDB) when the stream starts.
    """
    # Spark also starts the processor beside the driver, where files sent to the executors aren't on the path: the class goes by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    x = stream.select(F.col(key).cast("string").alias("key"), F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("loss"), F.col(n).cast("bigint").alias("n"), F.col(correct).cast("bigint").alias("correct"), F.col(time).alias("time"))
    return x.withWatermark("time", late).groupBy("key").transformWithStateInPandas(EpochMetrics(idle_ms), EPOCHS, "append", "eventTime")
