"""Structured Streaming forms: windowed means with late data, incremental labels and a bounded sample per class kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_means(events: DataFrame, width: str = "1 day", late: str = "2 days", key: str = "user_id") -> DataFrame:
    """key, start, n, mean of value per window of event time; rows later than the watermark are dropped. Works on streams and tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(key, F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(key, F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days", key: str = "user_id") -> DataFrame:
    """key, start, stop, n of sessions: runs of events with no pause of gap or more."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


class KeepSmallest(StatefulProcessor):
    """Of each class the per_class rows of smallest (hash, id) so far.

    State: the kept rows as a list, what it holds, and once it is full the greatest of the
    sample. A row above that is dropped at once; others are appended, and the list is
    sorted and cut when it has twice as many as are wanted. So state holds at most
    that, and most batches write none of it.
    """

    def __init__(self, per_class: int) -> None:
        self.per_class = per_class

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "h long, id string")
        self.bound = handle.getValueState("bound", "n int, h long, id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        n, *top = self.bound.get() if self.bound.exists() else (0, None, None)
        new = set()
        for b in rows:
            new |= {r for r in zip(b["h"].tolist(), b["id"].tolist(), strict=True) if top[0] is None or r < tuple(top)}
            if len(new) > 2 * self.per_class:
                new = set(sorted(new)[: self.per_class])
        if not new:
            return
        had = {tuple(r) for r in self.kept.get()}
        have = sorted(had | new)[: self.per_class]
        if n + len(new) > 2 * self.per_class:
            self.kept.put(have)
            n = len(have)
        else:
            self.kept.appendList(sorted(new))
            n += len(new)
        self.bound.update((n, *(have[-1] if len(have) == self.per_class else (None, None))))
        if have != sorted(had)[: self.per_class]:
            yield pd.DataFrame({"bucket_label": key[0], "h": [h for h, _ in have], "id": [i for _, i in have]})

    def close(self) -> None:
        pass


def streaming_sample(examples: DataFrame, per_class: int) -> DataFrame:
    """bucket_label, h, id: a stream's balanced sample per class, all of it again after each batch that changes it; state is bounded by per_class.

    Keeps its state in RocksDB, which the operator asks of the session.
    """
    examples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = examples.where("id is not null").select("bucket_label", F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long").alias("h"), "id")
    return rows.groupBy("bucket_label").transformWithStateInPandas(KeepSmallest(per_class), "bucket_label string, h long, id string", "Update", "None")


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream to the end of its present input into a table in memory (for tests and small outputs)."""
    q: StreamingQuery = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
