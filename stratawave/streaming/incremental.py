"""Incremental jobs that survive a restart: a file stream's batches in a sink with a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column and folder of a batch in the sink; folder of the ledger, which readers do not see.
BATCH, LEDGER = "batch_id", "_ledger"


def json_stream(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """Objects of the JSON-lines files in a folder as a stream, so many new files a batch at most; blank lines are skipped, broken ones give nulls."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    value = F.regexp_replace("value", "^﻿", "")
    return lines.where(F.trim(value) != "").select(F.from_json(value, schema).alias("r")).select("r.*")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def last_batch(spark: SparkSession, out: str) -> int | None:
    """The last batch in the ledger of a sink; batches go in by number, so every one before it is there too."""
    fs, place = _hadoop(spark, f"{out}/{LEDGER}")
    return max((int(f.getPath().getName()) for f in fs.listStatus(place)), default=None) if fs.exists(place) else None


def committed(spark: SparkSession, out: str) -> DataFrame | None:
    """What the ledger says is in a sink; None before the first batch. What a killed batch left behind is not read."""
    last = last_batch(spark, out)
    return None if last is None else spark.read.option("basePath", out).parquet(f"{out}/{BATCH}=*").where(F.col(BATCH) <= last).drop(BATCH)


def batch_sink(out: str, key: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends batches to out, each exactly once.

    A batch is a folder of its own, overwritten if the batch is run again, and counts from the
    moment that its mark stands in the ledger; a batch that has its mark is not
    run again. So it may be killed anywhere. With key only rows whose key no earlier batch has go in (of a batch's
    rows with one key the least by its other columns); rows without key are left out then.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, mark = _hadoop(spark, f"{out}/{LEDGER}/{number}")
        if fs.exists(mark):
            return
        rows = prepare(batch) if prepare else batch
        if key:
            others = [c for c in rows.columns if c != key]
            one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("_row") if others else F.lit(None).alias("_row"))
            rows = one.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
            if (before := committed(spark, out)) is not None:
                rows = rows.join(before.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")
        fs.create(mark, True).close()

    return write


def append_stream(stream: DataFrame, out: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> DataFrame | None:
    """Run a stream through all input that is there now and give what the sink then holds; the next call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return committed(stream.sparkSession, out)
