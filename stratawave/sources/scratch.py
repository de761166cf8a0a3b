"""Tables between the steps of one job, in a folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder under /tmp only on a plain local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/stratawave-{os.getuid()}"


def note(path: str) -> str:
    """Have a path deleted when the innermost open scope ends."""
    if _scopes:
        _scopes[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete every table between steps that is written inside, when it ends. Write or collect results inside: lazy ones still read those tables."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()
        for path in paths:
            delete(spark, path)


def scratch_folder(spark: SparkSession, shared: str | None = None) -> str:
    """A fresh path in a folder all executors share: the given one or shared_folder's."""
    return note(f"{(shared or shared_folder(spark)).rstrip('/')}/tables-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df written below folder (a fresh one if none is given) and read back, so that what uses it several times computes it once."""
    path = f"{folder or scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
