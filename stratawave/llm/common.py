"""Shared helpers: importability on executors, shared scratch tables, batch slicing, hashing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, note, shared_folder

ROOT = str(Path(__file__).resolve().parents[2])
U64 = np.uint64


def ship(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package by name (elsewhere: --py-files)."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return note(f"{shared_folder(spark)}/stratawave/{name}-{uuid.uuid4().hex}")


#: Where the tables that cut wrote are, while anything still holds them.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    lean: for large tables; packed more tightly, and shuffle files go as soon as the table is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if lean:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut returned and that no later plan reads."""
    for df in tables:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; null texts become empty, rows without doc_id have no identity and are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def slices(batch: pa.RecordBatch, step: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch small enough that their Python objects stay bounded."""
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def weighed(batch: pa.RecordBatch, place: int, step: int = 256, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of step rows or about limit bytes in the column at place, whichever comes first (one longer text stands alone)."""
    a = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()):
        if i > a and (i - a >= step or size + n > limit):
            yield batch.slice(a, i - a)
            a, size = i, 0
        size += n
    if batch.num_rows > a:
        yield batch.slice(a)


def by_bytes(texts: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a list holding about limit bytes each (one longer item stands alone)."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift, multiply, shift), vectorised."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
