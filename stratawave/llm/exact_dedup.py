"""Exact dedup: sorted digest runs merged in binomial rounds, DataFrame functions only.

Every input partition starts as a run of (digest, identifier, count). In each
round sixteen neighbouring runs exchange rows: the run number loses its lowest
four bits and one more hex digit of the digest takes over, so after
ceil(log16(runs)) rounds a run is a digest range and holds each digest once.
A round sorts what leaves a task, combines neighbours of equal key, and after
the exchange merges the sorted parts the same way (the identifier travels in a
struct, for which Spark aggregates by sorting, not by hashing). Each merge keeps
the verified extreme identifier (equal digest, length and a second, independent
hash) and the sum of counts; as they are combined before the exchange, a group
of copies that holds a third of all rows is one row per run from the first round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows

KEY = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id with what identifies its text: SHA-256, byte length, xxHash64."""
    d = doc_rows(docs)
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"))


def merge_runs(rows: DataFrame, keep: str, n_runs: int) -> DataFrame:
    """One row per distinct text: KEY, keep_id, group_size."""
    best = F.min if keep == "smallest" else F.max
    runs = rows.select(*KEY, F.struct(F.col("doc_id").alias("keep_id")).alias("best"), F.lit(1).cast("long").alias("group_size"), F.spark_partition_id().alias("run"))
    for level in range(1, max(1, math.ceil(math.log(max(n_runs, 2), 16))) + 1):
        run, digits = F.shiftright("run", 4).alias("run"), F.substring("digest", 1, level).alias("range")
        runs = runs.groupBy(run, digits, *KEY).agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
    # Runs beyond 16**levels partitions, if any, meet here; otherwise each digest is alone already.
    return runs.groupBy(*KEY).agg(best("best").alias("best"), F.sum("group_size").alias("group_size")).select(*KEY, "best.keep_id", "group_size")


def exact_dedup(docs: DataFrame, keep: str = "smallest", n_runs: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: 'smallest' or 'largest' identifier of equal texts. Null text counts as
    empty; empty texts are equal to each other. Repeated rows count in
    group_size and are all returned. Rows without doc_id are left out; other
    columns are ignored. An empty table gives no rows.
    """
    rows = digest_rows(docs)
    groups = merge_runs(rows, keep, n_runs or partitions(docs))
    # Keyed by less than the groups are dealt by, so both sides are exchanged and Spark can split a hot digest.
    return rows.join(groups.drop("n_bytes"), ["digest", "check"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def partitions(df: DataFrame) -> int:
    """How many partitions df is read in."""
    return (df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1


def dedup_documents(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs, all columns, whose text stays, repeated rows once; rows without doc_id go."""
    kept = exact_dedup(docs, keep).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    own = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    return docs.join(kept, (docs["doc_id"] == kept["_id"]) & (own == kept["_sha"]), "left_semi").dropDuplicates(["doc_id", "text"])
