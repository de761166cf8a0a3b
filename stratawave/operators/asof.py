"""Nearest-date match between two long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder, stored

#: Rows that one task of an exchange gets, about; it sorts them up to three times.
PER_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int, per_task: int = PER_TASK) -> int:
    """Tasks for so many rows: the session's number, more if a task would get more than per_task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def nearest_dates(rows: DataFrame, grid: DataFrame, keys: Sequence[str], day: str, grid_day: str, payload: Sequence[str] = (), stretch: int = 512) -> DataFrame:
    """rows with grid_day and payload of the grid row of the same keys whose date is nearest to day, and gap, the days between.

    Of equally near dates the earlier is taken; days outside go to the ends. Of grid rows with one date the
    least payload is taken. Rows without a key, a day, or a grid date for their keys are left out; rows that repeat stay.

    Both tables are cut into stretches of so many days. What lies nearest outside a
    stretch comes from one row per stretch; inside it one ordered window each
    way carries the last grid date along. So a key of any length is dealt out, and no
    grid becomes an array. Both are stored, as they are used twice, and counted, so that
    the tasks grow in number with the rows and not in size.
    """
    keys, spark = list(keys), rows.sparkSession
    folder = scratch_folder(spark)
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / stretch)
    there = F.struct(F.col(grid_day).alias("d"), *[F.col(c).alias(c) for c in payload])
    g = grid.where(F.col(grid_day).isNotNull()).groupBy(*keys, F.col(grid_day).alias("_d")).agg(F.min(there).alias("_g")).withColumn("_s", number("_d"))
    g = stored(g, "grid", folder)
    left = stored(rows.where(F.col(day).isNotNull()).withColumns({"_d": F.col(day), "_s": number(day)}), "rows", folder)

    # Per key and stretch, the last grid row of earlier stretches and the first of later ones.
    ends = g.groupBy(*keys, "_s").agg(F.min("_g").alias("_low"), F.max("_g").alias("_high"))
    ends = left.select(*keys, "_s").distinct().join(ends, [*keys, "_s"], "full")
    own = Window.partitionBy(*keys)
    before = F.last("_high", ignorenulls=True).over(own.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_low", ignorenulls=True).over(own.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_s", before.alias("_before"), after.alias("_after"))

    row = F.struct(*[F.col(c).alias(c) for c in rows.columns])
    both = left.select(*keys, "_s", "_d", row.alias("_row"), F.lit(None).cast(g.schema["_g"].dataType).alias("_g")).unionByName(g.select(*keys, "_s", "_d", F.lit(None).cast(rows.schema).alias("_row"), "_g"))
    both = both.repartition(tasks_for(spark, left.count() + g.count()), *keys, "_s")
    inside = Window.partitionBy(*keys, "_s")
    upto = lambda order: F.last("_g", ignorenulls=True).over(inside.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.select(*keys, "_s", "_d", "_row", upto(F.col("_d")).alias("_last"), upto(F.desc("_d")).alias("_next")).where("_row is not null")
    met = met.join(ends, [*keys, "_s"]).withColumns({"_last": F.coalesce("_last", "_before"), "_next": F.coalesce("_next", "_after")})
    gaps = [F.datediff(F.col("_d"), F.col("_last.d")), F.datediff(F.col("_next.d"), F.col("_d"))]
    near = F.when(F.col("_next").isNull() | (gaps[0] <= gaps[1]), F.col("_last")).otherwise(F.col("_next"))
    met = met.withColumn("_g", near).where("_g is not null")
    return met.select("_row.*", F.col("_g.d").alias(grid_day), *[F.col(f"_g.{c}").alias(c) for c in payload], F.abs(F.datediff(F.col("_g.d"), F.col("_d"))).alias("gap"))

