"""Time series, answers and point clouds derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, pid, d, epoch (from 0), total, y: monthly mean price of each supplier, tiles are regions.

    Means are taken in whole cents and rounded half up to thousandths in whole
    numbers, so that they do not depend on the order of the rows.
    """
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("pid"), F.col("n_regionkey").cast("string").alias("tile"))
    monthly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pid"), F.trunc("l_shipdate", "month").alias("d")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("l_extendedprice").alias("n"))
    monthly = monthly.select("pid", "d", (F.expr("(2 * cents + 100 * n) div nullif(200 * n, 0)") / 1000).alias("y"))
    own = Window.partitionBy("pid")
    points = monthly.withColumns({"epoch": F.row_number().over(own.orderBy("d")) - 1, "total": F.count("*").over(own)})
    return points.join(places, "pid").select("tile", "pid", "d", "epoch", F.col("total").cast("int").alias("total"), "y")


def gappy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_points with regular gaps: every epoch with (7 pid + 3 epoch) mod 11 = 0 is null."""
    return series_points(spark, sf_dir).withColumn("y", F.when((F.col("pid") * 7 + F.col("epoch") * 3) % 11 != 0, F.col("y")))


def statics(points: DataFrame) -> DataFrame:
    """pid, static_rmse, meta_rmse: two noise levels, for labels and for predictors."""
    return points.select("pid").distinct().select("pid", (12 + (F.col("pid") % 10) * 0.8).alias("static_rmse"), (0.5 + (F.col("pid") % 10) * 0.2).alias("meta_rmse"))


def point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, tile, id, x, y, gold, pred from the embeddings' first two components."""
    e = table(spark, sf_dir, "embeddings")
    v, n = F.col("vec_id"), F.col("label") % 3
    name = lambda k: F.when(k == 0, "stable").when(k == 1, "subsiding").otherwise("uplifting")
    return e.select(F.lit("A1_trend_dir").alias("task_name"), (v % 5).cast("string").alias("tile"), v.alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), name(n).alias("gold"), name(F.when(v % 7 == 0, (n + 1) % 3).otherwise(n)).alias("pred"))


def error_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_name (B1, C1, C2), tile, id, x, y, gold, pred: the places of point_cloud with two labels a task, some predicted wrongly."""
    e = table(spark, sf_dir, "embeddings")
    v, n = F.col("vec_id"), F.col("label")

    def task(name, yes, no, shift):
        label = lambda hit: F.when(hit, yes).otherwise(no)
        gold = (n + shift) % 3 == 0
        wrong = (v + shift) % 4 == 0
        return e.select(F.lit(name).alias("task_name"), (v % 5).cast("string").alias("tile"), v.alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), label(gold).alias("gold"), label(gold != wrong).alias("pred"))

    return task("B1_seasonality_present", "seasonal", "nonseasonal", 0).unionByName(task("C1_step_time", "step", "no_step", 1)).unionByName(task("C2_step_mag", "step", "no_step", 2))
