"""Labels of series in long form (tile, pid, d, epoch, total, y): trend, annual season, level step, and the six question rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import is_finite, one_decimal, yyyymmdd

TASKS = ("A1_trend_dir", "A2_trend_v", "B1_seasonality_present", "B2_seasonality_amp", "C1_step_time", "C2_step_mag")


def train_epochs(total: Column, fraction: float = 0.8) -> Column:
    return F.floor(total * F.lit(fraction)).cast("int")


def train_window(points: DataFrame, fraction: float = 0.8) -> DataFrame:
    """The first fraction of every series' epochs."""
    return points.where(F.col("epoch") < train_epochs(F.col("total"), fraction))


def eligibility(points: DataFrame, fraction: float = 0.8, min_observed: int = 30) -> DataFrame:
    """tile, pid, n_observed in the train window, eligible."""
    inside = (F.col("epoch") < train_epochs(F.col("total"), fraction)) & is_finite(F.col("y"))
    return points.groupBy("tile", "pid").agg(F.count_if(inside).alias("n_observed")).withColumn("eligible", F.col("n_observed") >= min_observed)


def with_years(points: DataFrame) -> DataFrame:
    """Adds t: years of 365.25 days since the series' first date."""
    return points.withColumn("t", F.datediff("d", F.min("d").over(Window.partitionBy("pid"))) / F.lit(365.25))


def fits(points: DataFrame, period_years: float = 1.0) -> DataFrame:
    """tile, pid, n, slope, intercept (least squares) and amplitude of a harmonic without trend; both null if undetermined."""
    p = with_years(points).where(is_finite(F.col("y")))
    w = F.lit(2 * math.pi / period_years) * F.col("t")
    p = p.withColumns({"s": F.sin(w), "c": F.cos(w)})
    g = p.groupBy("tile", "pid").agg(
        F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"),
        F.covar_samp("s", "y").alias("sy"), F.covar_samp("c", "y").alias("cy"), F.var_samp("s").alias("ss"), F.var_samp("c").alias("cc"), F.covar_samp("s", "c").alias("sc"),
    )
    det = F.col("ss") * F.col("cc") - F.col("sc") ** 2
    a = F.try_divide(F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc"), det)
    b = F.try_divide(F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc"), det)
    return g.select("tile", "pid", "n", "slope", "intercept", F.when(det > 1e-12, F.sqrt(a * a + b * b)).alias("amplitude"))


def trend_label(slope: Column, tolerance: float = 0.2) -> Column:
    return F.when(slope >= tolerance, "uplifting").when(slope <= -tolerance, "subsiding").otherwise("stable")


def season_label(amplitude: Column, tolerance: float = 0.5) -> Column:
    return F.when(amplitude >= tolerance, "seasonal").otherwise("nonseasonal")


def max_jump(points: DataFrame, statics: DataFrame, min_jump: float = 0.5) -> DataFrame:
    """tile, pid, jump, step_date, is_step: the largest change between adjacent epochs, the earliest of equals.

    A step if its size reaches max(min_jump, 3 rmse); statics gives pid and rmse. Series without two adjacent finite values have no row
    but through the caller's outer join.
    """
    w = Window.partitionBy("pid").orderBy("epoch")
    y, before = F.col("y"), F.lag("y").over(w)
    jumps = points.select("tile", "pid", "epoch", "d", F.when(is_finite(y) & is_finite(before) & (F.lag("epoch").over(w) == F.col("epoch") - 1), y - before).alias("jump"))
    best = jumps.where("jump is not null").groupBy("tile", "pid").agg(F.max_by(F.struct("jump", "d"), F.struct(F.abs("jump"), -F.col("epoch"))).alias("b"))
    out = best.join(statics, "pid").select("tile", "pid", F.col("b.jump").alias("jump"), F.col("b.d").alias("step_date"), (F.abs("b.jump") >= F.greatest(F.lit(min_jump), F.lit(3.0) * F.coalesce("rmse", F.lit(0.0)))).alias("is_step"))
    return out


def labels(points: DataFrame, statics: DataFrame) -> DataFrame:
    """One row per series of three finite values or more: slope, amplitude, jump, step_date, is_step and the three buckets."""
    f = fits(points).where("n >= 3")
    j = max_jump(points, statics).drop("tile")
    return f.join(j, "pid", "left").select(
        "tile", "pid", "slope", "amplitude", "jump", "step_date", F.coalesce("is_step", F.lit(False)).alias("is_step"),
        trend_label(F.col("slope")).alias("trend"), season_label(F.col("amplitude")).alias("season"), F.when(F.coalesce("is_step", F.lit(False)), "step").otherwise("no_step").alias("step"),
    )


def question_rows(labelled: DataFrame) -> DataFrame:
    """Six rows per series: id, task_name, bucket_label, answer, answer_numeric, metric, tolerance."""
    def row(task, bucket, answer, number, metric, tolerance):
        return F.struct(F.lit(task).alias("task_name"), F.col(bucket).alias("bucket_label"), answer.cast("string").alias("answer"), number.cast("double").alias("answer_numeric"), F.lit(metric).alias("metric"), F.lit(tolerance).cast("double").alias("tolerance"))

    none, null = F.lit("none"), F.lit(None)
    seasonal, step = F.col("season") == "seasonal", F.col("is_step")
    slope, amp, jump = (one_decimal(F.col(c)) for c in ("slope", "amplitude", "jump"))
    rows = F.array(
        row(TASKS[0], "trend", F.col("trend"), null, "class_exact", None),
        row(TASKS[1], "trend", slope, slope, "num_within_tol", 0.2),
        row(TASKS[2], "season", F.col("season"), null, "class_exact", None),
        row(TASKS[3], "season", F.when(seasonal, amp.cast("string")).otherwise(none), F.when(seasonal, amp), "num_or_none_within_tol", 0.5),
        row(TASKS[4], "step", F.when(step, yyyymmdd(F.col("step_date"))).otherwise(none), null, "time_or_none_within_k", 1),
        row(TASKS[5], "step", F.when(step, jump.cast("string")).otherwise(none), F.when(step, jump), "num_or_none_within_tol", 0.5),
    )
    return labelled.select("tile", "pid", F.inline(rows)).withColumn("id", F.concat_ws("_", "tile", F.col("pid").cast("string"), "task_name"))


def edge_slice(points: DataFrame, n: int, last: bool = True) -> DataFrame:
    """The last (or first) n epochs of every series, with mask (1: finite)."""
    inside = F.col("epoch") >= F.col("total") - n if last else F.col("epoch") < n
    return points.where(inside).withColumn("mask", is_finite(F.col("y")).cast("int"))


def slice_around(points: DataFrame, steps: DataFrame, n: int) -> DataFrame:
    """n epochs around every series' step (n//2 before it, kept inside the series); the last n where there is none. steps: pid, step_date."""
    at = points.join(steps, "pid", "left").withColumn("right", F.max(F.when(F.col("d") == F.col("step_date"), F.col("epoch"))).over(Window.partitionBy("pid")))
    start = F.coalesce(F.greatest(F.lit(0), F.least(F.col("right") - n // 2, F.col("total") - n)), F.greatest(F.lit(0), F.col("total") - n))
    return at.where((F.col("epoch") >= start) & (F.col("epoch") < start + n)).drop("right", "step_date").withColumn("mask", is_finite(F.col("y")).cast("int"))


def series_arrays(points: DataFrame) -> DataFrame:
    """tile, pid, series (t_iso, d_mm, mask arrays in epoch order)."""
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "d", F.when(is_finite(F.col("y")), F.col("y")).alias("y"))))
    g = points.groupBy("tile", "pid").agg(ordered.alias("p"))
    return g.select("tile", "pid", F.struct(F.transform("p", lambda x: F.date_format(x["d"], "yyyy-MM-dd")).alias("t_iso"), F.transform("p", lambda x: x["y"]).alias("d_mm"), F.transform("p", lambda x: x["y"].isNotNull().cast("int")).alias("mask")).alias("series"))
