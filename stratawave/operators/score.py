"""Scoring answers against gold rows, and the reports over scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import median_cadence_days
from ..functions.coerce import norm, parse_date, scored_double, within_tolerance


def last_wins(rows: DataFrame, *keys: str, order: str = "_seq") -> DataFrame:
    """Of rows with equal keys, the one of highest order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def nearest_index(grid: Column, day: Column) -> Column:
    """Place (from 0) of the grid date nearest to day, the earlier of equals; days outside go to the ends."""
    gaps = F.transform(grid, lambda g, i: F.struct(F.abs(F.datediff(g, day)).alias("gap"), i.alias("i")))
    return F.array_min(gaps)["i"]


def acquisition_index(gold: Column, pred: Column, grid: Column) -> Column:
    """gold_index, pred_index, index_error, day_error and whether each date is exact or outside; null if a date or the grid is invalid.

    grid: array of date texts; it must parse whole and rise strictly.
    """
    days = F.transform(grid, lambda t: parse_date(t, "score"))
    rises = F.forall(F.zip_with(F.slice(days, F.lit(2), F.greatest(F.size(days) - 1, F.lit(0))), F.slice(days, F.lit(1), F.greatest(F.size(days) - 1, F.lit(0))), lambda b, a: b > a), lambda x: x)
    valid = (F.size(grid) > 0) & F.forall(days, lambda x: x.isNotNull()) & rises
    g, p = parse_date(gold, "score"), parse_date(pred, "score")
    gi, pi = nearest_index(days, g), nearest_index(days, p)
    first, last = F.get(days, F.lit(0)), F.get(days, F.size(days) - 1)
    outside = lambda d: (d < first) | (d > last)
    fields = F.struct(gi.alias("gold_index"), pi.alias("pred_index"), F.abs(pi - gi).alias("index_error"), F.abs(F.datediff(p, g)).alias("day_error"), F.array_contains(days, g).alias("gold_exact"), F.array_contains(days, p).alias("pred_exact"), outside(g).alias("gold_outside"), outside(p).alias("pred_outside"))
    return F.when(F.coalesce(valid, F.lit(False)) & g.isNotNull() & p.isNotNull(), fields)


def scored(rows: DataFrame, c1_policy: str = "acquisition_index_v2") -> DataFrame:
    """Adds ok and reason. rows: metric, tolerance, answer, answer_numeric, answer_parsed, parse_error, t_iso."""
    if c1_policy not in ("acquisition_index_v2", "legacy_days"):
        raise ValueError(f"unknown policy {c1_policy}")
    metric, pred, gold = F.col("metric"), F.col("answer_parsed"), F.col("answer")
    verdict = lambda ok, bad: F.struct(ok.alias("ok"), F.when(ok, "ok").otherwise(bad).alias("reason"))
    wrong = lambda reason: F.struct(F.lit(False).alias("ok"), F.lit(reason).alias("reason"))
    target = F.coalesce(F.col("answer_numeric").cast("string"), gold)
    tol = F.coalesce("tolerance", F.lit(0.5))
    number = F.when(scored_double(target).isNull() | scored_double(pred).isNull(), wrong("num_missing")).otherwise(
        verdict(within_tolerance(pred, target, tol), F.concat(F.lit("num_outside_tol(abs_tol="), tol.cast("string"), F.lit(")")))
    )
    same = F.coalesce(norm(pred) == norm(gold), F.lit(False))
    pred_none = pred.isNull() | (norm(pred) == "none")
    none_first = lambda gold_none, rest: F.when(gold_none, verdict(pred_none, F.lit("expected_none"))).otherwise(rest)
    k = F.coalesce("tolerance", F.lit(1.0)).cast("int")
    gd, pd = parse_date(gold, "score"), parse_date(pred, "score")
    if c1_policy == "acquisition_index_v2":
        index = acquisition_index(gold, pred, F.col("t_iso"))
        near = F.when(index.isNull(), wrong("invalid_acquisition_grid")).otherwise(verdict(index["index_error"] <= k, F.concat(F.lit("time_outside_tol(index_tol="), k.cast("string"), F.lit(")"))))
    else:
        cadence = F.coalesce(median_cadence_days(F.filter(F.transform("t_iso", lambda t: parse_date(t, "score")), lambda d: d.isNotNull())), F.lit(6.0))
        limit = F.greatest(F.lit(1.0), cadence) * k
        near = verdict(F.abs(F.datediff(pd, gd)) <= limit, F.concat(F.lit("time_outside_tol(days_tol="), F.round(limit, 1).cast("string"), F.lit(")")))
    time = F.when(gd.isNull() | pd.isNull(), wrong("time_parse_fail")).otherwise(near)
    result = (
        F.when(F.col("parse_error").isNotNull() & pred.isNull(), F.struct(F.lit(False).alias("ok"), F.concat(F.lit("parse:"), F.col("parse_error")).alias("reason")))
        .when(metric == "class_exact", verdict(same, F.lit("class_mismatch")))
        .when(metric == "num_within_tol", number)
        .when(metric == "num_or_none_within_tol", none_first(F.col("answer_numeric").isNull() | (norm(gold) == "none"), number))
        .when(metric == "time_or_none_within_k", none_first(norm(gold) == "none", time))
        .otherwise(F.struct(F.lit(False).alias("ok"), F.concat(F.lit("unknown_metric:"), F.coalesce(metric, F.lit("None"))).alias("reason")))
    )
    return rows.withColumn("_v", result).select("*", F.col("_v.ok").cast("int").alias("ok"), F.col("_v.reason").alias("reason")).drop("_v")


def score(gold: DataFrame, pred: DataFrame, mode: str = "intersection", c1_policy: str = "acquisition_index_v2") -> DataFrame:
    """Gold rows with ok and reason. intersection: ids on both sides; all: gold ids without prediction score as missing_pred.

    Of predictions with one id the last by _seq counts, if the column exists.
    """
    pred = last_wins(pred, "id") if "_seq" in pred.columns else pred
    own = pred.select("id", F.col("answer_parsed").cast("string").alias("answer_parsed"), F.col("parse_error").cast("string").alias("parse_error"), F.lit(True).alias("_there"))
    joined = gold.join(own, "id", "inner" if mode == "intersection" else "left")
    missing = F.col("_there").isNull()
    return scored(joined.withColumn("parse_error", F.when(missing, "missing_pred").otherwise(F.col("parse_error"))).drop("_there"), c1_policy)


def by_task(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_name").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"), F.avg(F.col("parse_error").isNotNull().cast("int")).alias("format_fail"))


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.where("bucket_label is not null").groupBy("task_name", "bucket_label").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"))


def summary(rows: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: sizes, coverage, micro accuracy, macro accuracy over tasks."""
    tasks = by_task(rows).agg(F.avg("acc").alias("macro_acc_over_tasks"), F.count("*").alias("n_tasks"))
    sizes = gold.agg(F.countDistinct("id").alias("n_gold")).crossJoin(pred.agg(F.countDistinct("id").alias("n_pred")))
    covered = gold.select("id").join(pred.select("id"), "id", "left_semi").agg(F.countDistinct("id").alias("_both"))
    own = rows.agg(F.count("*").alias("n_scored"), F.avg("ok").alias("micro_acc"))
    return own.crossJoin(tasks).crossJoin(sizes).crossJoin(covered).withColumn("coverage_pred_over_gold", F.try_divide("_both", "n_gold")).drop("_both")
