"""Bins, predicted buckets, slice reports, tile summaries and regimes, system comparisons, robustness and bootstrap reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import median_cadence_days
from ..functions.coerce import is_finite, norm, safe_double
from .sample import hash32

#: Bin edges, half-open from the left.
BINS = {
    "rmse": ((0.5, "[0,0.5)"), (1.0, "[0.5,1.0)"), (2.0, "[1.0,2.0)"), (None, "[2.0,+inf)")),
    "missing": ((0.10, "[0.00,0.10)"), (0.25, "[0.10,0.25)"), (0.40, "[0.25,0.40)"), (None, "[0.40,1.00]")),
    "observed": ((40, "[0,40)"), (52, "[40,52)"), (60, "[52,60)"), (None, "[60,64]")),
    "cadence": ((7, "[0,7)"), (10, "[7,10)"), (14, "[10,14)"), (None, "[14,+inf)")),
}


def bin_of(x: Column, kind: str) -> Column:
    v = safe_double(x)
    out = F.when(v.isNull(), "unknown")
    for edge, name in BINS[kind][:-1]:
        out = out.when(v < edge, name)
    return out.otherwise(BINS[kind][-1][1])


def predicted_bucket(task: Column, pred: Column, null_as_nan: bool = False) -> Column:
    """The bucket that an answer falls into. null_as_nan: nulls as they come back from a CSV file (a step for C1, unknown for B2 and C2)."""
    t, v = norm(pred, "nan" if null_as_nan else ""), safe_double(pred)
    absent = pred.isNull() & F.lit(not null_as_nan)
    none = t.isin("none", "no_step", "nostep", "")
    return (
        F.when(task == "A1_trend_dir", F.when(t.isin("subsiding", "uplifting", "stable"), t).otherwise("unknown"))
        .when(task == "A2_trend_v", F.when(v.isNull(), "unknown").when(v >= 1.0, "uplifting").when(v <= -1.0, "subsiding").otherwise("stable"))
        .when(task == "B1_seasonality_present", F.when(t.isin("seasonal", "nonseasonal"), t).otherwise("unknown"))
        .when(task == "B2_seasonality_amp", F.when(absent | (t == "none"), "nonseasonal").when(v.isNotNull(), "seasonal").otherwise("unknown"))
        .when(task == "C1_step_time", F.when(absent | none, "no_step").otherwise("step"))
        .when(task == "C2_step_mag", F.when(absent | none, "no_step").when(v.isNotNull(), "step").otherwise("unknown"))
        .otherwise("unknown")
    )


def regimes(rows: DataFrame) -> DataFrame:
    """tile, regime: the most frequent trend bucket of a tile, ties by name."""
    n = rows.where("task_name = 'A1_trend_dir'").groupBy("tile", "bucket_label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tile").orderBy(F.desc("n"), "bucket_label")
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("tile", F.concat("bucket_label", F.lit("_dominated")).alias("regime"))


def attach_regime(rows: DataFrame) -> DataFrame:
    return rows.join(regimes(rows), "tile", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def micro_macro(rows: DataFrame, columns: list[str]) -> DataFrame:
    """slice, value, n, n_pid, micro_acc, macro_acc, n_tasks for each of the columns and overall (slice all): one pass of grouping sets."""
    pairs = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in columns])
    each = rows.select("pid", "task_name", "ok", F.inline(pairs)).where("value is not null")
    tasks = each.groupBy("slice", "value", "task_name").agg(F.avg("ok").alias("acc")).groupBy("slice", "value").agg(F.avg("acc").alias("macro_acc"), F.count("*").alias("n_tasks"))
    whole = each.groupBy("slice", "value").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("n_pid"), F.avg("ok").alias("micro_acc"))
    return whole.join(tasks, ["slice", "value"])


def task_accuracy(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns, "task_name").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("n_pid"), F.avg("ok").alias("acc"))


def tile_summary(rows: DataFrame) -> DataFrame:
    """One row per tile: sizes, gold and predicted bucket shares, means and mean absolute errors by task."""
    task, bucket, pred = F.col("task_name"), F.col("bucket_label"), F.col("pred_bucket")
    g, p = safe_double(F.col("answer")), safe_double(F.col("answer_parsed"))
    share = lambda t, column, label: F.avg(F.when(task == t, (column == label).cast("int")))
    both = g.isNotNull() & p.isNotNull()
    mean = lambda when, value: F.avg(F.when(when, value))
    a2, b2, c2 = task == "A2_trend_v", (task == "B2_seasonality_amp") & (bucket == "seasonal"), (task == "C2_step_mag") & (bucket == "step")
    out = [F.count("*").alias("n_examples"), F.countDistinct("pid").alias("n_pid")]
    for label in ("subsiding", "stable", "uplifting"):
        out += [share("A1_trend_dir", bucket, label).alias(f"a1_gold_{label}"), share("A1_trend_dir", pred, label).alias(f"a1_pred_{label}")]
    out += [mean(a2, g).alias("a2_gold_mean"), mean(a2 & both, p).alias("a2_pred_mean"), mean(a2 & both, F.abs(p - g)).alias("a2_mae")]
    out += [share("B1_seasonality_present", bucket, "seasonal").alias("b1_gold_seasonal"), share("B1_seasonality_present", pred, "seasonal").alias("b1_pred_seasonal")]
    out += [mean(b2, g).alias("b2_gold_mean"), mean(b2 & both, p).alias("b2_pred_mean"), mean(b2 & both, F.abs(p - g)).alias("b2_mae")]
    out += [share("C1_step_time", bucket, "step").alias("c1_gold_step"), share("C1_step_time", pred, "step").alias("c1_pred_step")]
    out += [share("C2_step_mag", bucket, "step").alias("c2_gold_step"), share("C2_step_mag", pred, "step").alias("c2_pred_step")]
    out += [mean(c2, g).alias("c2_gold_mean"), mean(c2 & both, p).alias("c2_pred_mean"), mean(c2 & both, F.abs(p - g)).alias("c2_mae")]
    return rows.groupBy("tile").agg(*out)


def prevalence(rows: DataFrame) -> DataFrame:
    """tile, task_name, label, n, gold and predicted share and their absolute difference."""
    labels = {"A1_trend_dir": ("subsiding", "stable", "uplifting"), "B1_seasonality_present": ("seasonal",), "C1_step_time": ("step",)}
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("label")) for t, own in labels.items() for x in own])
    r = rows.select("tile", "task_name", "bucket_label", "pred_bucket", F.inline(pairs)).where("task_name = t")
    g = r.groupBy("tile", "task_name", "label").agg(F.count("*").alias("n"), F.avg((F.col("bucket_label") == F.col("label")).cast("int")).alias("gold_share"), F.avg((F.col("pred_bucket") == F.col("label")).cast("int")).alias("pred_share"))
    return g.withColumn("abs_error", F.abs(F.col("pred_share") - F.col("gold_share")))


def average_rank(c: str, *keys: str) -> Column:
    """Rank of a column's value within keys, equal values sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0


def prevalence_summary(table: DataFrame) -> DataFrame:
    """task_name, label, mean and weighted mean absolute error, Pearson and Spearman (null for constant columns or fewer than two tiles)."""
    r = table.withColumns({"_g": average_rank("gold_share", "task_name", "label"), "_p": average_rank("pred_share", "task_name", "label")})
    safe = lambda a, b: F.when((F.count("*") >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b))
    return r.groupBy("task_name", "label").agg(F.avg("abs_error").alias("mean_abs_error"), (F.sum(F.col("abs_error") * F.col("n")) / F.sum("n")).alias("weighted_abs_error"), safe("gold_share", "pred_share").alias("pearson"), safe("_g", "_p").alias("spearman"))


def tile_performance(rows: DataFrame) -> DataFrame:
    """tile, micro, macro and the accuracy of each task as a column."""
    from .label import TASKS

    tasks = rows.groupBy("tile").pivot("task_name", list(TASKS)).agg(F.avg("ok"))
    macro = rows.groupBy("tile", "task_name").agg(F.avg("ok").alias("a")).groupBy("tile").agg(F.avg("a").alias("macro"))
    return rows.groupBy("tile").agg(F.avg("ok").alias("micro")).join(macro, "tile").join(tasks, "tile")


def tile_gain(system: DataFrame, reference: DataFrame) -> DataFrame:
    """tile and system minus reference for micro, macro and every task."""
    a, b = tile_performance(system), tile_performance(reference)
    names = [c for c in a.columns if c != "tile"]
    return a.alias("a").join(b.alias("b"), "tile").select("tile", *[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"gain_{c}") for c in names])


def tile_regimes(summary: DataFrame) -> DataFrame:
    """tile, trend_regime (largest gold share, ties by name), season_regime and step_regime (high from the median on)."""
    shares = F.array(*[F.struct((-F.col(f"a1_gold_{x}")).alias("s"), F.lit(x).alias("label")) for x in ("stable", "subsiding", "uplifting")])
    medians = summary.agg(F.expr("percentile(b1_gold_seasonal, 0.5)").alias("mb"), F.expr("percentile(c1_gold_step, 0.5)").alias("mc"))
    level = lambda c, m: F.when(F.col(c) >= F.col(m), "high").otherwise("low")
    return summary.crossJoin(F.broadcast(medians)).select("tile", F.array_min(shares)["label"].alias("trend_regime"), level("b1_gold_seasonal", "mb").alias("season_regime"), level("c1_gold_step", "mc").alias("step_regime"))


def system_deltas(rows: DataFrame, reference: str) -> DataFrame:
    """system, micro, macro and their differences to the reference system. rows: system, task_name, ok."""
    macro = rows.groupBy("system", "task_name").agg(F.avg("ok").alias("a")).groupBy("system").agg(F.avg("a").alias("macro"))
    s = rows.groupBy("system").agg(F.avg("ok").alias("micro")).join(macro, "system")
    base = s.where(F.col("system") == reference).select(F.col("micro").alias("_i"), F.col("macro").alias("_a"))
    return s.crossJoin(F.broadcast(base)).select("system", "micro", "macro", (F.col("micro") - F.col("_i")).alias("delta_micro"), (F.col("macro") - F.col("_a")).alias("delta_macro"))


def task_by_system(rows: DataFrame, systems: list[str], reference: str) -> DataFrame:
    """task_name, accuracy of each system as a column, and each one's difference to the reference."""
    p = rows.groupBy("task_name").pivot("system", systems).agg(F.avg("ok"))
    return p.select("task_name", *systems, *[(F.col(s) - F.col(reference)).alias(f"delta_{s}") for s in systems if s != reference])


def paired_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """task_name, both, only_a, only_b, neither, net_gain over the ids that both systems scored."""
    j = a.select("id", "task_name", F.col("ok").alias("x")).join(b.select("id", F.col("ok").alias("y")), "id")
    n = lambda x, y: F.count_if((F.col("x") == x) & (F.col("y") == y))
    return j.groupBy("task_name").agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither")).withColumn("net_gain", F.col("only_a") - F.col("only_b"))


def first_variant(scores: DataFrame, priority: list[str]) -> DataFrame:
    """model, variant: the first variant of the list that a model has."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("variant"))
    return scores.where(F.col("variant").isin(*priority)).groupBy("model").agg(F.min_by("variant", place).alias("variant"))


def with_ablations(scores: DataFrame, base: list[str], ablations: list[str]) -> DataFrame:
    """Models that have a base variant and any ablation."""
    has = lambda names: scores.where(F.col("variant").isin(*names)).select("model").distinct()
    return has(base).join(has(ablations), "model", "left_semi")


def robustness(rows: DataFrame) -> DataFrame:
    """system, family, severity, n, mean and sample deviation of micro and macro, and differences to the clean condition.

    rows: system, family, severity, micro, macro, one per condition.
    """
    g = rows.groupBy("system", "family", "severity").agg(F.count("*").alias("n"), F.avg("micro").alias("micro_mean"), F.stddev_samp("micro").alias("micro_std"), F.avg("macro").alias("macro_mean"), F.stddev_samp("macro").alias("macro_std"))
    clean = rows.where("family = 'clean'").groupBy("system").agg(F.avg("micro").alias("_i"), F.avg("macro").alias("_a"))
    return g.join(clean, "system", "left").select(*g.columns, (F.col("micro_mean") - F.col("_i")).alias("micro_delta"), (F.col("macro_mean") - F.col("_a")).alias("macro_delta"))


def extreme_rows(table: DataFrame) -> DataFrame:
    """The rows of highest severity of each family that is not clean."""
    top = F.max("severity").over(Window.partitionBy("system", "family"))
    return table.where("family <> 'clean'").withColumn("_top", top).where("severity = _top").drop("_top")


def robustness_slopes(table: DataFrame) -> DataFrame:
    """system, family, slope of micro over severity with the clean row at 0; null under two severities."""
    own = table.where("family <> 'clean'").select("system", "family", "severity", "micro_mean")
    clean = table.where("family = 'clean'").select("system", F.lit(0.0).alias("severity"), "micro_mean")
    every = own.unionByName(own.select("system", "family").distinct().join(clean, "system").select("system", "family", "severity", "micro_mean"))
    return every.groupBy("system", "family").agg(F.when(F.countDistinct("severity") >= 2, F.regr_slope("micro_mean", "severity")).alias("slope"))


def common_ids(*systems: DataFrame) -> DataFrame:
    """task_name, id, and ok of each system as ok_0, ok_1, ...: the items that every system scored (inner joins on task and id)."""
    out = None
    for k, rows in enumerate(systems):
        own = rows.select("task_name", "id", F.col("ok").alias(f"ok_{k}"))
        out = own if out is None else out.join(own, ["task_name", "id"])
    return out


def average_models(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, n_models, and the mean over models of each value; nulls and NaN are skipped, a value that no model has is null."""
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    return rows.groupBy(*keys).agg(F.countDistinct("model").alias("n_models"), *map(mean, values))


def binomial_draws(draws: DataFrame) -> DataFrame:
    """draws (size, p, u and others) with k: the smallest count whose binomial distribution function is above u.

    Weights of the counts within ten deviations of the mean (the rest weighs under 1e-20)
    come from the ratios of neighbouring ones, once per distinct (size, p); so
    the work grows with the square root of size, not with what was counted.
    """
    size, p, k = F.col("size"), F.col("p"), F.col("k")
    far = 10 * F.sqrt(size * p * (1 - p)) + 10
    lo = F.when(p >= 1, size).otherwise(F.greatest(F.lit(0), F.floor(size * p - far)))
    hi = F.when(p <= 0, F.lit(0)).otherwise(F.least(size, F.ceil(size * p + far)))
    own = Window.partitionBy("size", "p")
    upto = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = draws.select("size", "p").distinct().withColumn("lo", lo).withColumn("k", F.explode(F.sequence("lo", hi)))
    t = t.withColumn("l", F.sum(F.when(k == F.col("lo"), 0.0).otherwise(F.ln((size - k + 1) / k * (p / (1 - p))))).over(upto))
    t = t.withColumn("w", F.exp(F.col("l") - F.max("l").over(own)))
    t = t.withColumn("c", F.sum("w").over(upto) / F.sum("w").over(own))
    t = t.select("size", "p", "k", "c", F.lag("c", 1, 0.0).over(own.orderBy("k")).alias("below"))
    return draws.join(t, ["size", "p"]).where("u >= below and u < c").drop("size", "p", "u", "below", "c")


def bootstrap(paired: DataFrame, n_boot: int = 2000, alpha: float = 0.05) -> DataFrame:
    """metric, low, high, mean of the paired difference (micro, macro over tasks), resampled with replacement within each task.

    paired: task_name, id, a, b (0 or 1). A difference is -1, 0 or 1, so a resample of
    a task is told by how many it draws of each: of n rows a binomial number of -1, of
    the rest one of 1, each the inverse distribution function of the hash of (what,
    replicate, task). Rows meet no replicate; after one count per task the work is
    the same for any number of them but for its square root. Draws repeat
    from run to run. The bounds are the values at place int(p (n - 1)) of the
    sorted replicates.
    """
    x = F.col("a") - F.col("b")
    counts = paired.groupBy("task_name").agg(F.count("*").alias("n"), F.count_if(x == -1).alias("lost"), F.count_if(x == 1).alias("won"))
    draws = counts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = lambda what: hash32(F.lit(what), F.col("r"), F.col("task_name")) / 2.0**32
    first = binomial_draws(draws.withColumns({"size": F.col("n"), "p": F.col("lost") / F.col("n"), "u": u("lost")})).withColumnRenamed("k", "minus")
    rest = F.col("n") - F.col("lost")
    second = binomial_draws(first.withColumns({"size": F.col("n") - F.col("minus"), "p": F.when(rest > 0, F.try_divide("won", rest)).otherwise(0.0), "u": u("won")}))
    per = second.select("r", "n", (F.col("k") - F.col("minus")).alias("s"))
    each = per.groupBy("r").agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg(F.col("s") / F.col("n")).alias("macro"))
    long = each.select("r", F.inline(F.array(F.struct(F.lit("micro").alias("metric"), F.col("micro").alias("v")), F.struct(F.lit("macro").alias("metric"), F.col("macro").alias("v")))))
    at = lambda p: F.max(F.when(F.col("i") == int(p * (n_boot - 1)), F.col("v")))
    placed = long.withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("v", "r")) - 1)
    return placed.groupBy("metric").agg(F.avg("v").alias("mean"), at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


#: Methods of the result tables and the variants whose scores stand for them, the first that is there.
METHODS = {
    "LLM-only (routeA)": ["ALL_base"],
    "+Rules (B1B2C1C2; no gate)": ["ABL_plus_B1B2C1C2"],
    "+Rules+Gate (Full)": ["ABL_plus_B1B2C1C2_plus_gatev3"],
    "+B1 rule only": ["ABL_plus_B1"],
    "+B2 rule only": ["ABL_plus_B2"],
    "+B1+B2 rules": ["ABL_plus_B1B2"],
    "+C1 rule only": ["ABL_plus_C1"],
    "+C2 rule only": ["ABL_plus_C2"],
    "+C1+C2 rules": ["ABL_plus_C1C2"],
    "LLM-only + gate_v3": ["GATEv3_consistency_only"],
    "+C1C2 rules + gate_v3": ["GATEv3_after_C1C2predict"],
}


def method_rows(summary: DataFrame, by_task: DataFrame, tasks: list[str], methods: dict[str, list[str]] = METHODS) -> DataFrame:
    """model, method, variant, macro, micro and a column per task, of a score tree's tables; a method without any of its variants has no row."""
    spark = summary.sparkSession
    wanted = spark.createDataFrame([(m, v, i) for m, names in methods.items() for i, v in enumerate(names)], "method string, variant string, _i int")
    first = Window.partitionBy("model", "method").orderBy("_i")
    picked = summary.join(F.broadcast(wanted), "variant").withColumn("_n", F.row_number().over(first)).where("_n = 1")  # the map has a few rows
    wide = by_task.groupBy("model", "variant").pivot("task_name", tasks).agg(F.first("acc"))
    return picked.join(wide, ["model", "variant"], "left").select("model", "method", "variant", "macro", "micro", *[F.col(t) for t in tasks])


def method_averages(rows: DataFrame, tasks: list[str]) -> DataFrame:
    """method, n_models, and means over models of macro, micro and every task, nulls skipped."""
    return average_models(rows, ["method"], ["macro", "micro", *tasks])


def intervals(paired: dict[str, DataFrame], n_boot: int = 2000) -> DataFrame:
    """name, metric, mean, low, high of each comparison (name -> paired rows as bootstrap takes them)."""
    out = None
    for name, rows in paired.items():
        own = bootstrap(rows, n_boot).select(F.lit(name).alias("name"), "metric", "mean", "low", "high")
        out = own if out is None else out.unionByName(own)
    return out


def bootstrap_mean(rows: DataFrame, key: str, value: str, n_boot: int = 5000) -> DataFrame:
    """key, n, mean, low, high: hash-drawn resamples of each group's mean, 2.5 % and 97.5 % by linear interpolation."""
    w = Window.partitionBy(key)
    ranked = rows.select(key, (F.row_number().over(w.orderBy(value, "tile")) - 1).alias("i"), F.count("*").over(w).alias("n"), F.col(value).alias("x"))
    draws = ranked.select(key, F.col("i").alias("k"), "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("r")).withColumn("i", hash32(F.col("r"), F.col(key), F.col("k")) % F.col("n"))
    means = draws.join(ranked.select(key, "i", "x"), [key, "i"]).groupBy(key, "r").agg(F.avg("x").alias("m"))
    bounds = means.groupBy(key).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mean")).join(bounds, key)


def dataset_metadata(examples: DataFrame) -> DataFrame:
    """The 13 flat columns of each example that slice reports use.

    examples: id, tile_id, pid, task_name, bucket_label, answer, coord (easting,
    northing), context (series: t_iso, d_mm, mask; static: rmse_mm). A value
    counts as observed if its mask is set and it is a finite number; the missing
    rate of an empty series, and the cadence of fewer than two dates, are null.
    """
    t, y, m = (F.coalesce(F.col(f"context.series.{c}"), F.array()) for c in ("t_iso", "d_mm", "mask"))
    seen = F.filter(F.arrays_zip(m.alias("m"), y.alias("y")), lambda z: (z["m"] == 1) & is_finite(z["y"]))
    total, observed = F.size(t).cast("long"), F.size(seen).cast("long")
    days = F.array_sort(F.filter(F.transform(t, lambda x: F.coalesce(F.try_to_date(x, "yyyyMMdd"), F.try_to_date(x, "yyyy-MM-dd"))), lambda x: x.isNotNull()))
    return examples.select(
        "id", "tile_id", "pid", "task_name", "bucket_label", F.col("answer").alias("gold_answer"), "coord.easting", "coord.northing", F.col("context.static.rmse_mm").alias("rmse_mm"),
        observed.alias("observed_points"), total.alias("total_points"), F.when(total > 0, 1 - observed / total).alias("missing_rate"), median_cadence_days(days).cast("double").alias("median_cadence_days"),
    )
