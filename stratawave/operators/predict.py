"""Rule predictors over series in long form (pid, d, epoch, y): season presence and size, step time, evidence guard, step size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import median, quantile
from ..functions.coerce import is_finite, round_to
from ..functions.expanding import beginning_medians, nearer_after


def observed(points: DataFrame) -> DataFrame:
    """Finite points with place i (from 0) and t, days since the series' first."""
    p = points.where(is_finite(F.col("y")))
    w = Window.partitionBy("pid")
    return p.select("pid", "d", "y", (F.row_number().over(w.orderBy("d", "epoch")) - 1).alias("i"), F.datediff("d", F.min("d").over(w)).alias("t"))


def sin_amplitude(p: DataFrame, period_days: float = 365.25) -> DataFrame:
    """pid, amp_sin, r2 of y on a sine and a cosine of the period; null if undetermined."""
    w = F.lit(2 * math.pi / period_days) * F.col("t")
    q = p.withColumns({"s": F.sin(w), "c": F.cos(w)})
    g = q.groupBy("pid").agg(F.covar_samp("s", "y").alias("sy"), F.covar_samp("c", "y").alias("cy"), F.var_samp("s").alias("ss"), F.var_samp("c").alias("cc"), F.covar_samp("s", "c").alias("sc"), F.var_samp("y").alias("yy"))
    det = F.col("ss") * F.col("cc") - F.col("sc") ** 2
    a = F.try_divide(F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc"), det)
    b = F.try_divide(F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc"), det)
    return g.select("pid", F.when(det > 1e-12, F.sqrt(a * a + b * b)).alias("amp_sin"), F.when(det > 1e-12, F.try_divide(a * F.col("sy") + b * F.col("cy"), F.col("yy"))).alias("r2"))


def difference_noise(p: DataFrame) -> DataFrame:
    """pid, noise: median absolute deviation of adjacent changes / 0.67449, 1e-6 at least and for fewer than three points."""
    d = p.withColumn("dy", F.col("y") - F.lag("y").over(Window.partitionBy("pid").orderBy("i"))).where("dy is not null")
    m = d.groupBy("pid").agg(F.expr("percentile(dy, 0.5)").alias("m"))
    s = d.join(m, "pid").groupBy("pid").agg((F.expr("percentile(abs(dy - m), 0.5)") / 0.67449).alias("sigma"), F.count("*").alias("n"))
    return p.select("pid").distinct().join(s, "pid", "left").select("pid", F.when(F.col("n") >= 2, F.greatest("sigma", F.lit(1e-6))).otherwise(F.lit(1e-6)).alias("noise"))


def b1(points: DataFrame, statics: DataFrame, mode: str = "sin", noise: str = "rmse", amp: float = 1.0, snr: float = 1.5) -> DataFrame:
    """pid, n, amp, noise, answer: seasonal if the amplitude and its ratio to the noise reach their thresholds; under six points nonseasonal.

    mode: sin, peak ((max - min) / 2), p2p (max - min) or p95 (half of 2.5 % to 97.5 %).
    noise: rmse (statics' meta_rmse where positive) or mad.
    """
    p = observed(points)
    g = p.groupBy("pid").agg(F.count("*").alias("n"), ((F.max("y") - F.min("y")) / 2).alias("peak"), (F.max("y") - F.min("y")).alias("p2p"), F.collect_list("y").alias("ys"))
    g = g.withColumn("p95", (quantile(F.col("ys"), 0.975) - quantile(F.col("ys"), 0.025)) / 2).drop("ys")
    g = g.join(sin_amplitude(p).withColumnRenamed("amp_sin", "sin"), "pid", "left").join(difference_noise(p).withColumnRenamed("noise", "mad"), "pid").join(statics.select("pid", "meta_rmse"), "pid", "left")
    own = F.greatest(F.when(F.col("meta_rmse") > 0, F.col("meta_rmse")).otherwise(F.col("mad")) if noise == "rmse" else F.col("mad"), F.lit(1e-6))
    g = g.select("pid", "n", F.col(mode).alias("amp"), own.alias("noise"))
    yes = (F.col("n") >= 6) & (F.col("amp") >= amp) & (F.col("amp") / F.col("noise") >= snr)
    every = points.select("pid").distinct()
    return every.join(g, "pid", "left").withColumn("answer", F.when(F.coalesce(yes, F.lit(False)), "seasonal").otherwise("nonseasonal")).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def b2(points: DataFrame, statics: DataFrame, ids: DataFrame, mode: str = "sin", noise: str = "rmse", amp: float = 1.0, snr: float = 2.0, step: float = 0.1) -> DataFrame:
    """pid, amp, answer_numeric, parse_error for every pid of ids: the amplitude rounded to step, null for none.

    mode: sin (six points at least), peak (largest distance from the median),
    p2p (half of the range) or p95 (half of 5 % to 95 %). noise: rmse, or max
    (largest adjacent change). Pids without series get missing_dataset_row.
    """
    p = observed(points)
    m = p.groupBy("pid").agg(F.expr("percentile(y, 0.5)").alias("m"))
    g = p.join(m, "pid").groupBy("pid").agg(F.count("*").alias("n"), F.max(F.abs(F.col("y") - F.col("m"))).alias("peak"), ((F.max("y") - F.min("y")) / 2).alias("p2p"), F.collect_list("y").alias("ys"))
    g = g.withColumn("p95", (quantile(F.col("ys"), 0.95) - quantile(F.col("ys"), 0.05)) / 2).drop("ys")
    change = p.withColumn("dy", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy("pid").orderBy("i")))).groupBy("pid").agg(F.max("dy").alias("change"))
    g = g.join(sin_amplitude(p), "pid", "left").join(change, "pid").join(statics.select("pid", "meta_rmse"), "pid", "left")
    own = F.when(F.col("meta_rmse") > 0, F.col("meta_rmse")).otherwise(F.lit(1e-9)) if noise == "rmse" else F.when(F.col("change") > 0, F.col("change")).otherwise(F.lit(1e-9))
    used = F.when(F.col("n") >= 6, F.col("amp_sin")) if mode == "sin" else F.col(mode)
    g = g.select("pid", used.alias("amp"), own.alias("noise"))
    yes = (F.col("amp") >= amp) & (F.col("amp") / F.col("noise") >= snr)
    known = points.select("pid").distinct().withColumn("_there", F.lit(True))
    out = ids.select("pid").join(known, "pid", "left").join(g, "pid", "left")
    return out.select("pid", "amp", F.when(yes, round_to(F.col("amp"), step if step > 0 else 0.1)).alias("answer_numeric"), F.when(F.col("_there").isNull(), "missing_dataset_row").alias("parse_error"))


def split_scan(points: DataFrame, min_pre: int, min_post: int, max_gap: int, strict: bool = False) -> DataFrame:
    """Every boundary of a series: pid, i, d, gap, pre_med, post_med, mag (signed), edge, persist.

    Medians are those of all points before and from i on; persist is the share
    of later points nearer to the later median (ties count unless strict). A
    series is one row, and its boundaries are scanned together in n log n. The
    rows are few and long, so series are dealt to a fixed number of tasks, not coalesced by their bytes.
    """
    point = F.struct(F.col("i"), F.col("d"), F.col("y"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = observed(points.repartition(parts, "pid")).groupBy("pid").agg(F.array_sort(F.collect_list(point)).alias("p")).select("pid", F.col("p.d").alias("ds"), F.col("p.y").alias("ys"))
    start = max(min_pre, 1)
    names = ("i", "d", "gap", "pre_med", "post_med", "edge", "persist")
    types = (pa.int32(), pa.date32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ds, ys = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                n = len(ys)
                stop = n - min_post + 1 if n - min_post >= min_pre else start
                pre, post = beginning_medians(ys), beginning_medians(ys[::-1])[::-1]
                near = nearer_after(ys, pre[:n], post[:n], strict) if stop > start else []
                rows = [(i, ds[i], gap, pre[i], post[i], abs(ys[i] - ys[i - 1]), near[i] / (n - i)) for i in range(start, stop) if (gap := (ds[i] - ds[i - 1]).days) <= max_gap]
                if rows:
                    pids = batch.column(0).take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([pids, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], ["pid", *names])

    kind = points.schema["pid"].dataType.simpleString()
    q = s.mapInArrow(run, f"pid {kind}, i int, d date, gap int, pre_med double, post_med double, edge double, persist double")
    return q.select("pid", "i", "d", "gap", "pre_med", "post_med", (F.col("post_med") - F.col("pre_med")).alias("mag"), "edge", "persist")


def c1(points: DataFrame, statics: DataFrame, ids: DataFrame, min_pre: int = 2, min_post: int = 5, max_gap: int = 120, mag: float = 2.0, snr: float = 1.5, persist: float = 0.7, edge: float = 0.0) -> DataFrame:
    """pid, step_date (null for none), mag, snr, persist, parse_error: the best boundary by persist, snr, size, edge, then smallest gap, then earliest."""
    s = split_scan(points, min_pre, min_post, max_gap).join(statics.select("pid", "meta_rmse"), "pid", "left")
    s = s.withColumns({"mag": F.abs("mag"), "snr": F.abs("mag") / F.greatest(F.lit(1e-9), F.coalesce("meta_rmse", F.lit(1.0)))})
    s = s.where((F.col("mag") >= mag) & (F.col("snr") >= snr) & (F.col("persist") >= persist) & (F.col("edge") >= edge))
    w = Window.partitionBy("pid").orderBy(F.desc("persist"), F.desc("snr"), F.desc("mag"), F.desc("edge"), "gap", "i")
    best = s.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pid", F.col("d").alias("step_date"), "mag", "snr", "persist")
    known = points.select("pid").distinct().withColumn("_there", F.lit(True))
    return ids.select("pid").join(known, "pid", "left").join(best, "pid", "left").withColumn("parse_error", F.when(F.col("_there").isNull(), "missing_dataset_row")).drop("_there")


def none_guard(points: DataFrame, min_pre: int = 2, min_post: int = 5, max_gap: float = 120, mag: float = 1.4, snr: float = 1.2, persist: float = 0.65, edge: float = 1.2, score: float = 0.85) -> DataFrame:
    """pid, use_alt and the evidence of the highest-scoring boundary (snr times persist): use_alt if all five stay at or under their maxima."""
    s = split_scan(points, min_pre, min_post, int(max_gap), strict=True).join(difference_noise(observed(points)), "pid")
    s = s.withColumns({"abs_mag": F.abs("mag"), "snr": F.abs("mag") / F.col("noise")}).withColumn("score", F.col("snr") * F.col("persist"))
    best = s.groupBy("pid").agg(F.max_by(F.struct("abs_mag", "snr", "persist", "edge", "score"), F.struct("score", "abs_mag", -F.col("i"))).alias("b")).select("pid", "b.*")
    weak = (F.col("abs_mag") <= mag) & (F.col("snr") <= snr) & (F.col("persist") <= persist) & (F.col("edge") <= edge) & (F.col("score") <= score)
    return points.select("pid").distinct().join(best, "pid", "left").withColumn("use_alt", F.coalesce(weak, F.lit(False)))


def step_candidates(points: DataFrame, top: int = 5, side: int = 3, reach: int = 50) -> DataFrame:
    """pid, rank, left_date, right_date, delta, est: the largest adjacent changes of observed points, the earliest of equals first.

    est: absolute difference of the medians of up to side points after and before within reach places.
    """
    p = points.where(is_finite(F.col("y")))
    w = Window.partitionBy("pid").orderBy("epoch")
    q = p.withColumns({"left_date": F.lag("d").over(w), "delta": F.col("y") - F.lag("y").over(w), "pre": F.collect_list(F.struct("epoch", "y")).over(w.rowsBetween(-side, -1)), "post": F.collect_list(F.struct("epoch", "y")).over(w.rowsBetween(0, side - 1))})
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc(F.abs("delta")), "epoch"))
    q = q.where("delta is not null").withColumn("rank", rank).where(F.col("rank") <= top)
    near = lambda a: median(F.transform(F.filter(a, lambda x: F.abs(x["epoch"] - F.col("epoch")) <= reach), lambda x: x["y"]))
    return q.select("pid", "rank", "left_date", F.col("d").alias("right_date"), "delta", F.abs(near(F.col("post")) - near(F.col("pre"))).alias("est"))


def split_at(points: Column, step: Column, min_post: int) -> Column:
    """Medians and persistence of an array of (d, y) structs split at the first date >= step; null under two points before or min_post after."""
    pre, post = F.filter(points, lambda x: x["d"] < step), F.filter(points, lambda x: x["d"] >= step)
    a, b = median(F.transform(pre, lambda x: x["y"])), median(F.transform(post, lambda x: x["y"]))
    near = F.filter(post, lambda x: F.abs(x["y"] - b) <= F.abs(x["y"] - a))
    return F.when((F.size(pre) >= 2) & (F.size(post) >= min_post), F.struct(a.alias("pre_med"), b.alias("post_med"), F.abs(b - a).alias("shift"), (F.size(near) / F.size(post)).alias("persist")))


@dataclass(frozen=True)
class C2Rules:
    """Thresholds of the step-size choice; None leaves an optional rule out."""

    use_delta: bool = True
    mag: float = 2.0
    snr: float = 1.5
    persist: float = 0.7
    relax: float = 0.1
    relax_shift: float = 1.5
    anchor_shift: float = 0.5
    min_post: int = 3
    support_gap: float | None = None
    soft_persist: float | None = None
    soft_snr_margin: float | None = None
    soft_mag_margin: float | None = None


def c2_evidence(candidates: DataFrame, rmse: Column, r: C2Rules = C2Rules()) -> DataFrame:
    """Adds size, snr, used (window or anchors), split, support_gap and passes to each candidate."""
    used = F.when((F.col("rank") == 1) & (F.size("window") > 0), "window").otherwise("anchors")
    size = F.abs("delta") if r.use_delta else F.coalesce(F.abs("est"), F.abs("delta"))
    q = candidates.withColumns({"used": used, "size": size, "gap": F.datediff("right_date", "left_date")})
    q = q.withColumn("split", split_at(F.when(F.col("used") == "window", F.col("window")).otherwise(F.col("anchors")), F.col("right_date"), r.min_post))
    q = q.withColumns({"snr": F.col("size") / F.greatest(rmse, F.lit(1e-9)), "support_gap": F.coalesce(F.abs(F.col("size") - F.col("split.shift")), F.lit(1e9))})
    in_window, shift, share = F.col("used") == "window", F.col("split.shift"), F.coalesce("split.persist", F.lit(-1.0))
    held = share >= r.persist
    if r.soft_persist is not None:
        soft = share >= r.soft_persist
        if r.soft_snr_margin is not None and r.soft_mag_margin is not None:
            soft = soft & (F.col("snr") >= r.snr + r.soft_snr_margin) & (F.col("size") >= r.mag + r.soft_mag_margin)
        held = held | (in_window & soft)
    held = held | (in_window & (share >= r.persist - r.relax) & F.coalesce(shift >= r.relax_shift, F.lit(False)))
    anchored = F.coalesce(shift >= r.anchor_shift, F.lit(False))
    if r.support_gap is not None:
        anchored = anchored & (F.col("support_gap") <= r.support_gap)
    held = held & (in_window | anchored)
    return q.withColumn("passes", (F.col("size") >= r.mag) & (F.col("snr") >= r.snr) & held & F.col("split").isNotNull())


def c2_select(candidates: DataFrame, rmse: Column, r: C2Rules = C2Rules()) -> DataFrame:
    """pid, rank, answer: size of the chosen candidate, null for none.

    candidates: pid, rank, left_date, right_date, delta, est, window and anchors
    (arrays of d, y structs). Only candidates judged in their window can be
    chosen: by persist, snr, shift, then smallest gap.
    """
    q = c2_evidence(candidates, rmse, r).where(F.col("passes") & (F.col("used") == "window"))
    w = Window.partitionBy("pid").orderBy(F.desc("split.persist"), F.desc("snr"), F.desc("split.shift"), "gap", "rank")
    best = q.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pid", "rank", F.col("size").alias("answer"))
    return candidates.select("pid").distinct().join(best, "pid", "left")
