"""Evidence text from series, and answers and evidence back out of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import even_picks
from ..functions.coerce import is_finite, norm, parse_date, safe_double
from .label import TASKS
from .predict import step_candidates

#: What a task's answer may be.
ALLOWED = {
    "A1_trend_dir": "subsiding | stable | uplifting", "A2_trend_v": "a number (mm/yr)", "B1_seasonality_present": "seasonal | nonseasonal",
    "B2_seasonality_amp": "a number (mm) or none", "C1_step_time": "yyyymmdd or none", "C2_step_mag": "a number (mm) or none",
}


def allowed(task: Column) -> Column:
    out = F.when(task == TASKS[0], ALLOWED[TASKS[0]])
    for t in TASKS[1:]:
        out = out.when(task == t, ALLOWED[t])
    return out


def fixed(x: Column, places: int) -> Column:
    """A number with that many decimals; NA for null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", x)).otherwise("NA")


def summary_block(points: DataFrame) -> DataFrame:
    """pid, total, observed, min, max, mean and population deviation of the finite values, and their line of text."""
    y = F.when(is_finite(F.col("y")), F.col("y"))
    g = points.groupBy("pid").agg(F.count("*").alias("total"), F.count(y).alias("observed"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"))
    line = F.concat(F.lit("coverage="), F.col("observed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("; min="), fixed(F.col("y_min"), 3), F.lit("; max="), fixed(F.col("y_max"), 3), F.lit("; mean="), fixed(F.col("y_mean"), 3), F.lit("; std="), fixed(F.col("y_std"), 3))
    return g.withColumn("line", line)


def static_block(rmse: Column) -> Column:
    """rmse_mm=...; empty for null."""
    return F.when(rmse.isNotNull(), F.concat(F.lit("rmse_mm="), fixed(rmse, 3))).otherwise("")


def table_block(rows: Column) -> Column:
    """date,disp_mm lines of an array of (d, y) structs in its order."""
    lines = F.transform(rows, lambda r: F.concat(F.date_format(r["d"], "yyyy-MM-dd"), F.lit(","), fixed(r["y"], 3)))
    return F.concat_ws("\n", F.lit("date,disp_mm"), F.array_join(lines, "\n"))


def anchors(points: DataFrame, n: int = 12, strategy: str = "auto", task: str = "A1_trend_dir") -> DataFrame:
    """pid, epoch, d, y: observed points picked as anchors.

    linspace: evenly spread over the observed ones. quantile: the same over the
    middles of n equal parts. step_window: n around the largest adjacent change.
    month: the middle observed point of every month of the year, thinned evenly. auto: by task.
    """
    if strategy == "auto":
        strategy = {"B1_seasonality_present": "month", "B2_seasonality_amp": "month", "C1_step_time": "step_window", "C2_step_mag": "step_window"}.get(task, "linspace")
    p = points.where(is_finite(F.col("y")))
    own = Window.partitionBy("pid")
    p = p.select("pid", "epoch", "d", "y", (F.row_number().over(own.orderBy("epoch")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    if strategy == "linspace":
        keep = F.array_contains(even_picks(F.col("n"), n), F.col("i"))
    elif strategy == "quantile":
        spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround((k + 0.5) / n * (F.col("n") - 1), 0).cast("int"))
        keep = (F.col("n") <= n) | F.array_contains(spots, F.col("i"))
    elif strategy == "step_window":
        jump = F.abs(F.col("y") - F.lag("y").over(own.orderBy("epoch")))
        p = p.withColumn("_j", jump)
        at = F.max_by(F.col("i"), F.when(F.col("_j").isNotNull(), F.struct("_j", -F.col("i")))).over(own)
        p = p.withColumn("_at", F.coalesce(at, F.lit(0)))
        start = F.greatest(F.lit(0), F.least(F.col("_at") - n // 2, F.col("n") - n))
        p = p.withColumn("_s", start)
        keep = (F.col("i") >= F.col("_s")) & (F.col("i") < F.col("_s") + n)
    elif strategy == "month":
        month = Window.partitionBy("pid", F.month("d"))
        p = p.withColumns({"_k": F.row_number().over(month.orderBy("epoch")) - 1, "_m": F.count("*").over(month)})
        p = p.where(F.col("_k") == F.floor(F.col("_m") / 2))
        p = p.withColumns({"i": F.row_number().over(own.orderBy("epoch")) - 1, "n": F.count("*").over(own)})
        keep = F.array_contains(even_picks(F.col("n"), n), F.col("i"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return p.where(keep).select("pid", "epoch", "d", "y")


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """pid, block: a numbered line per candidate of step_candidates."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    line = F.concat(F.lit("- #"), F.col("rank").cast("string"), F.lit(": "), day("left_date"), F.lit(" -> "), day("right_date"), F.lit(" | delta_mm="), fixed(F.col("delta"), 3), F.lit(" | step_date_candidate="), F.date_format("right_date", "yyyyMMdd"), F.lit(" | est_step_mag_abs_mm≈"), fixed(F.col("est"), 3))
    g = candidates.select("pid", "rank", line.alias("line")).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return g.select("pid", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


#: What a reply that did not parse is answered with, before the form of the task's answer.
REPAIR = "\n\nThe last reply was no valid answer. Reply now with one JSON object that has the single key answer, and with nothing else.\nIts value: "


def repair_suffix(task: Column) -> Column:
    """Text that goes behind a prompt whose reply could not be read, with the form of the task's answer; for unknown tasks any JSON value."""
    return F.concat(F.lit(REPAIR), F.coalesce(allowed(task), F.lit("any JSON value")), F.lit(".\n"))


_STEP = """How to tell a step:
A step is a change of level between two neighbouring observations that stays. A long pause between the two does not speak against it.
Begin with candidate 1, the largest change. Compare the window's points before it with those after it: if values go back to the old level soon, there is no step.
Compare its size with the other changes in the window: if it is no larger than they are, there is no step."""
#: How the two step tasks are to be decided.
GUIDANCE = {
    "C1_step_time": _STEP + "\nAnswer none only if candidate 1 fails one of these tests; otherwise answer its step_date_candidate, the first date on the new level.",
    "C2_step_mag": _STEP + "\nAnswer none only if candidate 1 fails one of these tests; otherwise answer the size of the step as a positive number: est_step_mag_abs_mm, or the size of delta_mm where that is NA.",
}


def observations(points: DataFrame, mode: str = "summary", first: int = 50, last: int = 64) -> DataFrame:
    """pid, observed: what a prompt shows of the whole series. summary: its line of text; first: a table of the first epochs; last: one of the last epochs; missing values are NA."""
    if mode == "summary":
        return summary_block(points).select("pid", F.concat(F.lit("Summary: "), "line").alias("observed"))
    if mode not in ("first", "last"):
        raise ValueError(f"unknown mode {mode}")
    own = Window.partitionBy("pid").orderBy("epoch" if mode == "first" else F.desc("epoch"))
    shown = points.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= (first if mode == "first" else last))
    y = F.when(is_finite(F.col("y")), F.col("y")).alias("y")
    g = shown.select("pid", F.struct("epoch", "d", y).alias("r")).groupBy("pid").agg(table_block(F.array_sort(F.collect_list("r"))).alias("t"))
    return g.select("pid", F.concat(F.lit("First points:\n" if mode == "first" else "Last points:\n"), "t").alias("observed"))


def prompts(points: DataFrame, statics: DataFrame, task: str, n_anchors: int = 12, window: int = 16, top: int = 5, mode: str = "summary", first: int = 50, last: int = 64) -> DataFrame:
    """pid, task_name, prompt: how a step is told (step tasks), the observations by mode, static line, anchors, step candidates and window (step tasks), and what may be answered."""
    lines = lambda df, name: df.groupBy("pid").agg(table_block(F.array_sort(F.collect_list(F.struct("epoch", "d", "y")))).alias(name))
    out = observations(points, mode, first, last).join(statics.select("pid", "static_rmse"), "pid", "left").join(lines(anchors(points, n_anchors, "auto", task), "anchor_text"), "pid", "left")
    parts = [F.lit(GUIDANCE.get(task)), F.col("observed"), F.nullif(static_block(F.col("static_rmse")), F.lit("")), F.concat(F.lit("Anchor points:\n"), "anchor_text")]
    if task in GUIDANCE:
        out = out.join(candidate_lines(step_candidates(points, top)), "pid", "left").join(lines(anchors(points, window, "step_window"), "window_text"), "pid", "left")
        parts += [F.concat(F.lit("Step candidates:\n"), "block"), F.concat(F.lit("Window points around #1:\n"), "window_text")]
    parts += [F.lit(f"Answer as JSON with the key answer: {ALLOWED[task]}.")]
    return out.select("pid", F.lit(task).alias("task_name"), F.concat_ws("\n\n", *parts).alias("prompt"))


def block_after(text: Column, header: str) -> Column:
    """Text from the line after the one that starts with header to the next empty line."""
    return F.regexp_extract(text, rf"(?m)^{header}[^\n]*\n((?:[^\n]+\n?)*)", 1)


def points_of(block: Column) -> Column:
    """Array of (d, y) structs of date,number lines; NA values and other lines are left out."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2},"))
    parsed = F.transform(lines, lambda x: F.named_struct(F.lit("d"), parse_date(F.substring_index(x, ",", 1), "score"), F.lit("y"), safe_double(F.substring_index(x, ",", -1))))
    return F.filter(parsed, lambda p: p["d"].isNotNull() & p["y"].isNotNull())


def rmse_of(text: Column) -> Column:
    """The number after rmse_mm=; 1 if missing or not positive."""
    v = F.regexp_extract(text, r"rmse_mm=([0-9.]+)", 1).try_cast("double")
    return F.coalesce(F.when(v > 0, v), F.lit(1.0))


def candidates_of(prompts: DataFrame) -> DataFrame:
    """pid, rank, left_date, right_date, delta, est, window, anchors and rmse parsed from prompts."""
    text = F.col("prompt")
    p = prompts.select("pid", rmse_of(text).alias("rmse"), points_of(block_after(text, "Window points")).alias("window"), points_of(block_after(text, "Anchor points")).alias("anchors"), F.explode(F.filter(F.split(text, "\n"), lambda x: x.startswith("- #"))).alias("line"))
    field = lambda pattern: F.regexp_extract("line", pattern, 1)
    return p.select("pid", field(r"^- #(\d+):").cast("int").alias("rank"), parse_date(field(r"(\d{4}-\d{2}-\d{2}) ->"), "score").alias("left_date"), parse_date(field(r"-> (\d{4}-\d{2}-\d{2})"), "score").alias("right_date"), safe_double(field(r"delta_mm=([-+0-9.eE]+)")).alias("delta"), safe_double(field(r"est_step_mag_abs_mm≈([-+0-9.eE]+)")).alias("est"), "window", "anchors", "rmse")


def parse_answer(text: Column) -> Column:
    """(answer, parse_error) of a reply: the whole text as JSON, else its first braces; codes say what failed."""
    t = F.trim(text)
    read = lambda j: F.get_json_object(j, "$.answer")
    object_ = F.regexp_extract(t, r"(?s)(\{.*?\})", 1)
    greedy = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    valid = lambda j: F.get_json_object(j, "$").isNotNull()
    has = lambda j: F.array_contains(F.json_object_keys(j), "answer")
    out = lambda answer, error: F.struct(answer.cast("string").alias("answer"), (F.lit(error) if error else F.lit(None)).cast("string").alias("parse_error"))
    null = F.lit(None)
    salvaged = lambda j, otherwise: F.when(valid(j), F.when(has(j), out(read(j), None)).otherwise(out(null, "salvaged_json_missing_answer_key"))).otherwise(otherwise)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", out(null, "empty_response"))
        .when(t.startswith("{") & t.endswith("}") & valid(t), F.when(has(t), out(read(t), None)).otherwise(out(null, "json_missing_answer_key")))
        .when(greedy == "", out(null, "no_json_object_found"))
        .otherwise(salvaged(object_, salvaged(greedy, out(null, "json_parse_error"))))
    )


def validate_answer(task: Column, answer: Column) -> Column:
    """Null if a task may be answered so, else the reason."""
    t, v = norm(answer, ""), safe_double(answer)
    none_or_number = F.when((t == "none") | v.isNotNull(), F.lit(None)).otherwise("not_number_or_none")
    return (
        F.when(answer.isNull(), "answer_null")
        .when(task == TASKS[0], F.when(~t.isin("subsiding", "stable", "uplifting"), "not_in_labels"))
        .when(task == TASKS[1], F.when(v.isNull(), "not_number"))
        .when(task == TASKS[2], F.when(~t.isin("seasonal", "nonseasonal"), "not_in_labels"))
        .when(task.isin(TASKS[3], TASKS[5]), none_or_number)
        .when(task == TASKS[4], F.when((t != "none") & ~t.rlike(r"^\d{8}$"), "not_yyyymmdd_or_none"))
        .otherwise("unknown_task")
    )


def envelope_text(reply: Column) -> Column:
    """The message in a provider's reply of either common shape."""
    return F.coalesce(F.get_json_object(reply, "$.candidates[0].content.parts[0].text"), F.get_json_object(reply, "$.choices[0].message.content"))
