"""Merging prediction tables task by task, and the one-way consistency gate between tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import base_key, norm
from .score import last_wins

#: Labels that mean no season, and no step.
NO_SEASON = ("nonseasonal", "none", "no", "false", "0")
NO_STEP = ("none", "no_step", "nostep", "no", "false", "0")


def merge_tasks(main: DataFrame, alt: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """id, task_name, answer_parsed, parse_error, src: alt's row where its task is among tasks, else main's, else alt's (as src main). Last rows win."""
    fields = ["task_name", "answer_parsed", "parse_error"]
    side = lambda df, name: last_wins(df, "id").select("id", F.struct(*fields).alias(name))
    both = side(main, "m").join(side(alt, "a"), "id", "full")
    use = F.coalesce(F.col("a.task_name").isin(*tasks), F.lit(False))
    chosen = F.when(use | F.col("m").isNull(), F.col("a")).otherwise(F.col("m"))
    return both.select("id", chosen.alias("c"), F.when(use, "alt").otherwise("main").alias("src")).select("id", "c.*", "src")


def merge_flagged(main: DataFrame, alt: DataFrame, tasks: Sequence[str], flag: str = "use_alt") -> DataFrame:
    """main's rows, with alt's answer and parse_error where alt has the same id and task, the task is among tasks and the flag is set."""
    other = last_wins(alt, "id", "task_name").select("id", "task_name", F.col("answer_parsed").alias("_a"), F.col("parse_error").alias("_e"), F.coalesce(F.col(flag), F.lit(False)).alias("_use"))
    use = F.coalesce(F.col("_use") & F.col("task_name").isin(*tasks), F.lit(False))
    out = main.join(other, ["id", "task_name"], "left")
    return out.select(*[c for c in main.columns if c not in ("answer_parsed", "parse_error")], F.when(use, F.col("_a")).otherwise(F.col("answer_parsed")).alias("answer_parsed"), F.when(use, F.col("_e")).otherwise(F.col("parse_error")).alias("parse_error"), use.alias("merged_from_alt"))


def consistency_gate(pred: DataFrame, season: bool = True, step: bool = True) -> DataFrame:
    """pred with B2 none where its series' B1 says no season, C2 none where C1 says no step; gate_applied tells which.

    Of several B1 or C1 rows of a series, the last that is not empty counts.
    """
    key = base_key(F.col("id"), F.col("task_name"))
    keyed = pred.withColumn("_key", key)
    value = norm(F.col("answer_parsed"), "")
    say = lambda task: F.max_by(F.when((F.col("task_name") == task) & (value != ""), value), F.when((F.col("task_name") == task) & (value != ""), F.col("_seq")))
    said = keyed.where(F.col("task_name").isin("B1_seasonality_present", "C1_step_time")).groupBy("_key").agg(say("B1_seasonality_present").alias("_b1"), say("C1_step_time").alias("_c1"))
    rule = F.lit(None).cast("string")
    if step:
        rule = F.when((F.col("task_name") == "C2_step_mag") & F.col("_c1").isin(*NO_STEP), "C1->C2").otherwise(rule)
    if season:
        rule = F.when((F.col("task_name") == "B2_seasonality_amp") & F.col("_b1").isin(*NO_SEASON), "B1->B2").otherwise(rule)
    out = keyed.join(said, "_key", "left").withColumn("gate_applied", rule)
    return out.withColumn("answer_parsed", F.when(F.col("gate_applied").isNotNull(), "none").otherwise(F.col("answer_parsed"))).drop("_key", "_b1", "_c1")
