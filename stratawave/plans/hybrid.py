"""The hybrid chain: rule predictors merged into a model's answers task by task, gated for consistency, scored and compared."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, predict, score, slices
from . import stages


@dataclass(frozen=True)
class ChainConfig:
    """Thresholds of the chain's rules."""

    b1: dict = field(default_factory=lambda: {"amp": 0.9, "snr": 1.2})
    b2: dict = field(default_factory=lambda: {"amp": 1.0, "snr": 1.2, "step": 0.25})
    guard: dict = field(default_factory=lambda: {"mag": 1.2, "snr": 2.5, "persist": 0.75, "edge": 2.0, "score": 1.5})


def as_predictions(rows: DataFrame, task: str, answer, tiles: DataFrame, error=None) -> DataFrame:
    """pid rows as predictions: id, task_name, answer_parsed, parse_error, _seq."""
    return rows.join(tiles, "pid").select(F.concat_ws("_", "tile", F.col("pid").cast("string"), F.lit(task)).alias("id"), F.lit(task).alias("task_name"), answer.cast("string").alias("answer_parsed"), (error if error is not None else F.lit(None)).cast("string").alias("parse_error"), F.lit(0).alias("_seq"))


def hybrid(model: DataFrame, points: DataFrame, statics: DataFrame, config: ChainConfig = ChainConfig()) -> DataFrame:
    """The model's predictions with B1 and B2 from rules, C1 none where the guard finds no evidence, C2 from step rules, then the gate."""
    tiles = points.select("pid", "tile").distinct()
    ids = tiles.select("pid")
    b1 = as_predictions(predict.b1(points, statics, **config.b1), "B1_seasonality_present", F.col("answer"), tiles)
    b2 = as_predictions(predict.b2(points, statics, ids, **config.b2), "B2_seasonality_amp", F.coalesce(F.col("answer_numeric").cast("string"), F.lit("none")), tiles)
    guard = as_predictions(predict.none_guard(points, **config.guard).where("use_alt"), "C1_step_time", F.lit("none"), tiles).withColumn("use_alt", F.lit(True))
    step = predict.c1(points, statics, ids)
    c2 = as_predictions(step, "C2_step_mag", F.coalesce(F.round("mag", 1).cast("string"), F.lit("none")), tiles)
    now = merge.merge_tasks(model, b1, ["B1_seasonality_present"]).withColumn("_seq", F.lit(0))
    now = merge.merge_tasks(now, b2, ["B2_seasonality_amp"]).withColumn("_seq", F.lit(0))
    now = merge.merge_flagged(now, guard, ["C1_step_time"])
    now = merge.merge_tasks(now.withColumn("_seq", F.lit(0)), c2, ["C2_step_mag"]).withColumn("_seq", F.lit(0))
    return merge.consistency_gate(now)


def hybrid_stages(config: ChainConfig = ChainConfig()) -> list[stages.Stage]:
    """The chain as restartable stages over the sources model, points, statics and gold: rules one by one, the merged answers, the comparison."""
    settings = {"b1": config.b1, "b2": config.b2, "guard": config.guard}

    def rules(points, statics, **own):
        return predict.b1(points, statics, **own)

    def merged(model, points, statics, b1, b2, guard):
        return hybrid(model, points, statics, ChainConfig(b1, b2, guard))

    def compared(gold, model, own):
        return compare(gold, {"model": model, "hybrid": own}, "model")

    return [
        stages.Stage("b1_rules", rules, ("points", "statics"), config.b1),
        stages.Stage("hybrid", merged, ("model", "points", "statics"), settings),
        stages.Stage("compared", compared, ("gold", "model", "hybrid")),
    ]


def compare(gold: DataFrame, systems: dict[str, DataFrame], reference: str) -> DataFrame:
    """system, micro, macro and differences to the reference, all gold ids scored."""
    every = None
    for name, pred in systems.items():
        own = score.score(gold, pred, "all").select(F.lit(name).alias("system"), "task_name", "ok")
        every = own if every is None else every.unionByName(own)
    return slices.system_deltas(every, reference)
