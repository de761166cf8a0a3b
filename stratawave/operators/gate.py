"""The decision gate between a model's and a baseline's step answers: an ordered cascade, the first rule that holds decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import days_between, is_none, millimetres, parse_date, safe_double, strict_bool, yyyymmdd


# The defaults of GateConfig, the stricter limits in max_jump_of, and the names of the actions
# (pass_through, keep_llm, force_none, conflict_force_none, impute_best, override, format_fix).


@dataclass(frozen=True)
class GateConfig:
    """Thresholds and switches; every action is off unless asked for."""

    step_mag: float = 2.0
    step_snr: float = 1.5
    step_improve: float = 0.02
    step_bic: float = 0.0
    force_persist: float = 0.7
    veto_mag: float | None = None
    veto_snr: float | None = None
    veto_improve: float | None = None
    veto_persist: float = 0.5
    veto_use_bic: bool = False
    veto_bic: float = 0.0
    veto_on_base_none: bool = False
    conflict_days: int = 0
    override_c1: bool = False
    override_c2: bool = False
    impute_c1: bool = False
    impute_c2: bool = False
    c1_guard: bool = False
    c2_guard: bool = False
    guard_mag: float = 2.0
    guard_snr: float = 1.5
    guard_improve: float = 0.02
    guard_bic: float = 0.0
    guard_days: int = 60
    format_fix: bool = False
    format_days: int = 12
    format_mm: float = 0.5

    def veto(self, name: str) -> float:
        own = getattr(self, f"veto_{name}")
        return own if own is not None else 0.7 * getattr(self, f"step_{name}")


def best_step(raw: Column) -> Column:
    """Typed evidence of a baseline's best step from a map of texts with several possible names per field."""
    first = lambda *names: F.coalesce(*[raw[n] for n in names])
    number = lambda *names: F.coalesce(safe_double(first(*names)), F.lit(0.0))
    persist = number("persist_frac", "persist", "persist_score")
    flag = F.coalesce(strict_bool(raw["persist_flag"]), F.when(~F.map_contains_key(raw, "persist_flag"), persist >= 0.5).otherwise(F.coalesce(F.length(raw["persist_flag"]) > 0, F.lit(False))))
    fields = F.struct(number("mag_abs_mm").alias("mag"), number("snr").alias("snr"), number("improve_frac", "improve", "improve_ratio").alias("improve"), number("delta_bic", "bic_delta", "bic").alias("bic"), persist.alias("persist"), flag.alias("flag"), first("date", "step_date", "step_date_candidate", "time").alias("date"))
    return F.when(F.size(raw) > 0, fields)


def strong_no_step(b: Column, c: GateConfig) -> Column:
    """Enough weak signs: two of four if the size is small, three otherwise; one more of each if the BIC votes too."""
    weak = b["mag"] < c.veto("mag")
    votes = weak.cast("int") + (b["snr"] < c.veto("snr")).cast("int") + (b["improve"] < c.veto("improve")).cast("int") + ((b["persist"] < c.veto_persist) & ~b["flag"]).cast("int")
    if c.veto_use_bic:
        votes = votes + (b["bic"] > c.veto_bic).cast("int")
    extra = int(c.veto_use_bic)
    return votes >= F.when(weak, 2 + extra).otherwise(3 + extra)


def evident_step(b: Column, c: GateConfig) -> Column:
    return (b["mag"] >= c.step_mag) & (b["snr"] >= c.step_snr) & (b["improve"] >= c.step_improve) & (b["bic"] <= c.step_bic)


def strong_step(b: Column, c: GateConfig) -> Column:
    return evident_step(b, c) & (b["persist"] >= c.force_persist) & b["flag"]


def max_jump_of(candidates: Column, c: GateConfig) -> Column:
    """Largest absolute adjacent change of the candidates that pass stricter thresholds; null if none does."""
    mag, snr = max(c.step_mag, c.guard_mag, 2.5), max(c.step_snr, c.guard_snr, 2.5)
    improve, persist = max(c.step_improve, c.guard_improve, 0.04), max(c.force_persist, 0.8)
    good = F.filter(candidates, lambda x: x["raw_adj_delta_mm"].isNotNull() & (F.abs(x["raw_adj_delta_mm"]) >= mag) & (x["snr"] >= snr) & (x["improve_frac"] >= improve) & (x["persist_frac"] >= persist) & (x["delta_bic"] <= -5.0))
    return F.array_max(F.transform(good, lambda x: F.abs(x["raw_adj_delta_mm"])))


def decide(rows: DataFrame, c: GateConfig = GateConfig()) -> DataFrame:
    """Adds action and final. rows: task_name, llm_pred, base_pred, best (see best_step), candidates (array of structs)."""
    llm, base, b = F.col("llm_pred"), F.col("base_pred"), F.col("best")
    c1, c2 = F.col("task_name") == "C1_step_time", F.col("task_name") == "C2_step_mag"
    llm_none, base_none, has = is_none(llm), is_none(base), b.isNotNull()
    strong = has & F.coalesce(strong_step(b, c), F.lit(False))
    best_date, llm_date, base_date = parse_date(b["date"], "gate"), parse_date(llm, "gate"), parse_date(base, "gate")
    jump = max_jump_of(F.col("candidates"), c)
    act = lambda name, value: F.struct(F.lit(name).alias("action"), value.cast("string").alias("final"))
    nothing, keep, rules = F.lit(None), act("keep_llm", llm), []
    yes = lambda x: F.coalesce(x, F.lit(False))
    if c.impute_c1:
        rules.append((llm_none & base_none & strong & c1 & best_date.isNotNull(), act("impute_best", yyyymmdd(best_date))))
    if c.impute_c2:
        rules.append((llm_none & base_none & strong & c2, act("impute_best", F.bround(F.coalesce(jump, b["mag"]), 1))))
    if c.conflict_days > 0:
        rules.append((c1 & ~llm_none & ~base_none & yes(days_between(llm_date, base_date) > c.conflict_days), act("conflict_force_none", nothing)))
    if c.veto_on_base_none:
        veto = ~llm_none & base_none
        guarded = has & yes((b["snr"] >= c.guard_snr) & (b["improve"] >= c.guard_improve) & (b["bic"] <= c.guard_bic) & (b["mag"] >= c.guard_mag))
        if c.c2_guard:
            rules.append((veto & c2 & guarded, keep))
        if c.c1_guard:
            rules.append((veto & c1 & guarded & yes(days_between(llm_date, best_date) <= c.guard_days), keep))
        else:
            rules.append((veto & c1 & has & yes(evident_step(b, c)), keep))
        rules.append((veto, act("force_none", nothing)))
    rules.append((~llm_none & has & yes(strong_no_step(b, c)), act("force_none", nothing)))
    if c.override_c1:
        rules.append((llm_none & ~base_none & strong & c1, act("override", base)))
    if c.override_c2:
        rules.append((llm_none & ~base_none & strong & c2, act("override", F.coalesce(F.bround(jump, 1).cast("string"), base))))
    if c.format_fix:
        near = yes(days_between(llm_date, base_date) <= c.format_days) & (F.trim(llm) != yyyymmdd(llm_date))
        rules.append((~llm_none & ~base_none & c1 & near, act("format_fix", yyyymmdd(llm_date))))
        a = millimetres(llm)
        close = yes(F.abs(a - millimetres(base)) <= c.format_mm)
        rules.append((~llm_none & ~base_none & c2 & close & (F.trim(llm) != F.bround(a, 1).cast("string")), act("format_fix", F.bround(a, 1))))
    verdict = None
    for when, then in rules:
        verdict = F.when(when, then) if verdict is None else verdict.when(when, then)
    verdict = F.when(c1 | c2, verdict.otherwise(keep)).otherwise(act("pass_through", llm))
    return rows.withColumn("_v", verdict).select("*", "_v.action", "_v.final").drop("_v")


def counters(decided: DataFrame) -> DataFrame:
    """n by action and task, and how many of them changed."""
    changed = ~F.coalesce(F.col("final"), F.lit("none")).eqNullSafe(F.coalesce("llm_pred", F.lit("none")))
    return decided.groupBy("action", "task_name").agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"))
