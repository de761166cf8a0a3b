"""Numerical kernels per series, as Arrow-batched functions over array columns: regressions and step detectors.

Every boundary's segmented regression is solved at once: the step column is
made orthogonal to the base model, after which coefficient, residual sum and
standard error are dot products.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = 365.25


def least_squares(x: np.ndarray, y: np.ndarray) -> dict:
    """Coefficients (smallest norm if undetermined), residuals, rss, sigma and the standard error of each coefficient (NaN if singular)."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    resid = y - x @ beta
    rss = float(resid @ resid)
    sigma = float(np.sqrt(rss / max(1, len(y) - x.shape[1])))
    try:
        var = np.diag(np.linalg.inv(x.T @ x)) * sigma**2
        se = np.where(np.isfinite(var) & (var > 0), np.sqrt(np.abs(var)), np.nan)
    except np.linalg.LinAlgError:
        se = np.full(x.shape[1], np.nan)
    return {"beta": beta, "resid": resid, "rss": rss, "sigma": sigma, "se": se}


def base_design(t_days: np.ndarray) -> np.ndarray:
    """1, years, annual sine and cosine."""
    w = 2 * np.pi / YEAR * t_days
    return np.stack([np.ones(len(t_days)), t_days / YEAR, np.sin(w), np.cos(w)], 1)


def mad_sigma(x: np.ndarray, floor_small: bool = True) -> float:
    """MAD / 0.6745; the standard deviation for under five values or zero MAD; 1 for what is not positive (small samples only if asked)."""
    if len(x) < 5:
        s = float(np.std(x)) if len(x) else 1.0
        return s if not floor_small else (s if np.isfinite(s) and s > 1e-9 else 1.0)
    mad = float(np.median(np.abs(x - np.median(x))))
    s = mad / 0.6745 if mad > 0 else float(np.std(x))
    return s if np.isfinite(s) and s > 1e-9 else 1.0


def bic(rss: np.ndarray, n: int, p: int) -> np.ndarray:
    return n * np.log(np.maximum(rss, 1e-12) / max(1, n)) + p * np.log(max(2, n))


def windows(v: np.ndarray, js: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians of the k values before and from each boundary, and the share of the latter nearer to their own median."""
    pre, post = v[js[:, None] + np.arange(-k, 0)], v[js[:, None] + np.arange(k)]
    a, b = np.median(pre, 1), np.median(post, 1)
    near = np.mean(np.abs(post - b[:, None]) <= np.abs(post - a[:, None]), 1)
    return a, b, near


NONE = {"present": False, "reason": "insufficient_valid", "j": None, "mag": None, "mag_abs": None, "snr": None, "improve": None, "delta_bic": None, "persist_flag": None, "sigma": None, "score": None}
#: Two-stage detector: what a present step must reach.
PRESENT = {"mag": 1.5, "snr": 1.2, "improve": 0.01, "bic": -1.0, "persist": 0.7}


def two_stage_detector(t: np.ndarray, y: np.ndarray, rmse: float, k: int = 3, top: int = 5) -> list[dict]:
    """Candidates by falling score (the first is the best), or one row telling why there are none.

    Stage one ranks boundaries by adjacent changes and window shifts in units of
    noise, damped by unusual gaps; the best, four quantiles and the largest
    residual change go on. Stage two adds a level step to the base model.
    """
    n = len(y)
    if n < 2 * k + 6:
        return [NONE]
    gaps = np.diff(t)
    usual = float(np.median(gaps)) if n >= 3 and np.median(gaps) > 1e-6 else 12.0
    x = base_design(t)
    base = least_squares(x, y)
    sigma = rmse if rmse and rmse > 0 else mad_sigma(base["resid"])
    side = max(k, 4)
    js = np.arange(side, n - side)
    if not len(js):
        return [NONE | {"reason": "no_stage1_candidates"}]
    r = base["resid"]
    (a_y, b_y, near_y), (a_r, b_r, near_r) = windows(y, js, k), windows(r, js, k)
    d_y, d_r, m_y, m_r = np.abs(y[js] - y[js - 1]), np.abs(r[js] - r[js - 1]), np.abs(b_y - a_y), np.abs(b_r - a_r)
    ratio = gaps[js - 1] / usual
    damp = np.where((gaps[js - 1] <= 0) | (ratio <= 1.5), 1.0, 1 / np.sqrt(1 + np.maximum(ratio - 1.5, 0)))
    unit = max(1e-9, sigma)
    # Weights of the two scores.
    first = (1.2 * d_r + 0.6 * m_r + 0.3 * d_y + 0.2 * m_y) / unit * damp
    chosen = set(np.argsort(-first, kind="stable")[: max(20, 6 * top)])
    chosen |= {min(max(round(side + q * (n - 2 * side)), side), n - side - 1) - side for q in (0.2, 0.4, 0.6, 0.8)}
    chosen.add(int(np.argmax(d_r)))
    at = np.array(sorted(chosen))
    step = (np.arange(n)[None, :] >= js[at][:, None]).astype(float)
    q, _ = np.linalg.qr(x)
    rest = step - (step @ q) @ q.T
    norm = np.maximum((rest * rest).sum(1), 1e-300)
    coef = rest @ y / norm
    rss = np.maximum(base["rss"] - coef**2 * norm, 0)
    sigma1 = np.sqrt(rss / max(1, n - 5))
    se = sigma1 / np.sqrt(norm)
    snr = np.where(se > 0, np.abs(coef) / np.where(se > 0, se, 1), np.abs(coef) / unit)
    improve = (base["rss"] - rss) / base["rss"] if base["rss"] > 1e-12 else np.zeros(len(at))
    delta = bic(rss, n, 5) - bic(np.array(base["rss"]), n, 4)
    flag = (near_y[at] >= PRESENT["persist"]) | (near_r[at] >= PRESENT["persist"])
    score = (0.9 * snr + 6 * improve + 0.25 * np.maximum(0, -delta) + (1.1 * d_r[at] + 0.25 * d_y[at] + 0.35 * m_r[at]) / unit + flag) * damp[at]
    out = []
    for c in np.argsort(-score, kind="stable")[: max(1, top)]:
        present = abs(coef[c]) >= PRESENT["mag"] and snr[c] >= PRESENT["snr"] and improve[c] >= PRESENT["improve"] and delta[c] <= PRESENT["bic"] and flag[c]
        out.append({"present": bool(present), "reason": "ok" if present else "below_threshold", "j": int(js[at[c]]), "mag": float(coef[c]), "mag_abs": float(abs(coef[c])), "snr": float(snr[c]), "improve": float(improve[c]), "delta_bic": float(delta[c]), "persist_flag": bool(flag[c]), "sigma": float(sigma), "score": float(score[c])})
    return out


def one_stage_detector(t: np.ndarray, y: np.ndarray, rmse: float, k: int = 3, top: int = 5) -> list[dict]:
    """The earlier detector: window medians of the residuals of the base model, one score."""
    n = len(y)
    if n < 2 * k + 2:
        return [NONE]
    r = least_squares(base_design(t) * np.array([1, YEAR, 1, 1]), y)["resid"]
    sigma = rmse if rmse and rmse > 0 else mad_sigma(r, floor_small=False)
    js = np.arange(k, n - k)
    if not len(js):
        return [NONE | {"reason": "no_candidates"}]
    pre, post = r[js[:, None] + np.arange(-k, 0)], r[js[:, None] + np.arange(k)]
    a, b = np.median(pre, 1), np.median(post, 1)
    whole = float(((r - np.median(r)) ** 2).sum())
    parts = ((pre - a[:, None]) ** 2).sum(1) + ((post - b[:, None]) ** 2).sum(1)
    improve = (whole - parts) / whole if whole > 1e-9 else np.zeros(len(js))
    size = np.abs(b - a)
    snr = size / sigma if sigma > 1e-9 else np.zeros(len(js))
    score = snr + 2 * improve + 0.5  # the later median always keeps its own distance
    out = []
    for c in np.argsort(-score, kind="stable")[:top]:
        present = size[c] >= 2.0 and snr[c] >= 1.0 and improve[c] >= 0.1
        out.append({"present": bool(present), "reason": "ok" if present else "below_threshold", "j": int(js[c]), "mag": float(b[c] - a[c]), "mag_abs": float(size[c]), "snr": float(snr[c]), "improve": float(improve[c]), "delta_bic": None, "persist_flag": True, "sigma": float(sigma), "score": float(score[c])})
    return out


#: Detectors by name; more can be registered.
DETECTORS: dict[str, Callable] = {"two_stage": two_stage_detector, "one_stage": one_stage_detector}


def register_detector(name: str, detector: Callable) -> None:
    DETECTORS[name] = detector


CANDIDATE = "array<struct<present:boolean,reason:string,j:int,mag:double,mag_abs:double,snr:double,improve:double,delta_bic:double,persist_flag:boolean,sigma:double,score:double>>"


def detect(t: Column, y: Column, rmse: Column, detector: str = "two_stage", k: int = 3, top: int = 5) -> Column:
    """Step candidates of series given as arrays of days and values in date order, finite only."""
    own = DETECTORS[detector]

    @F.pandas_udf(CANDIDATE)
    def run(t: pd.Series, y: pd.Series, rmse: pd.Series) -> pd.Series:
        return pd.Series([own(np.asarray(a, float), np.asarray(b, float), r, k, top) for a, b, r in zip(t, y, rmse, strict=True)])

    return run(t, y, rmse)


FITS = "struct<slope:double,slope_se:double,slope_snr:double,lin_sigma:double,lin_rss:double,amp:double,sea_sigma:double,sea_rss:double,sea_snr:double,sea_improve:double>"


def fit_both(t: Column, y: Column) -> Column:
    """Linear and seasonal fits of series given as arrays; null under six points."""

    @F.pandas_udf(FITS)
    def run(t: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(t, y, strict=True):
            a, b = np.asarray(a, float), np.asarray(b, float)
            if len(b) < 6:
                out.append((None,) * 10)
                continue
            x = base_design(a)
            lin, sea = least_squares(x[:, :2], b), least_squares(x, b)
            slope, se = float(lin["beta"][1]), float(lin["se"][1])
            amp = float(np.hypot(*sea["beta"][2:]))
            out.append((slope, se if se == se else None, abs(slope) / se if se > 0 else None, lin["sigma"], lin["rss"], amp, sea["sigma"], sea["rss"], amp / sea["sigma"] if sea["sigma"] > 0 else None, (lin["rss"] - sea["rss"]) / lin["rss"] if lin["rss"] > 0 else 0.0))
        return pd.DataFrame(out, columns=["slope", "slope_se", "slope_snr", "lin_sigma", "lin_rss", "amp", "sea_sigma", "sea_rss", "sea_snr", "sea_improve"])

    return run(t, y)


def day_arrays(points: DataFrame) -> DataFrame:
    """pid, dates, t (days since the first), v: finite points in date order."""
    from ..functions.coerce import is_finite

    g = points.where(is_finite(F.col("y"))).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("d", "y"))).alias("p"))
    dates = F.transform("p", lambda x: x["d"])
    return g.select("pid", dates.alias("dates"), F.transform("p", lambda x: F.datediff(x["d"], F.get("p", F.lit(0))["d"]).cast("double")).alias("t"), F.transform("p", lambda x: x["y"]).alias("v"))


def series_of_examples(examples: DataFrame, least: int = 6) -> DataFrame:
    """pid, d, epoch, total, y: of each series the slice of one example, whatever slices its other examples carry.

    examples: pid, _seq (place in the file), slice (array of d, y structs). Taken is the first in file order
    with at least that many finite values; where none has, the first. baseline_stats then gives all six
    tasks of the series the statistics of that slice.
    """
    from ..functions.coerce import is_finite

    enough = F.size(F.filter("slice", lambda p: is_finite(p["y"].cast("double")))) >= least
    one = examples.groupBy("pid").agg(F.min_by("slice", F.struct(~F.coalesce(enough, F.lit(False)), "_seq")).alias("s"))
    return one.select("pid", F.size("s").alias("total"), F.posexplode("s").alias("epoch", "p")).select("pid", "p.d", "epoch", "total", F.col("p.y").cast("double").alias("y"))


def baseline_stats(points: DataFrame, statics: DataFrame, detector: str = "two_stage") -> DataFrame:
    """pid, ok, fit, candidates, best and step_date, present by the gate's own thresholds; each series is computed once."""
    a = points.select("pid").distinct().join(day_arrays(points), "pid", "left").join(statics.select("pid", "static_rmse"), "pid", "left")
    a = a.withColumns({"t": F.coalesce("t", F.array().cast("array<double>")), "v": F.coalesce("v", F.array().cast("array<double>"))})
    a = a.withColumns({"ok": F.size("v") >= 6, "fit": fit_both(F.col("t"), F.col("v")), "candidates": detect(F.col("t"), F.col("v"), F.coalesce("static_rmse", F.lit(0.0)), detector)})
    a = a.withColumn("best", F.when(F.get("candidates", F.lit(0))["j"].isNotNull(), F.get("candidates", F.lit(0))))
    b = F.col("best")
    present = (b["mag_abs"] >= 3.0) & (b["snr"] >= 2.0) & (b["improve"] >= 0.05) & b["persist_flag"] & (F.coalesce(b["delta_bic"], F.lit(1e9)) <= 0.0)
    return a.select("pid", "ok", "fit", "candidates", "best", F.get("dates", b["j"]).alias("step_date"), F.coalesce(present, F.lit(False)).alias("present"))


def baseline_answers(stats: DataFrame, v_stable: float = 0.5, snr: float = 1.5, improve: float = 0.05, amp: float = 0.5) -> DataFrame:
    """pid, task_name, answer: the six answers of every series, defaults where its statistics are not ok."""
    f, ok = F.col("fit"), F.col("ok")
    trend = F.when(~ok | (F.abs(f["slope"]) < v_stable), "stable").when(f["slope"] < 0, "subsiding").otherwise("uplifting")
    season = F.coalesce(ok & (f["sea_snr"] >= snr) & (f["sea_improve"] >= improve) & (f["amp"] >= amp), F.lit(False))
    step = ok & F.col("present")
    say = lambda task, value: F.struct(F.lit(task).alias("task_name"), value.cast("string").alias("answer"))
    rows = F.array(
        say("A1_trend_dir", trend), say("A2_trend_v", F.when(ok, F.round(f["slope"], 6)).otherwise(0.0)), say("B1_seasonality_present", F.when(season, "seasonal").otherwise("nonseasonal")),
        say("B2_seasonality_amp", F.when(season, F.round(f["amp"], 6).cast("string")).otherwise("none")), say("C1_step_time", F.when(step, F.date_format("step_date", "yyyyMMdd")).otherwise("none")), say("C2_step_mag", F.when(step, F.round(F.col("best.mag_abs"), 6).cast("string")).otherwise("none")),
    )
    return stats.select("pid", F.inline(rows))
