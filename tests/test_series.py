import datetime
import statistics

import numpy as np
from pyspark.sql import functions as F

from stratawave.operators import gate, kernels, label, predict, sample, spatial, text

START = datetime.date(2018, 1, 1)


def series(spark, values, pid=1, gap=12):
    rows = [("t", pid, START + datetime.timedelta(days=gap * i), i, len(values), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tile string, pid long, d date, epoch int, total int, y double")


def noisy_step(n=80, at=45, size=6.0, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 12
    return t, 0.5 * np.sin(2 * np.pi * t / 365.25) + rng.normal(0, 0.5, n) + size * (np.arange(n) >= at)


def test_fits_against_least_squares(spark):
    t, y = noisy_step(size=0)
    years = t / 365.25
    f = label.fits(series(spark, y)).first()
    slope = np.linalg.lstsq(np.stack([years, np.ones_like(years)], 1), y, rcond=None)[0][0]
    a, b, _ = np.linalg.lstsq(np.stack([np.sin(2 * np.pi * years), np.cos(2 * np.pi * years), np.ones_like(years)], 1), y, rcond=None)[0]
    assert abs(f.slope - slope) < 1e-9 and abs(f.amplitude - np.hypot(a, b)) < 1e-9
    flat = label.fits(series(spark, [1.0] * 5)).first()
    assert flat.slope == 0 and label.fits(series(spark, [None, float("nan"), 2.0])).first().slope is None


def test_max_jump_ties_and_gaps(spark):
    st = spark.createDataFrame([(1, 0.0)], "pid long, rmse double")
    j = label.max_jump(series(spark, [0, 3, 3, 0, None, 9]), st).first()
    assert j.jump == 3 and str(j.step_date) == "2018-01-13" and j.is_step
    assert label.max_jump(series(spark, [0, None, 5]), st).count() == 0


def brute_splits(t, y, min_pre, min_post, strict):
    out = []
    for k in range(min_pre, len(y) - min_post + 1):
        a, b = statistics.median(y[:k]), statistics.median(y[k:])
        near = [abs(x - b) < abs(x - a) if strict else abs(x - b) <= abs(x - a) for x in y[k:]]
        out.append((k, b - a, sum(near) / len(near)))
    return out


def test_split_scans(spark):
    t, y = noisy_step(40, 22)
    p = series(spark, y)
    for strict in (False, True):
        got = sorted((r.i, r.mag, r.persist) for r in predict.split_scan(p, 2, 5, 120, strict).collect())
        for g, w in zip(got, brute_splits(t, list(y), 2, 5, strict), strict=True):
            assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-12 and abs(g[2] - w[2]) < 1e-12
    st = spark.createDataFrame([(1, 0.5)], "pid long, meta_rmse double")
    ids = spark.createDataFrame([(1,), (2,)], "pid long")
    c = {r.pid: r for r in predict.c1(p, st, ids).collect()}
    best = min((-near, -abs(m), -abs(y[k] - y[k - 1]), k) for k, m, near in brute_splits(t, list(y), 2, 5, False) if abs(m) >= 2)
    assert c[1].step_date == START + datetime.timedelta(days=12 * best[-1]) and c[2].parse_error == "missing_dataset_row"
    assert not predict.none_guard(p).first().use_alt
    assert predict.none_guard(series(spark, [0.0] * 20)).first().use_alt


def test_short_series_predictors(spark):
    st = spark.createDataFrame([(1, 0.5)], "pid long, meta_rmse double")
    ids = spark.createDataFrame([(1,), (9,)], "pid long")
    p = series(spark, [1, 9, 1, 9, 1])
    assert predict.b1(p, st).first().answer == "nonseasonal"
    got = {r.pid: (r.answer_numeric, r.parse_error) for r in predict.b2(p, st, ids).collect()}
    assert got == {1: (None, None), 9: (None, "missing_dataset_row")}


def test_two_stage_detector_against_full_regressions():
    t, y = noisy_step()
    x = kernels.base_design(t.astype(float))
    base = kernels.least_squares(x, y)
    got = kernels.two_stage_detector(t.astype(float), y, 0.5, top=40)
    assert got[0]["present"] and got[0]["j"] == 45
    for c in got[:10]:
        full = kernels.least_squares(np.column_stack([x, np.arange(len(y)) >= c["j"]]), y)
        assert abs(full["beta"][-1] - c["mag"]) < 1e-8 and abs(abs(full["beta"][-1]) / full["se"][-1] - c["snr"]) < 1e-6
        assert abs((base["rss"] - full["rss"]) / base["rss"] - c["improve"]) < 1e-9
    assert kernels.two_stage_detector(t[:11].astype(float), y[:11], 0.5)[0]["reason"] == "insufficient_valid"
    assert kernels.one_stage_detector(t.astype(float), y, 0.5)[0]["present"]


def test_baseline_defaults(spark):
    st = spark.createDataFrame([(1, 0.5)], "pid long, static_rmse double")
    a = {r.task_name: r.answer for r in kernels.baseline_answers(kernels.baseline_stats(series(spark, [1, None, 2]), st)).collect()}
    assert a == {"A1_trend_dir": "stable", "A2_trend_v": "0.0", "B1_seasonality_present": "nonseasonal", "B2_seasonality_amp": "none", "C1_step_time": "none", "C2_step_mag": "none"}
    t, y = noisy_step(at=40, size=8)
    b = {r.task_name: r.answer for r in kernels.baseline_answers(kernels.baseline_stats(series(spark, y), st)).collect()}
    assert b["C1_step_time"] == (START + datetime.timedelta(days=480)).strftime("%Y%m%d")


def test_gate_cascade(spark):
    cand = "array<struct<raw_adj_delta_mm:double,snr:double,improve_frac:double,persist_frac:double,delta_bic:double>>"
    strong = {"mag_abs_mm": "5", "snr": "4", "improve": "0.2", "bic": "-9", "persist_frac": "0.9", "persist_flag": "true", "date": "2020.01.05"}
    bare = {k: v for k, v in strong.items() if k not in ("persist_frac", "persist_flag")}
    rows = [("c1", "C1_step_time", None, "none", strong), ("c1b", "C1_step_time", None, "none", bare), ("c2", "C2_step_mag", "none", "4.0", strong), ("far", "C1_step_time", "20200101", "20210101", strong), ("veto", "C2_step_mag", "3", "none", {"mag_abs_mm": "0.1"}), ("fix", "C1_step_time", "2020-01-04", "20200105", strong), ("a", "A1_trend_dir", "up", "down", None)]
    df = spark.createDataFrame(rows, "id string, task_name string, llm_pred string, base_pred string, raw map<string,string>").select("id", "task_name", "llm_pred", "base_pred", gate.best_step(F.coalesce("raw", F.create_map().cast("map<string,string>"))).alias("best"), F.expr(f"cast(array() as {cand})").alias("candidates"))
    c = gate.GateConfig(impute_c1=True, override_c2=True, conflict_days=60, format_fix=True)
    got = {r.id: (r.action, r.final) for r in gate.decide(df, c).collect()}
    assert got == {"c1": ("impute_best", "20200105"), "c1b": ("keep_llm", None), "c2": ("override", "4.0"), "far": ("conflict_force_none", None), "veto": ("force_none", None), "fix": ("format_fix", "20200104"), "a": ("pass_through", "up")}
    off = {r.id: r.action for r in gate.decide(df).collect()}
    assert off["c1"] == "keep_llm" and off["veto"] == "force_none"


def test_perturbations_keep_enough(spark):
    p = series(spark, list(range(12)))
    seen = lambda df: df.where("y is not null").count()
    assert seen(sample.drop_random(p, 0.5)) == 6 and seen(sample.drop_random(p, 0.9)) == 6
    assert seen(sample.drop_stride(p, 2)) == 6 and seen(sample.drop_stride(p, 6)) == 6
    assert seen(sample.drop_block(p, 10_000)) == 12
    assert sample.condition_grid(spark).count() == 28


def test_text_round_trip(spark):
    t, y = noisy_step()
    p = series(spark, y)
    st = spark.createDataFrame([(1, 0.8)], "pid long, static_rmse double")
    prompt = text.prompts(p, st, "C2_step_mag")
    c = text.candidates_of(prompt).orderBy("rank").collect()
    assert len(c) == 5 and c[0].rmse == 0.8 and len(c[0].window) == 16 and len(c[0].anchors) == 12
    assert abs(c[0].delta - round(y[45] - y[44], 3)) < 1e-9 and c[0].right_date == START + datetime.timedelta(days=540)
    assert predict.c2_select(text.candidates_of(prompt), F.col("rmse")).first().answer > 4
    replies = spark.createDataFrame([('{"answer": "none"}',), ('x {"answer": 2} y',), ("",), (None,), ('{"a": 1}',), ("no",), ('z {"a": 1}',)], "r string").select(text.parse_answer(F.col("r")).alias("a"))
    assert [(r.a.answer, r.a.parse_error) for r in replies.collect()] == [("none", None), ("2", None), (None, "empty_response"), (None, "empty_response"), (None, "json_missing_answer_key"), (None, "no_json_object_found"), (None, "salvaged_json_missing_answer_key")]


def test_neighbours_and_components(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(400, 2))
    pts[:30] = pts[0]
    rows = [("q", str(i % 2), i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [("q", "tiny", 1000 + i, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "task_name string, tile string, id long, x double, y double")
    got = {}
    for r in spatial.knn(df, 4, cell_points=8).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    for i in range(400):
        d = sorted(((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2, j) for j in range(i % 2, 400, 2) if j != i)[:4]
        assert [o for _, o in sorted(got[i])] == [j for _, j in d], i
    assert not any(i >= 1000 for i in got)
    chain = spark.createDataFrame([("q", "0", i, float(i), 0.0) for i in range(40)] + [("q", "0", 99, 500.0, 0.0)], "task_name string, tile string, id long, x double, y double")
    near = spatial.close_pairs(chain, spark.createDataFrame([("q", "0", 1.0)], "task_name string, tile string, threshold double"))
    prof = spatial.component_profile(spatial.connected(chain, near)).first()
    assert (prof.n_points, prof.n_components, prof.n_isolated, prof.max_size) == (41, 2, 1, 40)
