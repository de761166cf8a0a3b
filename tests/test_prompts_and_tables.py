"""Prompt modes and guidance, repair texts, result tables, one-object summaries, quotas that cannot be met."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stratawave import queries as q
from stratawave.operators import kernels, label, sample, slices, text
from stratawave.sources import files, testbed

SF = "/root/testdata/sf0.001"


def test_prompts_show_what_their_mode_asks_for(spark):
    day = lambda e: dt.date(2020, 1, 1) + dt.timedelta(12 * e)
    rows = [("t", 1, day(e), e, 30, None if e == 28 else float(e) + (10 if e >= 20 else 0)) for e in range(30)]
    points = spark.createDataFrame(rows, "tile string, pid int, d date, epoch int, total int, y double")
    statics = spark.createDataFrame([(1, 1.25)], "pid int, static_rmse double")
    got = {}
    for task in label.TASKS:
        for mode in ("summary", "first", "last"):
            (r,) = text.prompts(points, statics, task, mode=mode, first=4, last=3).collect()
            parts = r.prompt.split("\n\n")
            assert r.task_name == task and parts[-1] == f"Answer as JSON with the key answer: {text.ALLOWED[task]}."
            assert (parts[0] == text.GUIDANCE.get(task)) == (task in text.GUIDANCE) and ("Step candidates:" in r.prompt) == (task in text.GUIDANCE)
            assert "rmse_mm=1.250" in parts
            got[mode] = next(p for p in parts if p.startswith(("Summary:", "First", "Last")))
    assert got["summary"].startswith("Summary: coverage=29/30; min=0.000; max=39.000;")
    assert got["first"] == "First points:\ndate,disp_mm\n2020-01-01,0.000\n2020-01-13,1.000\n2020-01-25,2.000\n2020-02-06,3.000"
    assert got["last"] == f"Last points:\ndate,disp_mm\n{day(27)},37.000\n{day(28)},NA\n{day(29)},39.000"
    c1, c2 = (text.GUIDANCE[t] for t in ("C1_step_time", "C2_step_mag"))
    assert "none" in c1 and "step_date_candidate" in c1 and "est_step_mag_abs_mm" in c2 and "positive" in c2
    with pytest.raises(ValueError):
        text.observations(points, "other")


def test_rendered_prompts_read_back(spark):
    """The registered prompts: one per task and series, and their summary and candidates are those of the operators."""
    p = testbed.gappy_points(spark, SF)
    got = q.QUERIES["render_prompts"](spark, SF)
    n = p.select("pid").distinct().count()
    assert {r.task_name: r["count"] for r in got.groupBy("task_name").count().collect()} == dict.fromkeys(label.TASKS, n)
    lines = {r.pid: r.line for r in text.summary_block(p).collect()}
    blocks = {r.pid: r.block for r in text.candidate_lines(text.step_candidates(p, 5)).collect()}
    for r in got.collect():
        assert f"Summary: {lines[r.pid]}" in r.prompt
        assert (f"Step candidates:\n{blocks[r.pid]}" in r.prompt) == r.task_name.startswith("C")


def test_repair_texts(spark):
    rows = spark.createDataFrame([(t,) for t in (*label.TASKS, "other")], "t string").select("t", text.repair_suffix(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.s.startswith(text.REPAIR) and r.s.endswith(f"{text.ALLOWED.get(r.t, 'any JSON value')}.\n")


def test_tables_of_methods(spark, tmp_path):
    methods = {"base": ["ALL_base"], "full": ["new", "old"], "none": ["missing"]}
    for model, variant, micro, macro, accs in (("m1", "ALL_base", 0.5, 0.4, {"A": 0.25, "B": 0.5}), ("m1", "new", 0.7, 0.6, {"A": 1.0}), ("m1", "old", 0.1, 0.1, {}), ("m2", "ALL_base", 0.3, 0.2, {"A": 0.75}), ("m2", "old", 0.9, 0.8, {"B": 0.5})):
        folder = tmp_path / model / variant
        folder.mkdir(parents=True)
        (folder / "summary.json").write_text(json.dumps({"micro_acc": micro, "macro_acc_over_tasks": macro}))
        (folder / "by_task.csv").write_text("task_name,acc\n" + "".join(f"{t},{a}\n" for t, a in accs.items()))
        (folder / "by_task_bucket.csv").write_text("task_name,bucket_label,acc\n")
    summary, by_task, _ = files.read_score_tree(spark, str(tmp_path))
    rows = slices.method_rows(summary, by_task, ["A", "B"], methods)
    assert sorted(map(tuple, rows.collect()), key=str) == [("m1", "base", "ALL_base", 0.4, 0.5, 0.25, 0.5), ("m1", "full", "new", 0.6, 0.7, 1.0, None), ("m2", "base", "ALL_base", 0.2, 0.3, 0.75, None), ("m2", "full", "old", 0.8, 0.9, None, 0.5)]
    means = slices.method_averages(rows, ["A", "B"])
    got = {r.method: (r.n_models, r.macro, r.micro, r.A, r.B) for r in means.collect()}
    assert got == {"base": (2, pytest.approx(0.3), pytest.approx(0.4), 0.5, 0.5), "full": (2, pytest.approx(0.7), pytest.approx(0.8), 1.0, 0.5)}
    table = files.method_table(means, "Means", "method", ["full", "base"])
    assert table.index("full & 70.0 & 80.0 & 100.0 & 50.0") < table.index("base & 30.0 & 40.0 & 50.0 & 50.0")
    assert "m2 & 75.0 & --" in files.method_table(rows.where("method = 'base'").select("model", "A", "B"), "x", "model", ["m1", "m2"])


def test_tables_of_intervals(spark):
    paired = spark.createDataFrame([("A1", i, int(i % 4 != 0), int(i % 2 == 0)) for i in range(200)], "task_name string, id long, a int, b int")
    rows = slices.intervals({"rules": paired, "full_gate": paired}, 50)
    one = {r.metric: r for r in slices.bootstrap(paired, 50).collect()}
    assert {(r.name, r.metric): (r.mean, r.low, r.high) for r in rows.collect()} == {(n, m): (r.mean, r.low, r.high) for n in ("rules", "full_gate") for m, r in one.items()}
    m = one["macro"]
    assert rf"full\_gate & {m.mean * 100:.2f} [{m.low * 100:.2f}, {m.high * 100:.2f}]" in files.interval_table(rows, "c")


def test_summaries_are_one_object(spark, tmp_path):
    path = str(tmp_path / "out" / "summary.json")
    files.write_summary(spark.createDataFrame([(0.5, 3, None)], "micro_acc double, n long, s string"), path, scorer_version="v", mode="all")
    assert json.loads(open(path).read()) == {"scorer_version": "v", "mode": "all", "micro_acc": 0.5, "n": 3, "s": None}
    with pytest.raises(ValueError):
        files.write_summary(spark.range(2), path)


def test_quotas_above_what_there_is(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 2)], "tile string, n long")
    assert {r.tile: r.quota for r in sample.largest_remainder(counts, 7).collect()} == {"a": 5, "b": 2}
    with pytest.raises(Exception, match="8 wanted of 7"):
        sample.largest_remainder(counts, 8).collect()
    with pytest.raises(ValueError):
        sample.largest_remainder(counts, 0)


def test_nulls_as_they_come_back_from_csv_files(spark):
    rows = spark.createDataFrame([(t, None) for t in label.TASKS], "t string, p string")
    of = lambda flag: {r[0]: r[1] for r in rows.select("t", slices.predicted_bucket(F.col("t"), F.col("p"), flag)).collect()}
    plain, nan = of(False), of(True)
    assert (plain["B2_seasonality_amp"], plain["C1_step_time"], plain["C2_step_mag"]) == ("nonseasonal", "no_step", "no_step")
    assert (nan["B2_seasonality_amp"], nan["C1_step_time"], nan["C2_step_mag"]) == ("unknown", "step", "unknown")


def test_the_first_example_of_a_series_serves_all_its_tasks(spark):
    day = lambda e: dt.date(2020, 1, 1) + dt.timedelta(12 * e)
    part = lambda a, b, gap=(): [(day(e), None if e in gap else float(e)) for e in range(a, b)]
    rows = [(1, 5, part(0, 9)), (1, 3, part(10, 20)), (1, 4, part(0, 30)), (2, 0, part(0, 8, {1, 2, 3})), (2, 7, part(5, 12)), (2, 8, part(0, 12)), (3, 1, part(0, 3)), (3, 2, part(1, 5))]
    examples = spark.createDataFrame(rows, "pid int, _seq long, slice array<struct<d: date, y: double>>")
    points = kernels.series_of_examples(examples)
    got = {}
    for r in points.orderBy("pid", "epoch").collect():
        got.setdefault(r.pid, []).append((r.d, r.y))
    assert got == {1: part(10, 20), 2: part(5, 12), 3: part(0, 3)}
    stats = kernels.baseline_stats(points, spark.createDataFrame([(1, 0.5)], "pid int, static_rmse double"))
    assert {r.pid: r.ok for r in stats.collect()} == {1: True, 2: True, 3: False}
