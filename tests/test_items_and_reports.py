"""Item scores, score trees, frozen id lists, shuffled samples, metadata, neighbour flags and boundary scans against brute force."""

import json
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratawave.operators import predict, sample, slices, spatial
from stratawave.sources import files


def test_score_tree_and_item_scores(spark, tmp_path):
    def put(place, text):
        f = tmp_path / place
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("m1/ALL_base/summary.json", json.dumps({"micro_acc": 0.5, "macro_acc_over_tasks": None, "mode": "all"}, indent=1))
    put("m1/ALL_base/by_task.csv", "task_name,n,acc\nA1,3,0.25\nA2,3,\n,3,0.5\n")
    put("m1/ALL_base/by_task_bucket.csv", "task_name,bucket_label,n,acc\nA1,stable,3,1\nA1,,3,1\n")
    put("m2/ALL_base/by_task.csv", "task_name,n,acc\nA1,3,0.75\n")  # no summary: not there
    summary, by_task, by_bucket = (sorted(map(tuple, x.collect())) for x in files.read_score_tree(spark, str(tmp_path)))
    assert summary == [("m1", "ALL_base", 0.5, None)]
    assert by_task == [("m1", "ALL_base", "A1", 0.25)] and by_bucket == [("m1", "ALL_base", "A1", "stable", 1.0)]
    put("items.csv", "id,task_name,correct\na,A1,1.0\nb,A1,0\nc,A2,\n")
    assert sorted(map(tuple, files.read_item_scores(spark, str(tmp_path / "items.csv")).collect())) == [("A1", "a", 1), ("A1", "b", 0), ("A2", "c", None)]


def test_report_helpers(spark, monkeypatch):
    assert [files.percent(x) for x in (None, 0.1234)] == ["--", "12.3"]
    assert [files.percent_change(*x) for x in ((None, 1), (0.5, 0.25), (0.25, 0.5))] == ["--", "+25.0", "-25.0"]
    monkeypatch.setattr(files, "REPORT_ROWS", 3)
    assert files.small(spark.range(3)).count() == 3
    with pytest.raises(ValueError):
        files.latex_table(spark.range(4), "x")


def test_id_lists(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "id string, text string, _seq int")
    ids = lambda *x: spark.createDataFrame([(v, i) for i, v in enumerate(x)], "id string, place long")
    assert sorted(map(tuple, sample.by_id_list(rows, ids("b", "a")).collect())) == [("a", 1, "y"), ("b", 0, "z")]
    for bad in (ids("a", "c"), ids("a", "b", "a")):
        with pytest.raises(PySparkException, match="listed"):
            sample.by_id_list(rows, bad).collect()
    assert sample.by_id_list(rows, ids("a").limit(0)).count() == 0


def test_shuffled_head(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"))
    a, b, c = ([r.id for r in sorted(sample.shuffled_head(rows, 10, seed).collect(), key=lambda r: r.place)] for seed in (1, 1, 2))
    assert a == b != c and len(set(a)) == 10 and a != sorted(a)


def test_common_ids_and_model_averages(spark):
    own = lambda *x: spark.createDataFrame(list(x), "task_name string, id string, ok int")
    j = slices.common_ids(own(("A", "1", 1), ("A", "2", 0), ("B", "1", 1)), own(("A", "1", 0), ("B", "1", 0)), own(("A", "1", 1), ("B", "2", 0)))
    assert [tuple(r) for r in j.collect()] == [("A", "1", 1, 0, 1)]
    m = spark.createDataFrame([("m1", "x", 1.0), ("m2", "x", None), ("m3", "x", float("nan")), ("m1", "y", None)], "model string, system string, micro double")
    assert sorted(map(tuple, slices.average_models(m, ["system"], ["micro"]).collect())) == [("x", 3, 1.0), ("y", 1, None)]


def test_neighbour_flags_against_brute_force(spark):
    pts = [("T", "t", i, float(i % 7), float(i // 7), "abc"[(i * i) % 3], "abc"[(i * 5 + i // 4) % 3]) for i in range(60)]
    points = spark.createDataFrame(pts, "task_name string, tile string, id long, x double, y double, gold string, pred string")
    got = {r.id: r for r in spatial.agreement(points, spatial.knn(points, 5, cell_points=4)).collect()}
    mode = lambda x: min((-x.count(v), v) for v in x)[1]
    for _, _, i, x, y, gold, pred in pts:
        near = sorted(((x - p[3]) ** 2 + (y - p[4]) ** 2, p[2]) for p in pts if p[2] != i)[:5]
        golds, preds = [pts[j][5] for _, j in near], [pts[j][6] for _, j in near]
        mg, mp = mode(golds), mode(preds)
        want = (golds.count(gold) / 5, preds.count(pred) / 5, 1 - preds.count(pred) / 5, int(gold == mg and pred != mg), int(gold != mg and pred == mg), int(pred != mp))
        r = got[i]
        assert (r.gold_agreement, r.pred_agreement, r.inconsistency, r.anomaly, r.oversmooth, r.pred_majority_disagree) == pytest.approx(want), i


def test_boundary_scan_against_brute_force(spark):
    series = {1: [1.0, 2.0, 1.0, None, 9.0, 8.0, 9.5, 9.0], 2: [3.0, 3.0], 3: [float(i * i % 11) for i in range(20)], 4: []}
    rows = [(p, k, y) for p, ys in series.items() for k, y in enumerate(ys)]
    points = spark.createDataFrame(rows, "pid long, epoch long, y double").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("epoch") * 10).cast("int")))
    for strict in (False, True):
        got = {(r.pid, r.i): r for r in predict.split_scan(points, 2, 3, 15, strict).collect()}
        want = {}
        for p, ys in series.items():
            own = [(k, y) for k, y in enumerate(ys) if y is not None]
            for i in range(2, len(own) - 2):
                if (own[i][0] - own[i - 1][0]) * 10 <= 15:
                    pre, post = statistics.median(y for _, y in own[:i]), statistics.median(y for _, y in own[i:])
                    near = [abs(y - post) < abs(y - pre) if strict else abs(y - post) <= abs(y - pre) for _, y in own[i:]]
                    want[p, i] = (pre, post, post - pre, abs(own[i][1] - own[i - 1][1]), sum(near) / len(near))
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert (r.pre_med, r.post_med, r.mag, r.edge, r.persist) == pytest.approx(want[k]), k


def test_conditions_are_the_single_perturbations(spark):
    rows = [(p, k, float((p * k) % 13) if (p + k) % 5 else None) for p in range(6) for k in range(40)]
    points = spark.createDataFrame(rows, "pid long, epoch long, y double").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("epoch") * 9).cast("int")))
    every = sample.all_conditions(points)
    key = lambda df: sorted(map(repr, df.select("pid", "epoch", "y").collect()))
    for name, df in (("clean", points), ("missing_0.3_2", sample.drop_random(points, 0.3, 2)), ("stride_4_1", sample.drop_stride(points, 4, 1)), ("block_180_0", sample.drop_block(points, 180, 0))):
        assert key(every.where(F.col("condition_id") == name)) == key(df), name
    assert every.select("condition_id").distinct().count() == 28 and every.count() == 28 * len(rows)
