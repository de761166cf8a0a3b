from fractions import Fraction

from pyspark.sql import functions as F

from stratawave.functions import coerce
from stratawave.operators import merge, score


def test_decimal_tolerance(spark):
    cases = [("7.3", "7.1", "0.2", True), ("-2.0", "-2.2", "0.2", True), ("0.3", "0.1", "0.2", True), ("-0.3", "-0.1", "0.2", True), ("7.300000000000001", "7.1", "0.2", False), ("nan", "7.1", "0.2", False), ("inf", "7.1", "0.2", False), ("7.1", "7.1", "-0.1", False), (None, "1", "1", False), ("1e-05", "0", "0.00001", True)]
    df = spark.createDataFrame(cases, "p string, g string, t string, want boolean")
    assert df.where(coerce.within_tolerance(F.col("p"), F.col("g"), F.col("t")) != F.col("want")).count() == 0
    i = spark.range(-100, 101).select(F.col("id").alias("i"))
    j = spark.createDataFrame([(x,) for x in (-6, -5, -2, -1, 0, 1, 2, 5, 6)], "j int")
    t = spark.createDataFrame([("0.2",), ("0.5",)], "t string")
    grid = i.crossJoin(j).crossJoin(t).select("i", "j", "t", coerce.within_tolerance(((F.col("i") + F.col("j")) / 10).cast("string"), (F.col("i") / 10).cast("string"), F.col("t")).alias("ok")).collect()
    assert len(grid) == 201 * 9 * 2
    assert all(r.ok == (abs(Fraction(r.j, 10)) <= Fraction(r.t)) for r in grid)


GOLD = "id string, task_name string, bucket_label string, answer string, answer_numeric double, metric string, tolerance double, t_iso array<string>"


def test_none_time_and_parse_semantics(spark):
    grid = ["20200101", "2020-01-13", "20200125"]
    gold = spark.createDataFrame([
        ("a", "B2", "n", "none", None, "num_or_none_within_tol", 0.5, None), ("b", "B2", "n", "none", None, "num_or_none_within_tol", 0.5, None), ("c", "B2", "n", "none", None, "num_or_none_within_tol", 0.5, None),
        ("d", "C1", "s", "20200113", None, "time_or_none_within_k", 1.0, grid), ("e", "C1", "s", "20200101", None, "time_or_none_within_k", 1.0, grid), ("f", "C1", "s", "20200101", None, "time_or_none_within_k", 1.0, grid[::-1]),
        ("g", "A1", "s", "Stable", None, "class_exact", None, None), ("h", "X", "s", "1", None, "other", None, None), ("i", "B2", "n", "3.0", None, "num_or_none_within_tol", 0.5, None), ("j", "A1", "s", "none", None, "class_exact", None, None),
    ], GOLD)
    pred = spark.createDataFrame([("a", "none", None), ("b", "1", None), ("c", None, "bad"), ("d", "20200119", None), ("e", "2020-03-01", None), ("f", "20200101", None), ("g", " stable ", None), ("h", "1", None), ("i", None, None), ("j", None, None)], "id string, answer_parsed string, parse_error string")
    got = {r.id: (r.ok, r.reason) for r in score.score(gold, pred).collect()}
    assert got == {"a": (1, "ok"), "b": (0, "expected_none"), "c": (0, "parse:bad"), "d": (1, "ok"), "e": (0, "time_outside_tol(index_tol=1)"), "f": (0, "invalid_acquisition_grid"), "g": (1, "ok"), "h": (0, "unknown_metric:other"), "i": (1, "ok"), "j": (1, "ok")}
    some = score.score(gold, pred.where("id = 'a'"), "all")
    assert some.where("parse_error = 'missing_pred'").count() == 9
    s = score.summary(some, gold, pred.where("id = 'a'")).first()
    assert (s.n_gold, s.n_pred, s.n_scored) == (10, 1, 10) and s.coverage_pred_over_gold == 0.1


def test_nearest_date_ties_go_to_the_earlier(spark):
    x = spark.range(1).select(score.acquisition_index(F.lit("20200101"), F.lit("20200107"), F.array(*map(F.lit, ["20200101", "20200113"]))).alias("i")).first().i
    assert (x.pred_index, x.pred_exact, x.pred_outside) == (0, False, False)


PRED = "id string, task_name string, answer_parsed string, parse_error string, _seq int"


def test_merges_and_gate(spark):
    main = spark.createDataFrame([("s_1_B1_seasonality_present", "B1_seasonality_present", "seasonal", None, 0), ("s_1_B1_seasonality_present", "B1_seasonality_present", "Nonseasonal", None, 1), ("s_1_B2_seasonality_amp", "B2_seasonality_amp", "2.0", None, 2), ("s_1_C1_step_time", "C1_step_time", "", None, 3), ("s_1_C2_step_mag", "C2_step_mag", "3.0", "False", 4)], PRED)
    none = main.limit(0)
    same = merge.merge_tasks(main, none, ["B1_seasonality_present"])
    assert {(r.id, r.answer_parsed) for r in same.collect()} == {(r.id, r.answer_parsed) for r in score.last_wins(main, "id").collect()}
    gated = merge.consistency_gate(main)
    got = {(r.task_name, r._seq): (r.answer_parsed, r.gate_applied) for r in gated.collect()}
    assert got["B2_seasonality_amp", 2] == ("none", "B1->B2") and got["C2_step_mag", 4] == ("3.0", None)
    again = merge.consistency_gate(gated.drop("gate_applied"))
    assert {(r.id, r._seq, r.answer_parsed) for r in again.collect()} == {(r.id, r._seq, r.answer_parsed) for r in gated.collect()}
    alt = spark.createDataFrame([("new", "C1_step_time", "none", None, 0)], PRED)
    added = {r.id: r.src for r in merge.merge_tasks(main, alt, ["B1_seasonality_present"]).collect()}
    assert added["new"] == "main"


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" -2e3 ",), ("1_000",), ("1d",), ("inf",), ("None",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(coerce.safe_double(F.col("x"))).collect()] == [1.5, -2000.0, None, None, None, None, None, None]
    assert df.select(coerce.scored_double(F.col("x"))).collect()[4][0] == float("inf")
    assert spark.range(1).select(coerce.millimetres(F.lit("1,234.5 mm"))).first()[0] == 1234.5
    b = spark.createDataFrame([("Yes",), ("t",), ("0",), (None,)], "x string").select(coerce.strict_bool(F.col("x"))).collect()
    assert [r[0] for r in b] == [True, None, False, None]
    d = spark.createDataFrame([("20200230",), ("2020-02-29",), ("2020/02/29",), ("2020.02.29",), ("2020-02-29T00:00",)], "x string")
    assert [str(r[0]) for r in d.select(coerce.parse_date(F.col("x"))).collect()] == ["None", "2020-02-29", "2020-02-29", "2020-02-29", "2020-02-29"]
    assert [r[0] for r in spark.createDataFrame([("t_5_A1", "A1"), ("plain", "A1")], "i string, t string").select(coerce.base_key(F.col("i"), F.col("t"))).collect()] == ["t_5", "plain"]
