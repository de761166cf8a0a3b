"""Answers whose value lies on a tie, or one bit beside it: the queries give what their SQL gives."""

import datetime
import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stratawave import queries as q
from stratawave.functions.coerce import one_decimal
from stratawave.operators import predict


def tables(folder, series):
    """The test tables for series given as pid -> monthly values in thousands; one line a month."""
    lines = []
    for pid, ys in series.items():
        for i, y in enumerate(ys):
            lines.append((pid, datetime.datetime(1992 + i // 12, i % 12 + 1, 15), round(y * 1000, 2)))
    pid, day, price = zip(*lines, strict=True)
    pq.write_table(pa.table({"l_suppkey": pa.array(pid, pa.int64()), "l_shipdate": pa.array(day, pa.timestamp("us")), "l_extendedprice": price}), f"{folder}/lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(list(series), pa.int64()), "s_nationkey": pa.array([0] * len(series), pa.int32())}), f"{folder}/supplier.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array([0], pa.int32()), "n_regionkey": pa.array([0], pa.int32())}), f"{folder}/nation.parquet")


def both(spark, folder, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = q.QUERIES[name](spark, str(folder))
    want = con.execute(q.ORACLES[name])
    order = [[c[0] for c in want.description].index(c) for c in df.columns]
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.fixture(scope="module")
def steps(tmp_path_factory):
    """Series with one jump of 57.65 to 63.95, whose difference in doubles lies below a tie that its tenfold reaches."""
    rng, series, folder = random.Random(5), {}, tmp_path_factory.mktemp("steps")
    while len(series) < 25:
        low = rng.randrange(20000, 40000)
        jump = 57650 + 100 * rng.randrange(64)
        d = (low + jump) / 1000 - low / 1000
        if d * 10 % 1 == 0.5 and Decimal(repr(d)) * 10 % 1 < Decimal("0.5"):
            series[len(series) + 1] = [low / 1000] * 10 + [(low + jump) / 1000] * 12
    tables(folder, series)
    return folder


@pytest.mark.parametrize("name", ["consistency_gate", "decision_gate", "explode_tasks", "gate_with_candidates", "last_wins_dedup", "merge_conditional", "merge_taskwise", "rows_by_id_list", "score_intersection"])
def test_answers_beside_a_tie(spark, steps, name):
    got, want = both(spark, steps, name)
    assert got and got == want


def test_one_decimal_is_what_sql_rounds_to(spark):
    rng = random.Random(1)
    xs = [(rng.randrange(90000) / 1000) - (rng.randrange(1800) * 0.05) for _ in range(4000)] + [0.05, -0.05, 2.4499999999999997, 0.15, -1.35, 0.0, None]
    want = duckdb.execute("select round(x, 1) + 0.0 from (select unnest(?::double[]) as x)", [xs]).fetchall()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", one_decimal(q.F.col("x")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [w[0] for w in want]


@pytest.mark.parametrize("call,low,high", [(predict.b1, 0.025, 0.975), (lambda p, s, **k: predict.b2(p, s, s, **k), 0.05, 0.95)])
def test_p95_sizes_are_those_of_sql_to_the_last_bit(spark, call, low, high):
    rng = random.Random(3)
    rows = [(pid, i, rng.randrange(20000, 60000) / 1000) for pid in range(400) for i in range(rng.randint(1, 90))]
    schema = "pid long, epoch int, y double"
    points = spark.createDataFrame(rows, schema).withColumn("d", q.F.date_add(q.F.lit("1992-01-01").cast("date"), q.F.col("epoch") * 30))
    got = call(points, points.select("pid").distinct().withColumn("meta_rmse", q.F.lit(1.0)), mode="p95").collect()
    ids, _, ys = zip(*rows, strict=True)
    want = duckdb.execute(f"select pid, (quantile_cont(y, {high}) - quantile_cont(y, {low})) / 2 from (select unnest(?::long[]) as pid, unnest(?::double[]) as y) group by 1", [list(ids), list(ys)]).fetchall()
    assert {r["pid"]: r["amp"] for r in got} == dict(want)
