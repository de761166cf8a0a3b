import gzip

import pytest
from pyspark.sql import functions as F

from stratawave.sources import files
from stratawave.streaming import events


def test_wide_csv(spark, tmp_path):
    (tmp_path / "tile_E10N20.csv").write_text("pid,easting,northing,rmse,20200101,20200113,20200125\na,1,2,0.5,1.0,,inf\nb,,,,2,3,4\n")
    (tmp_path / "other.txt").write_text("no")
    rows = sorted(files.read_wide_csv(spark, str(tmp_path), "*.csv").collect(), key=lambda r: (r.pid, r.epoch))
    assert [(r.tile, r.pid, r.epoch, r.y, r.rmse_mm, r.easting) for r in rows] == [("E10N20", "a", 0, 1.0, 0.5, 1), ("E10N20", "a", 1, None, 0.5, 1), ("E10N20", "a", 2, None, 0.5, 1), ("E10N20", "b", 0, 2.0, 0.0, None), ("E10N20", "b", 1, 3.0, 0.0, None), ("E10N20", "b", 2, 4.0, 0.0, None)]


def test_wide_files_follow_their_own_headers(spark, tmp_path):
    (tmp_path / "E1N1 a.csv").write_text("pid,rmse,rmse_mm,20200101,20200113,20200125\np,9,0.5,1,2,3\nshort,9,,4\n")
    (tmp_path / "E2N2.csv").write_text("20210110,20210101,note,northing,20210122,pid,20210203,20210110\n5,6,x,7.9,8,\"q,1\",nan,99\n")
    (tmp_path / "plain.csv").write_text("\ufeffpid,20220101,20220102,20220103,20220104,mean_velocity_std\nr,1e1,-2,,4,0.25\n", encoding="utf-8")
    with gzip.open(tmp_path / "E3N3.csv.gz", "wt") as f:
        f.write("pid,20200101,20200113,20200125\nz,1,2,3\n")
    want = [
        ("E1N1", "p", None, 0.5, 0.0, 3, [("2020-01-01", 0, 1.0), ("2020-01-13", 1, 2.0), ("2020-01-25", 2, 3.0)]),
        ("E1N1", "short", None, 0.0, 0.0, 3, [("2020-01-01", 0, 4.0), ("2020-01-13", 1, None), ("2020-01-25", 2, None)]),
        ("E2N2", "q,1", 7, 0.0, 0.0, 4, [("2021-01-10", 0, 5.0), ("2021-01-01", 1, 6.0), ("2021-01-22", 2, 8.0), ("2021-02-03", 3, None)]),
        ("E3N3", "z", None, 0.0, 0.0, 3, [("2020-01-01", 0, 1.0), ("2020-01-13", 1, 2.0), ("2020-01-25", 2, 3.0)]),
        ("plain.csv", "r", None, 0.0, 0.25, 4, [("2022-01-01", 0, 10.0), ("2022-01-02", 1, -2.0), ("2022-01-03", 2, None), ("2022-01-04", 3, 4.0)]),
    ]
    for limit in (files.HEADER_BYTES, 0):
        rows = files.read_wide_csv(spark, str(tmp_path), "*.csv*", limit)
        got = rows.groupBy("tile", "pid", "northing", "rmse_mm", "mean_velocity_std", "total").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("d").cast("string").alias("d"), "y"))).alias("v")).orderBy("tile", "pid").collect()
        assert [(*r[:6], [(v.d, v.epoch, v.y) for v in r.v]) for r in got] == want
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan csv") == 1 and ("BroadcastHashJoin" in plan) == bool(limit)


def test_many_headers_make_one_scan_and_bad_files_raise(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"E{i}N0.csv").write_text("pid," + ",".join(f"2020{1 + i % 12:02d}{d:02d}" for d in range(1, 4 + i % 5)) + f"\ns{i}," + ",".join(str(d) for d in range(3 + i % 5)) + "\n")
    rows = files.read_wide_csv(spark, str(tmp_path), "*.csv")
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert rows.where("d <> make_date(2020, 1 + int(substr(pid, 2)) % 12, epoch + 1) or y <> epoch or total <> 3 + int(substr(pid, 2)) % 5").count() == 0
    assert rows.count() == sum(3 + i % 5 for i in range(300))
    for name, text in (("a", "x,20200101,20200102,20200103\n"), ("b", "pid,x\n"), ("c", "pid,20200101,20200102\n"), ("d", "")):
        (tmp_path / f"{name}.bad").write_text(text)
        with pytest.raises(ValueError):
            files.read_wide_csv(spark, str(tmp_path), f"{name}.bad")
    with pytest.raises(ValueError):
        files.read_wide_csv(spark, str(tmp_path), "*.none")


def test_json_lines_ids_and_resume(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('﻿{"rid": "1", "task": "A", "pred": 3, "use_alt": true}\n\n{"id": "2", "taskName": "B", "answer_parsed": null, "answer": "x"}\n', encoding="utf-8")
    got = {r.id: (r.task_name, r.answer_parsed, r.use_alt) for r in files.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got == {"1": ("A", "3", True), "2": ("B", "x", None)}
    (tmp_path / "ids.jsonl").write_text('"a"\n{"qid": "b"}\n\nc\na\n')
    (tmp_path / "ids.json").write_text('{"restrict_ids": ["d", "e"]}')
    ids = lambda x: sorted(r.id for r in files.ids_of(spark, x).collect())
    assert ids(str(tmp_path / "ids.jsonl")) == ["a", "b", "c"] and ids(str(tmp_path / "ids.json")) == ["d", "e"] and ids("x, y,,x") == ["x", "y"]
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("1", 1), ("2", 2)], "id string, v int")
    assert files.append_missing(rows, out) == 2
    more = rows.unionByName(spark.createDataFrame([("3", 3)], "id string, v int"))
    assert files.append_missing(more, out) == 1
    assert spark.read.json(out).count() == 3
    pool = spark.createDataFrame([('{"dataset": {"question": "q"}}',), ('{"id": 1}',)], "value string")
    assert [r.value for r in files.unwrap_pool(pool).collect()] == ['{"question":"q"}', '{"id": 1}']


def test_stage_and_table(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.ensure_stage(make, str(tmp_path / "s"), spark).count() == 3
    assert len(calls) == 1
    assert r"a\_b" in files.latex_table(spark.createDataFrame([("a_b", 0.5)], "x string, y double"), "c")
    assert files.system_paths(["a=b"]) == {"a": "b"}
    assert "z" in files.require(spark.range(1), ["id"], ["z"]).columns


def test_streams_match_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    batch = events.windowed_means(e).agg(F.count("*"), F.sum("n")).first()
    out = events.run_to_end(events.windowed_means(events.read_stream(spark, str(tmp_path / "in"), e.schema)), "w", "append")
    assert 0 < out.count() <= batch[0]
    ex = e.select(F.col("event_type").alias("bucket_label"), F.col("event_id").cast("string").alias("id"))
    ex.write.parquet(str(tmp_path / "ex"))
    got = events.run_to_end(events.streaming_sample(events.read_stream(spark, str(tmp_path / "ex"), ex.schema), 3), "s", "update")
    want = {}
    for r in ex.select("bucket_label", F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long").alias("h"), "id").collect():
        want.setdefault(r.bucket_label, []).append((r.h, r.id))
    for b, own in want.items():
        assert sorted(own)[:3] == sorted((r.h, r.id) for r in got.collect() if r.bucket_label == b)[:3]
