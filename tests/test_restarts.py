"""Streams that are killed and started again end where one run over everything does."""

import json

import pytest
from pyspark.sql import functions as F

from stratawave.operators import sample
from stratawave.streaming import events, incremental

SCHEMA = "id string, v int"


def feed(folder, number, rows):
    (folder / f"{number:03d}.jsonl").write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in rows) + "\n\n")


class Killed(Exception):
    pass


def killed_at(sink, number, when):
    def run(batch, n):
        if n == number and when == "before":
            raise Killed
        sink(batch, n)
        if n == number and when == "after":
            raise Killed

    return run


@pytest.mark.parametrize("when", ["before", "inside", "after"])
@pytest.mark.parametrize("key", [None, "id"])
def test_a_killed_batch_goes_in_once(spark, tmp_path, when, key):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    every = []
    for n in range(5):
        rows = [(f"k{n * 10 + i}", n) for i in range(10)] + ([("k3", 0), (None, n)] if n else [])
        feed(source, n, rows)
        every += rows
    stream = lambda: incremental.json_stream(spark, str(source), SCHEMA, files=1)

    def half(df):  # dies while the third batch is written
        return df.withColumn("v", F.when(F.raise_error(F.lit("killed")).isNull(), F.col("v"))) if incremental.last_batch(spark, out) == 1 else df

    first = killed_at(incremental.batch_sink(out, key), 2, when) if when != "inside" else incremental.batch_sink(out, key, half)
    with pytest.raises(Exception, match="(?i)killed"):
        incremental.append_stream(stream(), out, check, first)
    assert incremental.last_batch(spark, out) == (2 if when == "after" else 1)
    got = incremental.append_stream(stream(), out, check, incremental.batch_sink(out, key))
    want = sorted(every, key=str) if key is None else sorted({i: (i, v) for i, v in reversed(every) if i is not None}.values(), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    feed(source, 9, [("k1", 7), ("new", 9)])
    got = incremental.append_stream(stream(), out, check, incremental.batch_sink(out, key))
    assert got.count() == len(want) + (2 if key is None else 1) and got.where("id = 'new'").count() == 1
    assert incremental.append_stream(stream(), out, check, incremental.batch_sink(out, key)).count() == got.count()


def test_a_sample_kept_as_state_goes_on_after_a_restart(spark, tmp_path):
    ex = spark.range(600).select((F.col("id") % 3).cast("string").alias("bucket_label"), F.concat(F.lit("e"), F.col("id")).alias("id"))
    for n in range(4):
        ex.where(f"int(substr(id, 2)) % 4 = {n}").write.parquet(str(tmp_path / f"part{n}"))
    (tmp_path / "in").mkdir()
    last = {}

    def keep(batch, _):
        for label, rows in batch.groupBy("bucket_label").agg(F.array_sort(F.collect_list(F.struct("h", "id"))).alias("r")).collect():
            last[label] = [tuple(r) for r in rows]

    for n in range(4):  # four runs, each from the checkpoint of the one before; the last one repeats rows
        for k in {n, max(n - 1, 0)}:
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                (tmp_path / "in" / f"{n}-{k}-{f.name}").write_bytes(f.read_bytes())
        s = spark.readStream.schema(ex.schema).parquet(str(tmp_path / "in"))
        events.streaming_sample(s, 7).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = sample.balanced(ex.withColumn("task_name", F.lit("t")), 7, seed=0)
    h = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")
    own = {}
    for r in ex.select("bucket_label", h.alias("h"), "id").collect():
        own.setdefault(r[0], []).append((r[1], r[2]))
    assert last == {b: sorted(r)[:7] for b, r in own.items()}
    assert want.count() == sum(map(len, last.values()))


def test_places_of_a_shuffled_list(spark):
    rows = spark.range(1000).select(F.concat(F.lit("i"), F.col("id")).alias("id"))
    got = sample.shuffled(rows, seed=4).collect()
    head = sample.shuffled_head(rows, 1000, seed=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, head)) and len(got) == 1000
    assert sample.shuffled(rows.limit(0)).count() == 0


def test_tables_between_steps_go_with_their_scope(spark, tmp_path, monkeypatch):
    from stratawave import queries as q
    from stratawave.sources import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path / "shared"))
    with scratch.scope(spark):
        got = q.QUERIES["knn_neighbours"](spark, "/root/testdata/sf0.001").count()
        assert len(list((tmp_path / "shared").iterdir())) > 0
    assert got > 0 and list((tmp_path / "shared").iterdir()) == []
    with pytest.raises(ValueError), scratch.scope(spark):
        scratch.stored(spark.range(3), "x")
        raise ValueError
    assert list((tmp_path / "shared").iterdir()) == []
    assert scratch.stored(spark.range(3), "x").count() == 3 and len(list((tmp_path / "shared").iterdir())) == 1  # without a scope they stay


def test_a_class_is_ordered_only_as_far_as_it_is_wanted(spark):
    rows = spark.range(20_000).select(F.lit("t").alias("task_name"), F.when(F.col("id") % 50 == 0, "few").otherwise("many").alias("bucket_label"), F.concat(F.lit("i"), F.col("id")).alias("id"))
    targets = spark.createDataFrame([("t", "few", 30), ("t", "many", 100)], "task_name string, bucket_label string, target int")
    got = sorted((r.bucket_label, r.id) for r in sample.stratified(rows, targets, seed=3).collect())
    h = sample.hash32(F.lit(3), F.col("id")).alias("h")
    own = {}
    for r in rows.select("bucket_label", h, "id").collect():
        own.setdefault(r.bucket_label, []).append((r.h, r.id))
    assert got == sorted([("few", i) for _, i in sorted(own["few"])[:30]] + [("many", i) for _, i in sorted(own["many"])[:100]])
    ranked = sample.stratified(rows, targets, seed=3)._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.index("row_number") < ranked.index("_last")  # plans are printed from the top: rows are bounded below the ranking
    with pytest.raises(ValueError):
        sample.stratified(rows, targets.withColumn("target", F.lit(500)), seed=3)
