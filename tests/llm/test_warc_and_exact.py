import hashlib

from pyspark.sql import functions as F

from stratawave.llm import exact_dedup, warc
from stratawave.llm.common import scratch

DELIM = warc.DELIMITER


def test_exact_dedup_edges(spark):
    rows = [(1, "a", 9), (2, "a", 9), (3, None, 9), (4, "", 9), (5, "b", 9), (5, "b", 9), (None, "a", 9), (6, "x" * 300_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    got = sorted(exact_dedup.exact_dedup(docs, "largest").collect())
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, True), (6, 6, 1, True)]
    assert got[0].text_sha256 == hashlib.sha256(b"a").hexdigest()
    small = exact_dedup.exact_dedup(docs, "smallest").where("kept").select("doc_id").distinct().collect()
    assert sorted(r.doc_id for r in small) == [1, 3, 5, 6]
    assert sorted(r.doc_id for r in exact_dedup.dedup_documents(docs).collect()) == [1, 3, 5, 6]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_many_runs(spark):
    docs = spark.range(0, 4000, 1, 37).select(F.col("id").alias("doc_id"), (F.col("id") % 50).cast("string").alias("text"))
    got = exact_dedup.exact_dedup(docs, "largest", n_runs=300)
    assert got.where("kept").count() == 50
    assert got.where("keep_id <> 3950 + doc_id % 50 or group_size <> 80").count() == 0


def test_exact_dedup_sorts_and_merges_runs(spark):
    docs = spark.range(0, 100, 1, 7).select(F.col("id").alias("doc_id"), (F.col("id") % 5).cast("string").alias("text"))
    merged = exact_dedup.merge_runs(exact_dedup.digest_rows(docs), "smallest", n_runs=200)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Two rounds and the last meeting: each sorts before its exchange and after it, and no node aggregates by hash or in Python.
    assert plan.count("SortAggregate") >= 5 and plan.count("Sort [") >= 5 and "HashAggregate" not in plan and "Python" not in plan and "Arrow" not in plan


def test_warc_round_trip(spark):
    long = "é" * 5000 + DELIM + "x" * 300 + DELIM + DELIM + "y" * 4097
    rows = [(1, "http://a/\r\nb", "p" * 200), (2, None, "p" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "http://c/é", long), (8, "u", long), (9, "u", "WARC/1.1\r\n" + "z" * 200), (10, "u", DELIM * 60 + "\r\n\r\n"), (None, "u", "gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    for size in (1000, 4096, 1 << 20):
        path = scratch(spark, "test-warc")
        warc.write_warc(pages, path, chunk_bytes=size, records_per_file=3)
        got = {r.page_id: r for r in warc.read_payloads(spark, path).collect()}
        assert sorted(got) == list(range(1, 11))
        for i, _, html in rows[:-1]:
            raw = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].verified) == (len(raw), hashlib.sha256(raw).hexdigest(), True), (i, size)
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, 8: 7}


def test_warc_empty(spark):
    path = scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_payloads(spark, path).count() == 0


def test_warc_version_at_the_end_of_a_payload_or_chunk(spark):
    texts = ["x" * 20 + DELIM[:-2], DELIM[4:-2], "y" * 18 + DELIM[:-2] + "tail" * 9, DELIM[:-2]]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    for size in (30, 1000):
        path = scratch(spark, "test-warc")
        warc.write_warc(pages, path, chunk_bytes=size)
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.verified) for r in warc.read_payloads(spark, path).collect()}
        assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest(), True) for i, t in enumerate(texts)}


def test_warc_repeated_pages(spark):
    long = "q" * 5000
    rows = [(1, "b", "x" * 150), (1, "a", "x" * 150), (2, "u", "x" * 150), (3, "u", "y" * 150), (3, "u", long), (4, "u", long), (4, "u", long), (5, None, None), (5, None, "")]
    path = scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, chunk_bytes=1000)
    got = {r.page_id: r for r in warc.read_payloads(spark, path).collect()}
    assert warc.read_payloads(spark, path).count() == 5 and sorted(got) == [1, 2, 3, 4, 5]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {i: min(digest(t) for j, _, t in rows if j == i) for i in got}
    assert {i: r.payload_digest for i, r in got.items()} == want and all(r.verified for r in got.values())
    refers = {i: min(j for j in got if want[j] == want[i]) for i in got}
    assert {i: r.refers_to for i, r in got.items()} == {i: j if j < i and i != 5 else None for i, j in refers.items()}
