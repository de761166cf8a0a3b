import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from test_models_and_packing import check_packed, library
from test_near_dedup import brute

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.cut(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            toxic = {r.doc_id for r in cp.toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert toxic and set(after) == set(rows) - toxic
        elif name == "exact_dedup":
            best = {}
            for r in rows.values():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute([(i, r.text) for i, r in rows.items()]).items() if i == c}
        else:
            assert set(after) == set(rows)
            changed = [i for i in rows if rows[i].text != after[i].text]
            assert changed and all("[SECRET]" in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)
            assert not any(re.search(r"AKIA[A-Z0-9]{12}", r.text) for r in after.values())
        rows = after
    lib = library()
    ids = {i: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in rows.items()}
    check_packed(cp.STAGES[-1][1](spark, docs, SF).collect(), ids)


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "same words here", None, 1), (3, "same words here", None, 1), (4, "same words here", "y", None), (5, "long " * 50_000, "y", 1), (None, "gone", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id int").withColumn("_id", F.lit(0)).withColumn("score", F.lit(1))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in cp.STAGES:
            now = cp.cut(stage(spark, now, SF), "test-stage")
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() == 0) == empty
