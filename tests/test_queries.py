"""Every registered query of the main library runs; those with SQL give what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from stratawave import queries as q

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: The smallest tables have too few rows of a class for these.
NEED_ROWS = {"stratified_sample"}


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return int(v)
    return round(float(v), 5) + 0.0 if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    def views(sf):
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
        return con

    return {sf: views(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_against_duckdb(spark, duck, name):
    sf = LARGER if name in NEED_ROWS else SF
    df = q.QUERIES[name](spark, sf)
    want = duck[sf].execute(q.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["baseline_answers", "residual_steps", "legacy_steps", "render_prompts", "c2_from_text"])
def test_query_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
