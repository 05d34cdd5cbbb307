import pytest

import __spark_entry__ as entry

FAST = ["q_histogram_dense", "q_halos", "q_relabel", "q_pbf_sorted", "q_cc_labels", "q_sssp_dist", "q_near_far_split"]


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len([n for n in q if n.startswith("q_")]) >= 50


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert norm(got.select(*cols).collect()) == norm(con.sql(entry.oracle_sql()[name]).select(*cols).fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 7
