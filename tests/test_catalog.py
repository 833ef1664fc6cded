"""Registered queries against their SQL twins on the smallest test tables.

All of them with PROBSCAPE_FULL=1 (``check.py`` does the same with a report); a quick
selection otherwise.
"""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "a11_build_features", "p11_normalize_run", "j4_merge_patch", "a13_feature_diagnostics", "s5_vec_to_block",
    "m12_portfolio", "g1_convex_hull_by_group", "c8_graph_weight_matrix", "p10_attach_family",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("PROBSCAPE_FULL") else QUICK)
def test_query_equals_sql(spark, name):
    import check
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(check.normal(r[c]) for c in cols) for r in df.collect()), key=check.key)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(check.normal(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=check.key)
    assert mine == theirs
