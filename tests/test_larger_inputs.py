"""What showed on larger copies of the test tables only."""

from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from probscape import adapters as ad
from probscape.catalog import QUERIES
from probscape.catalog import augment as catalog
from probscape.functions.draws import HashDraws
from probscape.functions.features import Corpus
from probscape.functions.model import box_cox_profile, fit_zscore, ridge_map
from probscape.operators import augment as ag
from probscape.operators import graphs as gr
from probscape.operators import metadata as md


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_candidates_without_a_seed_row(spark):
    seeds = spark.createDataFrame([("a", "S", 1.0, 2.0)], "instances string, source string, feature_x double, algo_p double")
    cands = spark.createDataFrame([("k", "a", 5.0), ("l", "gone", 6.0)], "instances string, seed string, feature_x double")
    assert rows(md.template_row(cands, seeds, strict=False)) == [("k", md.FILL_LABEL, 5.0, 2.0)]
    with pytest.raises(Exception, match="no row of the seed of l"):
        md.template_row(cands, seeds).collect()


def test_sums_do_not_depend_on_the_files(spark, tmp_path):
    """Equal customers, whose orders lie in several files, have equal sums to the last bit."""
    orders = [(100 * c + i, c, 0.1 * (i + 1), "O", "5-LOW") for c in range(8) for i in range(9)]
    schema = "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"
    for part in range(5):
        own = [o for o in orders if (o[0] + o[1] * o[0] // 7) % 5 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, "S") for c in range(8)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r["feature"]: r["distinct_values"] for r in QUERIES["a13_feature_diagnostics"](spark, str(tmp_path)).collect()}
    assert found["feature_price_sum"] == found["feature_low"] == 1
    total = ad.metadata(spark, str(tmp_path), ordered=True).first()["feature_price_sum"]
    assert total == reduce(add, [0.1 * (i + 1) for i in range(9)])
    low = {r["algo_low"] for r in QUERIES["j8_backfill_column"](spark, str(tmp_path)).collect()}
    assert low == {"", "1"}


class _Still(HashDraws):
    """Every draw is the same."""

    def uniform(self, label, *keys):
        return F.lit(0.0)


def test_attempts_alone_may_find_too_few(spark):
    corpus = Corpus(
        spark.createDataFrame([("a", 2, 1)], "instance string, m int, n_blocks int"),
        spark.createDataFrame([("a", 1, 8)], "instance string, block_id int, size int"),
        spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "instance string, mat_id int, b double"),
        spark.createDataFrame([("a", 1, 1, 1, 1, 2.0)], "instance string, mat_id int, block_id int, row int, col int, value double"),
    )
    chosen = spark.createDataFrame([("a", 1), ("a", 2)], "instance string, mat_id int")
    few = ag.sample_positions(corpus, chosen, 3, 3, _Still(), fill=False)
    assert rows(few.select("mat_id", "row", "col")) == [(2, 1, 1)]
    assert ag.sample_positions(corpus, chosen, 3, 3, _Still()).count() == 6


def test_position_tables_are_dealt_and_not_broadcast(spark):
    heads = spark.range(3000).selectExpr("concat('g', id) AS graph", "20 AS n", "3 AS k")
    edges = spark.createDataFrame([("g1", 1, 2, 950.0), ("g1", 2, 1, 1.0), ("g1", 25, 2, 950.0)], "graph string, i int, j int, w double")
    parts = gr.cell_parts(heads)
    assert parts >= 3
    c = gr.graph_to_problem(heads.limit(3), edges, "FAP")
    joined = catalog._as_rows(Corpus(c.problems, c.blocks, c.rhs, c.entries.limit(0)))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in joined
    assert gr._cells(gr._each(heads, "j"), 7).rdd.getNumPartitions() == 7
    assert c.entries.where("block_id = 1 AND instance = 'g1'").count() == 20 * 20 - 22


def test_likelihoods_leave_a_task_as_moments(spark):
    t = [1.0 + (i * i % 97) / 7 for i in range(500)]
    df = spark.createDataFrame([(x, None if i % 5 else x * 1e6) for i, x in enumerate(t)], "x double, y double")
    grid = {"x": [-2.0, 0.0, 0.5], "y": [1.0]}
    for parts in (1, 7):
        found = box_cox_profile(df.repartition(parts), grid)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["feature"], r["lambda"]): r["ll"] for r in found.collect()}
        for name, lams in grid.items():
            v = np.array(t if name == "x" else [x * 1e6 for i, x in enumerate(t) if i % 5 == 0])
            for lam in lams:
                y = np.log(v) if lam == 0 else (v ** lam - 1) / lam
                assert got[name, lam] == pytest.approx(-len(v) / 2 * np.log(y.var()) + (lam - 1) * np.log(v).sum(), rel=1e-12)


def test_entries_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ag, "TASK_ROWS", 100)
    places = [("a", 1, 1, i % 30, i % 40, float(i)) for i in range(1200)]
    entries = spark.createDataFrame(places, "instance string, mat_id int, block_id int, row int, col int, value double")
    found = ag.unique_entries(entries)
    assert found.rdd.getNumPartitions() == 12
    best = {}
    for i in range(1200):
        place = (min(i % 30, i % 40), max(i % 30, i % 40))
        best[place] = max(best.get(place, 0.0), float(i))
    assert {(r["row"], r["col"]): r["value"] for r in found.collect()} == best


def test_a_constant_column_has_no_deviation(spark):
    """Merging the moments of two tasks of 49 rows leaves 2.0 a deviation of about 1e-16."""
    df = spark.range(98, numPartitions=2).selectExpr("2.0D AS flat", "1e6D + 0.1D AS large", "id * 1.0D AS x", "id * 1.0D AS z_1", "id * 2.0D AS z_2")
    found = fit_zscore(df, ["flat", "large", "x"])
    assert found["flat"] == (2.0, 1.0) and found["large"][1] == 1.0
    assert found["x"] == (48.5, pytest.approx(np.std(np.arange(98), ddof=1), rel=1e-12))
    assert ridge_map(df, ["flat", "large", "x"]).scale[:2] == (1.0, 1.0)
