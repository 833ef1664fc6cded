"""Corpus changes and graphs: invariants on small corpora."""

import pytest
from pyspark.sql import functions as F

from probscape.common import DataError
from probscape.functions.draws import HashDraws
from probscape.functions.features import Corpus
from probscape.operators import augment as ag
from probscape.operators import graphs as gr

COORD = ["instance", "mat_id", "block_id", "row", "col"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    p = spark.createDataFrame([("a", 2, 2), ("b", 1, 1), ("c", 2, 2)], "instance string, m int, n_blocks int")
    k = spark.createDataFrame([("a", 1, 6), ("a", 2, -3), ("b", 1, 4), ("c", 1, 6), ("c", 2, -3)], "instance string, block_id int, size int")
    b = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -3.0), ("b", 1, 0.5), ("c", 1, 2.0), ("c", 2, 2.0)], "instance string, mat_id int, b double")
    e = [(i, m, 1, r, c, float(m + r * c)) for i in "ac" for m in (0, 1, 2) for r in range(1, 4) for c in range(r, 4)]
    e += [("b", 0, 1, 1, 1, 1.0), ("b", 1, 1, 1, 2, 2.0)]
    return Corpus(p, k, b, spark.createDataFrame(e, "instance string, mat_id int, block_id int, row int, col int, value double"))


def test_neutral_changes(spark, corpus):
    for part in ("A", "C", "b"):
        same = ag.scale(corpus, part, 1.0)
        assert rows(same.entries) == rows(corpus.entries) and rows(same.rhs) == rows(corpus.rhs)
    assert rows(ag.perturb(corpus.entries, F.lit(True), 0.0)) == rows(corpus.entries)
    with pytest.raises(DataError):
        ag.scale(corpus, "x", 2.0)


def test_draws_do_not_depend_on_partitioning(spark, corpus):
    a = rows(ag.perturb(corpus.entries, F.lit(True)))
    assert rows(ag.perturb(corpus.entries.repartition(5), F.lit(True))) == a
    u = [r[0] for r in spark.range(4000).select(HashDraws(3).uniform("x", F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.03
    n = [r[0] for r in spark.range(4000).select(HashDraws(3).normal("x", F.col("id"))).collect()]
    assert abs(sum(n) / 4000) < 0.06 and abs(sum(x * x for x in n) / 4000 - 1) < 0.1


def test_dropping_keeps_an_objective(spark, corpus):
    chosen = ag.objective_of(corpus.problems).unionByName(corpus.problems.select("instance", F.lit(1).alias("mat_id")))
    left = ag.drop_entries(corpus.entries, chosen, 100).groupBy("instance", "mat_id").count()
    assert rows(left) == [("a", 0, 1), ("a", 2, 6), ("b", 0, 1), ("c", 0, 1), ("c", 2, 6)]
    two = ag.drop_entries(corpus.entries, corpus.problems.select("instance", F.lit(1).alias("mat_id")), 2)
    assert two.count() == corpus.entries.count() - 5


def test_added_entries_are_new_and_valid(spark, corpus):
    chosen = ag.objective_of(corpus.problems)
    out = ag.add_entries(corpus, chosen, 4)
    assert out.count() == corpus.entries.count() + 12
    assert out.select(*COORD).distinct().count() == out.count()
    bad = out.join(corpus.blocks, ["instance", "block_id"]).where(
        "row > col OR col > abs(size) OR row < 1 OR (size < 0 AND row <> col)"
    )
    assert bad.count() == 0
    assert rows(corpus.entries.subtract(out)) == []


def test_constraints_come_and_go(spark, corpus):
    more = ag.add_constraint(corpus)
    assert rows(more.problems) == [("a", 3, 2), ("b", 2, 1), ("c", 3, 2)]
    new = more.entries.join(corpus.problems, "instance").where("mat_id = m + 1").groupBy("instance").count()
    assert {r["instance"] for r in new.collect()} == {"a", "b", "c"} and all(1 <= r["count"] <= 3 for r in new.collect())
    gone = ag.remove_constraint(corpus, corpus.problems.select("instance", F.lit(1).alias("mat_id")))
    assert rows(gone.problems) == [("a", 1, 2), ("b", 1, 1), ("c", 1, 2)]
    assert rows(gone.rhs) == [("a", 1, -3.0), ("b", 1, 0.5), ("c", 1, 2.0)]
    moved = corpus.entries.where("instance = 'a' AND mat_id = 2").withColumn("mat_id", F.lit(1))
    assert rows(gone.entries.where("instance = 'a' AND mat_id = 1")) == rows(moved)


def test_children_mix_their_parents(spark, corpus):
    pairs = spark.createDataFrame([("k", "a", "c"), ("l", "a", "b")], "child string, parent_a string, parent_b string")
    out = ag.blend(corpus, pairs)
    assert rows(out.problems) == [("k", 2, 2), ("l", 2, 2)]
    b = {r["mat_id"]: r["b"] for r in out.rhs.where("instance = 'k'").collect()}
    assert 1.25 <= b[1] <= 1.75 and -1.75 <= b[2] <= 0.75
    assert out.entries.select(*COORD).distinct().count() == out.entries.count()
    # different m: only objective entries are taken, constraints stay the first parent's
    mine = out.entries.where("instance = 'l' AND mat_id > 0").drop("instance")
    assert rows(mine) == rows(corpus.entries.where("instance = 'a' AND mat_id > 0").drop("instance"))


def test_every_mutation_keeps_the_corpus_consistent(spark, corpus):
    born = corpus.problems.where("instance <> 'b'").select(
        F.explode(F.sequence(F.lit(1), F.lit(22))).alias("n"), F.col("instance").alias("parent")
    ).withColumn("child", F.concat_ws("-", "parent", F.col("n").cast("string")))
    kids = ag.copies(corpus, born.select("child", "parent"))
    ops = born.select(
        F.col("child").alias("instance"), F.element_at(F.array(*map(F.lit, ag.MUTATIONS)), (F.col("n") % 11 + 1).cast("int")).alias("op")
    )
    out = ag.mutate(kids, ops=ops)
    assert out.problems.count() == 44
    assert out.entries.join(out.problems, "instance").where("mat_id > m").count() == 0
    assert out.rhs.groupBy("instance").count().join(out.problems, "instance").where("count <> m").count() == 0


def test_graph_rules(spark):
    edges = spark.createDataFrame([("g", 2, 1, 3.0), ("g", 1, 2, 1.0), ("g", 3, 3, 5.0)], "graph string, i int, j int, w double")
    assert rows(gr.graph_weight_matrix(edges)) == [("g", 1, 2, 4.0), ("g", 2, 1, 4.0), ("g", 3, 3, 10.0)]
    heads = spark.createDataFrame([("g", 3, 2), ("big", 9000, 2)], "graph string, n int, k int")
    torus = gr.graph_to_problem(heads, edges, "TORUS", max_n=5000)
    assert rows(torus.problems) == [("g", 3, 1)]
    assert rows(torus.entries.where("mat_id = 0").drop("instance")) == [
        (0, 1, 1, 1, 2.0), (0, 1, 1, 2, -2.0), (0, 1, 1, 2, -2.0), (0, 1, 2, 2, 2.0)]
    fap = gr.graph_to_problem(heads.where("n = 3"), edges.withColumn("w", F.col("w") * 300), "FAP")
    assert rows(fap.problems) == [("g", 9, 2)] and fap.rhs.count() == 9
    with pytest.raises(Exception, match="k > 1"):
        gr.graph_to_problem(heads.where("n = 3").withColumn("k", F.lit(1)), edges, "FAP").entries.collect()
    with pytest.raises(DataError):
        gr.validate_graph(spark.createDataFrame([("g", 4)], "graph string, m int"), edges.select("graph", F.array("i", "j", "w").alias("tokens")), strict=True)
    with pytest.raises(DataError):
        gr.graph_to_problem(heads, edges, "NQL")
