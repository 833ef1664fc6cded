"""Problem text, features and their user extensions on small hand-made cases."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from probscape.common import DataError
from probscape.functions.features import Corpus, FeatureRegistry, build_features, fold_symmetric
from probscape.functions.registry import DEFAULT_ENABLED, builtin_groups, needed_only, select_features
from probscape.sources import corpus as cp
from probscape.sources.tables import load_stage, read_table, write_table

GOOD = """"a comment
* another

 3
2
{3, -2}
1.0, {-2.0} 0.5
0 1 1 1 2.0
0 1 2 1 -4.0
0 1 1 2 1.0
1 1 3 2 5.0
1 2 1 1 1.0
1 2 1 1 1.0
2 1 1 1 0.0
9 1 1 1 1.0
1 3 1 1 1.0
1 1 1 1
x 1 1 1 1.0
1 2 2 2 2.5e0 trailing
"""
LP = "1\n1\n(-4)\n0\n1 1 1 1 3\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.dat-s").write_text(GOOD)
    (tmp_path / "sub" / "lp.DAT-S").write_text(LP)
    (tmp_path / "notes.txt").write_text("1 2 3")
    return str(tmp_path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_discover_and_read(spark, folder):
    found = cp.discover_instances(spark, folder)
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["good.dat-s", "lp.DAT-S"]
    c = cp.read_problem_corpus(spark, folder)
    assert rows(c.problems) == [("good.dat-s", 3, 2), ("sub/lp.DAT-S", 1, 1)]
    assert rows(c.blocks) == [("good.dat-s", 1, 3), ("good.dat-s", 2, -2), ("sub/lp.DAT-S", 1, -4)]
    assert rows(c.rhs) == [("good.dat-s", 1, 1.0), ("good.dat-s", 2, -2.0), ("good.dat-s", 3, 0.5), ("sub/lp.DAT-S", 1, 0.0)]
    assert rows(c.entries.where("instance = 'good.dat-s'").drop("instance")) == [
        (0, 1, 1, 1, 2.0), (0, 1, 1, 2, -4.0), (0, 1, 1, 2, 1.0), (1, 1, 2, 3, 5.0),
        (1, 2, 1, 1, 1.0), (1, 2, 1, 1, 1.0), (1, 2, 2, 2, 2.5),
    ]


def test_split_files_give_the_same_corpus(spark, folder):
    """Tiny splits: header and body of a file land in different tasks."""
    whole = [rows(t) for t in vars(cp.read_problem_corpus(spark, folder)).values()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "17")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert [rows(t) for t in vars(cp.read_problem_corpus(spark, folder)).values()] == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text, message", [
    ("1\n2\n3\n1.0\n", "block count"),
    ("2\n1\n3\n1.0\n", "length of b"),
    ("x\n1\n3\n1.0\n", "bad header"),
    ("1\n1\n3\n", "fewer than four"),
    ("1\n1\n3.5\n1.0\n", "bad block size"),
])
def test_header_faults_fail(spark, tmp_path, text, message):
    (tmp_path / "bad.dat-s").write_text(text)
    with pytest.raises(Exception, match=message):
        cp.read_problem_corpus(spark, str(tmp_path)).problems.collect()


def test_no_instances_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(DataError):
        cp.discover_instances(spark, str(tmp_path))


def test_export_and_read_back(spark, folder, tmp_path):
    c = cp.read_problem_corpus(spark, folder)
    out = str(tmp_path / "out")
    cp.export_corpus(c, out, partitions=5)
    back = cp.read_problem_corpus(spark, out)
    for name in ("problems", "blocks", "rhs", "entries"):
        assert rows(getattr(back, name)) == rows(getattr(c, name))


def brute_features(sizes, b, entries):
    """The definitions in plain Python for one instance; entries are (mat, blk, row, col, value)."""
    m, s = len(b), [abs(x) for x in sizes]
    cap = sum(x * (x + 1) // 2 if x > 0 else -x for x in sizes)
    cells = {k: set() for k in range(m + 1)}
    for mat, blk, r, c, _ in entries:
        cells[mat].add((blk, min(r, c), max(r, c)))
    fro = [math.sqrt(sum(v * v * (1 if r == c else 2) for mt, _, r, c, v in entries if mt == k)) for k in range(m + 1)]
    nnz = [len(cells[k]) for k in range(1, m + 1)]
    mean = sum(nnz) / m
    return {
        "feature_m": m, "feature_n_total_matrix": sum(s), "feature_block_size_entropy": -sum(x / sum(s) * math.log(x / sum(s)) for x in s),
        "feature_nnz_c_upper": len(cells[0]), "feature_density_c_upper": len(cells[0]) / cap,
        "feature_avg_nnz_ai_upper": mean, "feature_std_nnz_ai_upper": math.sqrt(sum((x - mean) ** 2 for x in nnz) / m),
        "feature_min_nnz_ai_upper": min(nnz), "feature_num_empty_ai": nnz.count(0), "feature_c_fro_norm_upper": fro[0],
        "feature_avg_ai_fro_norm_upper": sum(fro[1:]) / m, "feature_b_l2_norm": math.sqrt(sum(x * x for x in b)),
        "feature_block_sizes_raw": ";".join(map(str, sizes)),
    }


def test_features_match_their_definitions(spark, folder):
    c = cp.read_problem_corpus(spark, folder)
    got = {r["instance"]: r.asDict() for r in build_features(c, [n for g in builtin_groups().values() for n in g]).collect()}
    cases = {
        "good.dat-s": ([3, -2], [1.0, -2.0, 0.5], [tuple(r)[1:] for r in c.entries.where("instance = 'good.dat-s'").collect()]),
        "sub/lp.DAT-S": ([-4], [0.0], [(1, 1, 1, 1, 3.0)]),
    }
    for name, case in cases.items():
        for f, v in brute_features(*case).items():
            assert got[name][f] == (v if isinstance(v, str) else pytest.approx(v, rel=1e-12)), (name, f)
    lp = got["sub/lp.DAT-S"]
    assert lp["feature_c_max_abs_entry"] is None and lp["feature_ratio_c_to_b_l2"] is None and lp["feature_c_fro_norm_upper"] == 0


def test_features_do_not_depend_on_partitioning_and_folding_twice_is_folding_once(spark, folder):
    c = cp.read_problem_corpus(spark, folder)
    spread = Corpus(c.problems, c.blocks, c.rhs, c.entries.repartition(7))
    assert rows(build_features(spread)) == rows(build_features(c))
    once = fold_symmetric(c.entries)
    assert rows(fold_symmetric(once)) == rows(once)


def test_feature_selection_rules(spark):
    assert list(select_features(DEFAULT_ENABLED)) == ["size", "structure", "sparsity", "scaling"]
    for bad in ([], ["feature_m", "feature_m"], ["feature_unknown"]):
        with pytest.raises(DataError):
            select_features(bad)
    with pytest.raises(DataError):
        select_features(["a"], {"x": ["a"], "y": ["a"]})
    groups, solvers = needed_only(["feature_m", "algo_b"], DEFAULT_ENABLED, ["a", "b"])
    assert groups == {"size": ["feature_m"]} and solvers == ["b"]


def test_user_features(spark, folder):
    c = cp.read_problem_corpus(spark, folder)
    reg = FeatureRegistry()
    reg.register_features("mine", ["feature_rows"], lambda x: x.entries.groupBy("instance").agg(F.max("row").cast("double").alias("feature_rows")))
    reg.register_opaque("code", ["feature_sum"], lambda pdf: {"feature_sum": float(pdf["value"].sum())})
    got = {r["instance"]: (r["feature_rows"], r["feature_sum"]) for r in build_features(c, ["feature_rows", "feature_sum"], reg).collect()}
    assert got == {"good.dat-s": (2.0, 8.5), "sub/lp.DAT-S": (1.0, 3.0)}
    with pytest.raises(DataError):
        reg.register_features("again", ["feature_m"], None)
    reg.register_features("empty", ["feature_gone"], lambda x: x.problems)
    with pytest.raises(DataError):
        build_features(c, ["feature_gone"], reg)


def test_vector_layout_round_trip(spark):
    blocks = spark.createDataFrame([("a", 1, -3), ("a", 2, 4), ("b", 1, 2)], "instance string, block_id int, size int")
    vec = spark.range(3 + 16).selectExpr("'a' AS instance", "id AS idx").unionByName(spark.range(4).selectExpr("'b' AS instance", "id AS idx"))
    got = cp.vec_to_block(vec, blocks)
    assert got.count() == 23
    square = got.where("instance = 'a' AND block_id = 2")
    back = cp.vectorise(square, F.lit(4)).where("row = col").select("idx").orderBy("idx")
    assert [r[0] for r in back.collect()] == [0, 5, 10, 15]
    assert rows(got.where("instance = 'a' AND block_id = 1").select("idx", "row", "col")) == [(0, 1, 1), (1, 2, 2), (2, 3, 3)]


def test_cone_blocks_without_cones_fail(spark):
    schema = "instance string, f array<double>, l array<double>, q array<double>, r array<double>, s array<double>"
    ok = spark.createDataFrame([("a", [2.0, 1.0], None, [3.0], None, [2.0, 0.0])], schema)
    assert rows(cp.cone_blocks(ok)) == [("a", 1, -3), ("a", 2, -3), ("a", 3, 2)]
    with pytest.raises(Exception, match="no cone blocks"):
        cp.cone_blocks(spark.createDataFrame([("a", [0.0], None, None, None, None)], schema)).collect()


def test_stages(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    path = str(tmp_path / "t")
    assert rows(load_stage(spark, "build", path, lambda: df)) == rows(df)
    assert rows(load_stage(spark, "csv", path, None)) == rows(df)
    with pytest.raises(DataError):
        load_stage(spark, "disabled", path, None)
    with pytest.raises(DataError):
        load_stage(spark, "build", path, lambda: df.limit(0))
    write_table(df, str(tmp_path / "c"), "csv")
    assert rows(read_table(spark, str(tmp_path / "c"), "csv")) == rows(df)


def test_instance_selection(spark):
    listing = spark.createDataFrame([("r2", "a.mat", "r2/a.mat"), ("r1", "a.mat", "r1/a.mat"), ("r2", "b.mat", "r2/b.mat")], "root string, name string, path string")
    got = cp.select_instances(listing, ["r1", "r2"], "enabled", ["b.mat", "a.mat"])
    assert sorted(r["path"] for r in got.collect()) == ["r1/a.mat", "r2/b.mat"]
    with pytest.raises(DataError):
        cp.select_instances(listing, ["r1", "r2"], "enabled", ["c.mat"])
    with pytest.raises(DataError):
        cp.select_instances(listing, ["r1", "r3"], "all")


def test_opaque_frames_are_per_instance(spark, folder):
    c = cp.read_problem_corpus(spark, folder)
    reg = FeatureRegistry()
    reg.register_opaque("n", ["feature_n"], lambda pdf: {"feature_n": float(pdf["instance"].nunique() if isinstance(pdf, pd.DataFrame) else 0)})
    assert {r["feature_n"] for r in build_features(c, ["feature_n"], reg).collect()} == {1.0}


def test_exported_parts(spark, tmp_path):
    """A folder for each instance under its escaped name, without files of the table writer, and nothing left of an older export."""
    c = cp.Corpus(
        spark.createDataFrame([("a/b c%", 1, 1), ("p", 1, 1)], "instance string, m int, n_blocks int"),
        spark.createDataFrame([("a/b c%", 1, 3), ("p", 1, 2)], "instance string, block_id int, size int"),
        spark.createDataFrame([("a/b c%", 1, 2.0), ("p", 1, 1.0)], "instance string, mat_id int, b double"),
        spark.createDataFrame([("a/b c%", 1, 1, 1, i, 1.0 + i) for i in (1, 2, 3)], "instance string, mat_id int, block_id int, row int, col int, value double"),
    )
    out = tmp_path / "out"
    (out / "instance=old").mkdir(parents=True)
    (out / "instance=old" / "part-0.txt").write_text("1\n")
    cp.export_corpus(c, str(out), partitions=2)
    parts = sorted(p for p in out.glob("instance=*/*"))
    assert {p.parent.name for p in parts} == {"instance=a%2Fb c%25", "instance=p"} and not [p for p in out.glob("instance=*/.*")]
    text = "".join(p.read_text() for p in parts if "%2F" in p.parent.name)
    assert text.splitlines() == ["1", "1", "3", "2.0", "1 1 1 1 2.0", "1 1 1 2 3.0", "1 1 1 3 4.0"]
    assert rows(cp.read_problem_corpus(spark, str(out)).entries) == rows(c.entries)
