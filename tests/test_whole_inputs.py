"""Nothing is cut off, and missing or infinite values have defined results."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from probscape.functions import order_stats as osx
from probscape.functions.features import Corpus, FeatureRegistry, build_features
from probscape.operators import augment as ag
from probscape.operators import coverage as cv
from probscape.operators import graphs as gr
from probscape.operators import nearest as nn
from probscape.sources import audit

POINTS = "instance string, z_1 double, z_2 double"


def test_points_without_a_place_are_no_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("n", None, None), ("m", nan, 0.0), ("i", inf, 0.0)], POINTS)
    targets = spark.createDataFrame([("s", 0.9, 0.9), ("t", 0.1, 0.0), ("u", None, 1.0), ("v", nan, 1.0)], POINTS)
    got = {r["instance"]: r for r in nn.nearest_seed(targets, pts).collect()}
    assert {k: r["seed_instance"] for k, r in got.items()} == {"s": "b", "t": "a", "u": None, "v": None}
    assert got["t"]["seed_distance"] == pytest.approx(0.1)
    far = {r["instance"]: r["nearest_instance_distance"] for r in nn.nearest_distance(targets, pts).collect()}
    assert far["u"] is None and far["s"] == pytest.approx(math.hypot(0.1, 0.1))
    none = nn.nearest_distance(targets, pts.limit(0)).collect()
    assert len(none) == 4 and all(r["nearest_instance_distance"] is None for r in none)


def test_many_points_in_one_place(spark):
    pts = spark.range(30_000).selectExpr("concat('p', lpad(id, 6, '0')) AS instance", "0.5 AS z_1", "0.5 AS z_2").selectExpr("instance", "double(z_1) z_1", "double(z_2) z_2")
    got = nn.nearest_seed(spark.createDataFrame([("t", 0.0, 0.5)], POINTS), pts).first()
    assert (got["seed_instance"], got["seed_distance"]) == ("p000000", 0.5)


def test_targets_in_rounds(spark):
    rows = [(i, j, i / 10, j / 10, 1.0 + (i * 7 + j) % 5) for i in range(10) for j in range(10)] + [(11, 11, 5.0, 5.0, None)]
    cand = spark.createDataFrame(rows, "i int, j int, z_1 double, z_2 double, nearest_instance_distance double")
    got = [(r["z_1"], r["z_2"]) for r in cv.select_targets(cand, 5, 0.4).collect()]
    want = []
    for _, _, x, y, d in sorted((r for r in rows if r[4]), key=lambda r: (-r[4], r[0], r[1])):
        if len(want) < 5 and all(math.hypot(x - a, y - b) >= 0.4 for a, b in want):
            want.append((x, y))
    assert got == want


def test_quantiles_with_infinite_values(spark):
    values = [float("inf"), float("-inf"), float("nan"), None] + [float(k * k % 9973) for k in range(6000)]
    long = spark.createDataFrame([("a", v) for v in values] + [("b", float("inf")), ("b", 1.0)], "key string, value double")
    got = osx.quantiles(long, [0.0, 0.5, 1.0])
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    assert got["a"][0] == -math.inf and got["a"][2] == math.inf
    assert got["a"][1] == pytest.approx((known[3000] + known[3001]) / 2, abs=known[3001] - known[3000] + 1e-9)
    assert got["b"][0] == 1.0 and got["b"][2] == math.inf
    groups = osx.grouped_median(spark.createDataFrame([("g", 1.0), ("g", float("nan")), ("g", 3.0)], "k string, v double"), ["k"], "v")
    assert groups.first()["median"] == 2.0


def test_a_bad_row_far_down_is_found(spark):
    lines = [("g/x.dat", 0, "# c"), ("g/x.dat", 1, "9 400")] + [("g/x.dat", k + 2, "1 2 3.0") for k in range(400)]
    bad = lines[:300] + [("g/x.dat", 300, "1 10 3.0")] + lines[301:]
    files = spark.createDataFrame([("g/x.dat", 1)], "path string, size_bytes bigint")

    def kind(rows, **how):
        table = spark.createDataFrame(rows, "path string, line_no bigint, line string")
        return audit.classify_files(files, table, **how).first()["kind"]

    assert kind(lines) == "raw-dimacs-data" and kind(bad) == "text"
    assert kind(bad, graph_lines=200, checked_rows=5) == "raw-dimacs-data"


@pytest.fixture()
def full(spark):
    """One matrix with a single free position, and one that is empty."""
    entries = [("a", 1, 1, i, j, 1.0 + i) for i in range(1, 9) for j in range(i, 9) if (i, j) != (3, 7)]
    return Corpus(
        spark.createDataFrame([("a", 2, 1)], "instance string, m int, n_blocks int"),
        spark.createDataFrame([("a", 1, 8)], "instance string, block_id int, size int"),
        spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "instance string, mat_id int, b double"),
        spark.createDataFrame(entries, "instance string, mat_id int, block_id int, row int, col int, value double"),
    )


def test_nearly_full_matrices_are_filled(spark, full):
    chosen = spark.createDataFrame([("a", 1), ("a", 2)], "instance string, mat_id int")
    got = ag.sample_positions(full, chosen, 40, 40).collect()
    one = {(r["row"], r["col"]) for r in got if r["mat_id"] == 1}
    two = {(r["row"], r["col"]) for r in got if r["mat_id"] == 2}
    assert one == {(3, 7)} and two == {(i, j) for i in range(1, 9) for j in range(i, 9)}
    assert ag.add_entries(full, chosen.limit(1), 3).count() == 36


def test_large_graphs_are_converted(spark):
    graphs = spark.createDataFrame([("g", 6000, 1, 2)], "graph string, n int, m int, k int")
    edges = spark.createDataFrame([("g", 1, 6000, 2.0)], "graph string, i int, j int, w double")
    got = gr.graph_to_problem(graphs, edges, "TORUS")
    assert got.problems.first()["m"] == 6000 and got.entries.where("mat_id > 0").count() == 6000
    assert gr.graph_to_problem(graphs, edges, "TORUS", max_n=5000).problems.count() == 0


def test_partial_features_of_split_instances(spark, full):
    reg = FeatureRegistry()
    reg.register_partial(
        "sum", ["feature_total", "feature_rows"],
        lambda pdf: struct.pack("<dq", pdf["value"].sum(), len(pdf)),
        lambda a, b: struct.pack("<dq", *(x + y for x, y in zip(struct.unpack("<dq", a), struct.unpack("<dq", b)))),
        lambda s: dict(zip(["feature_total", "feature_rows"], map(float, struct.unpack("<dq", s)))),
    )
    spread = Corpus(full.problems, full.blocks, full.rhs, full.entries.repartition(5))
    row = build_features(spread, ["feature_total", "feature_rows"], reg).first()
    assert row["feature_rows"] == 35.0 and row["feature_total"] == full.entries.agg(F.sum("value")).first()[0]
