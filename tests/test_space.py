"""Statistics, model, geometry and nearest neighbours against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from probscape.common import DataError
from probscape.functions import labels as lb
from probscape.functions import model as ml
from probscape.functions import order_stats as os_
from probscape.operators import coverage as cv
from probscape.operators import geometry as gm
from probscape.operators import nearest as nn


def cloud(n, seed=1, dup=False):
    rnd = random.Random(seed)
    pts = [(f"p{i:04d}", round(rnd.gauss(0, 1), 3), round(rnd.gauss(0, 2), 3)) for i in range(n)]
    if dup:  # a third of all rows in one place, and one far away
        pts = [(i, 0.5, 0.5) if int(i[1:]) % 3 == 0 else (i, x, y) for i, x, y in pts] + [("far", 50.0, 50.0)]
    return pts


def frame(spark, pts):
    return spark.createDataFrame(pts, "instance string, z_1 double, z_2 double")


def test_order_statistics_are_exact(spark, monkeypatch):
    monkeypatch.setattr(os_, "_FEW", 3)  # force several rounds
    monkeypatch.setattr(os_, "_CELLS", 40)
    rnd = random.Random(7)
    data = {
        "skewed": [rnd.expovariate(1) ** 6 for _ in range(501)], "constant": [2.5] * 40,
        "repeated": [1.0] * 200 + [5.0] + [rnd.random() for _ in range(60)], "one": [3.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "key string, value double")
    got = os_.quantiles(df, [0.25, 0.5, 0.9])
    for k, vs in data.items():
        s = sorted(vs)
        for p, v in zip([0.25, 0.5, 0.9], got[k]):
            pos = p * (len(s) - 1)
            lo = int(pos)
            want = s[lo] + (pos - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo])
            assert v == pytest.approx(want, rel=1e-12)


def test_grouped_median_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(os_, "GROUP_ROWS", 50)
    rnd = random.Random(3)
    data = [("hot", rnd.random()) for _ in range(201)] + [("cold", rnd.random()) for _ in range(9)]
    got = {r["k"]: r["median"] for r in os_.grouped_median(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    for k in ("hot", "cold"):
        assert got[k] == pytest.approx(statistics.median(v for g, v in data if g == k))


def test_box_cox_maximises_the_likelihood(spark):
    rnd = random.Random(5)
    xs = [math.exp(rnd.gauss(0, 0.5)) + 1 for _ in range(200)]
    df = spark.createDataFrame([(x, 4.0) for x in xs], "a double, flat double")
    lam = ml.fit_box_cox(df, ["a", "flat"])
    assert lam["flat"] == 1.0

    def ll(l):
        ys = [math.log(x) if l == 0 else (x ** l - 1) / l for x in xs]
        return -len(xs) / 2 * math.log(statistics.pvariance(ys)) + (l - 1) * sum(map(math.log, xs))

    assert all(ll(lam["a"]) >= ll(lam["a"] + d) - 1e-9 for d in (-0.5, -0.01, -1e-4, 1e-4, 0.01, 0.5))


def test_missing_feature_fails_normalisation(spark):
    m = {"a": ml.FeatureModel(0.0, 10.0, 1.0, 0.0, 0.0, 0.0)}
    df = spark.createDataFrame([("x", 3.0), ("y", None)], "id string, feature_a double")
    assert ml.apply_norm(df.where("id = 'x'"), m, ["id"]).first()["a"] == pytest.approx(math.log(3))
    with pytest.raises(Exception, match="missing"):
        ml.apply_norm(df, m, ["id"]).collect()


def test_projection_is_no_worse_than_the_principal_plane(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    y = x @ rng.normal(size=(4, 2)) + 0.1 * rng.normal(size=(80, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x, y]], "a double, b double, c double, d double, y1 double, y2 double")
    w = ml.fit_projection(df, ["a", "b", "c", "d"], ["y1", "y2"])

    def loss(z):
        both = np.c_[x, y]
        return ((both - z @ np.linalg.lstsq(z, both, rcond=None)[0]) ** 2).sum()

    best = loss(x @ np.array([w[c] for c in "abcd"]))
    assert all(best <= loss(x @ rng.normal(size=(4, 2))) for _ in range(50))


def test_ridge_map_matches_the_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(60, 3)) * [1, 5, 0], rng.normal(size=(60, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x, z]], "a double, b double, c double, z_1 double, z_2 double")
    fit = ml.ridge_map(df, ["a", "b", "c"])
    scale = np.where(x.std(axis=0) < 1e-12, 1.0, x.std(axis=0))
    xs = (x - x.mean(axis=0)) / scale
    want = np.linalg.pinv(xs.T @ xs + np.eye(3) * 1e-3) @ xs.T @ (z - z.mean(axis=0))
    assert np.allclose(fit.coef, want)


@pytest.mark.parametrize("d", [1, 2, 5])
def test_outline_is_the_hull_of_all_corners(spark, d):
    rnd = random.Random(d)
    box = {f"f{i}": (rnd.uniform(-2, 0), rnd.uniform(0.1, 2), rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(d)}
    if d == 5:
        box["f4"] = (0.0, 1.0, 2 * box["f3"][2], 2 * box["f3"][3])  # parallel generators
    ring = [(r["z_1"], r["z_2"]) for r in ml.outline(spark, box).orderBy("seq").collect()]
    corners = [(r["z_1"], r["z_2"]) for r in ml.corners(spark, box).collect()]
    assert len(ring) == 2 * (d - 1 if d == 5 else d)
    assert all(min(math.dist(v, c) for c in corners) < 1e-9 for v in ring)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in corners)


def test_hull_contains_all_points(spark):
    pts = cloud(300, dup=True)
    df = frame(spark, pts)
    hull = [(r["z_1"], r["z_2"]) for r in gm.convex_hull(df).orderBy("seq").collect()]
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for _, x, y in pts)
    tested = gm.point_in_polygon(df.withColumn("poly_id", F.lit("p")), gm.as_polygon(gm.convex_hull(df)), boundary=True)
    assert tested.where("not inside").count() == 0


def test_polygon_with_a_hole_and_two_ways(spark):
    rows = [("p", 1, i, x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])]
    rows += [("p", 2, i, x, y) for i, (x, y) in enumerate([(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)])]
    poly = spark.createDataFrame([(p, k, i, float(x), float(y)) for p, k, i, x, y in rows], "poly_id string, part_id int, seq int, z_1 double, z_2 double")
    pts = frame(spark, [("in", 1.0, 1.0), ("hole", 5.0, 5.0), ("out", 11.0, 5.0), ("edge", 10.0, 5.0)]).withColumn("poly_id", F.lit("p"))
    for how in ({}, {"max_edges": 0}):
        got = {r["instance"]: r["inside"] for r in gm.point_in_polygon(pts, poly, boundary=True, **how).collect()}
        assert got == {"in": True, "hole": False, "out": False, "edge": True}
    assert gm.polygon_area(poly).first()["area"] == pytest.approx(96.0)
    near = {r["instance"]: r["boundary_distance"] for r in gm.dist_to_boundary(pts, poly).collect()}
    assert near["in"] == pytest.approx(1.0) and near["hole"] == pytest.approx(1.0)


@pytest.mark.parametrize("how", [{}, {"levels": 1}, {"levels": 6}])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_exact(spark, k, how):
    pts, qs = cloud(250, dup=True), cloud(40, seed=9) + [("x", 0.5, 0.5), ("y", -30.0, 7.0)]
    got = {}
    for r in nn.nearest_k(frame(spark, qs), frame(spark, pts), k, **how).collect():
        got.setdefault((r["z_1"], r["z_2"]), []).append((r["rank"], r["instance"]))
    for _, x, y in qs:
        want = sorted(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in pts)[:k]
        assert [i for _, i in sorted(got[x, y])] == [i for _, i in want]


def test_knn_uses_other_folds_only(spark):
    pts = cloud(60)
    df = frame(spark, pts).withColumn("good_a", (F.col("z_1") > 0).cast("int")).withColumn("f", F.substring("instance", 2, 9).cast("int"))
    got = {r["instance"]: r["pred_a"] for r in lb.knn_predict(df, ["good_a"], 3, 4, F.col("f") % 4).collect()}
    for i, x, y in pts:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j, a) for j, a, b in pts if int(j[1:]) % 4 != int(i[1:]) % 4)[:3]
        assert got[i] == int(2 * sum(a > 0 for _, _, a in near) > 3)


def test_targets_and_errors(spark):
    df = frame(spark, cloud(80))
    one = [tuple(r) for r in cv.find_empty_space(df, 25, 5).collect()]
    sep = one[0][5]
    assert all(math.dist(a[1:3], b[1:3]) >= sep for i, a in enumerate(one) for b in one[:i])
    with pytest.raises(DataError):
        gm.make_grid(spark, (0, 1, 0, 1), 1)
    with pytest.raises(DataError):
        gm.padded((0, 0, 0, 1), 0.05)


def test_label_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 1.2), ("b", None, 5.0), ("c", None, None), ("d", 2.0, 2.0)], "instance string, algo_p double, algo_q double")
    out = lb.portfolio(lb.num_good(lb.label_good(df, ["algo_p", "algo_q"]), ["good_p", "good_q"]), ["algo_p", "algo_q"])
    got = {r["instance"]: (r["good_p"], r["good_q"], r["beta_easy"], r["best_algo"]) for r in out.collect()}
    assert got == {"a": (1, 1, 1, 1), "b": (0, 1, 0, 2), "c": (0, 0, 0, 0), "d": (1, 1, 1, 1)}


def test_performance_transform_matches_its_definition(spark):
    rnd = random.Random(8)
    data = [(f"p{i}", rnd.uniform(1, 9), rnd.uniform(1, 9)) for i in range(60)]
    df = spark.createDataFrame(data, "instance string, algo_p double, algo_q double")
    got = {r["instance"]: (r["algo_p"], r["algo_q"]) for r in lb.performance_transform(df, ["algo_p", "algo_q"], ["instance"]).collect()}
    for col in (1, 2):
        loss = [r[col] / min(r[1:]) - 1 for r in data]
        t = [v - min(loss) + lb.EPS for v in loss]

        def ll(lam):
            ys = [(x ** lam - 1) / lam if lam else math.log(x) for x in t]
            return -len(t) / 2 * math.log(statistics.pvariance(ys)) + (lam - 1) * sum(map(math.log, t))

        lo, hi = -3.0, 3.0
        for _ in range(80):  # the likelihood has one peak
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if ll(a) < ll(b) else (lo, b)
        ys = [(x ** lo - 1) / lo for x in t]
        mu, sd = statistics.fmean(ys), statistics.stdev(ys)
        for r, y in zip(data, ys):
            assert got[r[0]][col - 1] == pytest.approx((y - mu) / sd, abs=1e-4)
