"""Footprints from points against a direct calculation."""

import math
import random

import pytest

from probscape.functions import labels as lb
from probscape.operators import footprints as fp
from probscape.operators import geometry as gm


def cloud(n=500, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = rng.choice([(rng.gauss(0, 1), rng.gauss(0, 1)), (rng.gauss(6, 0.7), rng.gauss(2, 1.2)), (rng.uniform(-4, 9), rng.uniform(-4, 6))])
        out.append((x, y, int(x < 2.5), int(rng.random() < 0.5), None))
    return [*out, (float("nan"), 0.0, 1, 1, 1), (None, 1.0, 1, 1, 1)]


SCHEMA = "z_1 double, z_2 double, good_a int, good_b int, good_c int"


def brute(rows, label, purity=0.75):
    """Parts as sets of cells, by repeated merging."""
    pts = [(r[0], r[1], r[2 + label] == 1) for r in rows if r[0] is not None and math.isfinite(r[0])]
    own = [(x, y) for x, y, g in pts if g]
    xs, ys = zip(*own, strict=True)
    k = max(min(math.ceil(len(own) / 20), 50), 3)
    side = math.sqrt((max(xs) - min(xs)) * (max(ys) - min(ys)) * k / (len(own) * math.pi) / 2)
    x0, y0 = min(p[0] for p in pts), min(p[1] for p in pts)
    n, good = {}, {}
    for x, y, g in pts:
        c = (math.floor((x - x0) / side), math.floor((y - y0) / side))
        n[c], good[c] = n.get(c, 0) + 1, good.get(c, 0) + g

    def near(a, b):
        return max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1

    dense = [c for c in n if good[c] and sum(good[d] for d in n if near(c, d)) >= k]
    groups = [{c} for c in dense]
    while True:
        pair = next(((a, b) for a in groups for b in groups if a is not b and any(near(c, d) for c in a for d in b)), None)
        if pair is None:
            break
        groups = [g for g in groups if g is not pair[0] and g is not pair[1]] + [pair[0] | pair[1]]
    groups.sort(key=min)
    parts = [set(g) for g in groups]
    for c in n:
        if good[c] and c not in dense:
            part = next((i for i, g in enumerate(groups) if any(near(c, d) for d in g)), None)
            if part is not None:
                parts[part].add(c)
    kept = [{c for c in p if good[c] >= purity * n[c]} for p in parts]
    return {i + 1: (len(p), len(p) * side * side, sum(n[c] for c in p), sum(good[c] for c in p)) for i, p in enumerate(kept) if p}


@pytest.fixture(scope="module")
def found(spark):
    rows = cloud()
    points = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return rows, points, fp.footprint_cells(points, ["good_a", "good_b", "good_c"]).cache()


def test_parts_against_brute_force(found):
    rows, _, cells = found
    got = {(r["label"], r["part"]): r for r in fp.footprint_parts(cells).collect()}
    want = {(f"good_{c}", part): v for i, c in enumerate("ab") for part, v in brute(rows, i).items()}
    assert got.keys() == want.keys() and len(want) >= 2
    for key, (n, area, points, good) in want.items():
        r = got[key]
        assert (r["cells"], r["points"], r["good"]) == (n, points, good) and r["area"] == pytest.approx(area) and r["purity"] == pytest.approx(good / points)


def test_polygons_hold_the_cells(spark, found):
    rows, points, cells = found
    polygons = fp.footprint_polygons(cells).cache()
    area = {r["poly_id"].split("|")[0]: r["area"] for r in gm.polygon_area(polygons).collect()}
    parts = fp.footprint_parts(cells).groupBy("label").sum("area", "points", "good").collect()
    assert area == {r["label"]: pytest.approx(r["sum(area)"]) for r in parts}
    space = gm.as_polygon(gm.convex_hull(points.where("NOT isnan(z_1)").dropna(subset=["z_1"])))
    finite = points.where("z_1 IS NOT NULL AND NOT isnan(z_1)")
    stats = {r["label"]: r for r in lb.footprint_stats(finite, polygons, ["good_a", "good_b"], space).collect()}
    for r in parts:
        s = stats[r["label"]]
        assert s["density"] * s["area"] == pytest.approx(r["sum(points)"]) and s["purity"] == pytest.approx(r["sum(good)"] / r["sum(points)"])


def test_rings():
    square = {(x, y) for x in range(3) for y in range(3)}
    assert fp.rings({(0, 0)}) == [[(0, 0), (1, 0), (1, 1), (0, 1)]]
    hole = fp.rings(square - {(1, 1)})
    assert sorted(map(len, hole)) == [4, 4]
    assert len(fp.rings({(0, 0), (1, 1)})) == 2
    rng = random.Random(1)
    for _ in range(200):
        cells = {(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 30))}
        area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2 for r in fp.rings(cells))
        assert area == len(cells)


def test_nothing_to_find(spark):
    assert fp.footprint_cells(spark.createDataFrame([], SCHEMA), ["good_a"]).count() == 0
    one = spark.createDataFrame([(1.0, 1.0, 1, 0, 0), (2.0, 2.0, 0, 0, 0)], SCHEMA)
    cells = fp.footprint_cells(one, ["good_a", "good_b"])
    assert cells.count() == 0 and fp.footprint_polygons(cells).count() == 0 and fp.footprint_parts(cells).count() == 0
