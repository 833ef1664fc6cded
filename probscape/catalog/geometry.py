"""Hulls, grids, empty regions, nearest neighbours and candidate selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from probscape import adapters as ad
from probscape.catalog.base import query
from probscape.operators import coverage as cv
from probscape.operators import geometry as gm
from probscape.operators import nearest as nn
from probscape.sources import tables

C = (ad.POINTS,)


def pts(spark, sf_dir):
    return ad.points(spark, sf_dir)


# The hull by definition: a directed pair is an edge if no point is to its right, and every
# point on its line lies between its ends.
_HULL = """
dp AS (SELECT DISTINCT {g} AS g, z_1 AS x, z_2 AS y FROM points),
edge AS (SELECT a.g, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM dp a JOIN dp b ON a.g = b.g AND (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM dp c WHERE c.g = a.g AND (
    (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))
"""
HULL, LABEL_HULL = _HULL.format(g="0"), _HULL.format(g="label")


def _inside(x, y, g=None):
    """Even-odd count over the edges of group ``g``."""
    where = f"edge.g = {g} AND " if g else ""
    return (
        f"(SELECT count(*) % 2 = 1 FROM edge WHERE {where}(ay > {y}) <> (\"by\" > {y}) "
        f"AND {x} < (ax - bx) * ({y} - \"by\") / (ay - \"by\") + bx)"
    )


@query("g1_convex_hull", "SELECT ax AS z_1, ay AS z_2 FROM edge", (ad.POINTS, HULL), "z_1 z_2")
def g1(spark, sf_dir):
    return gm.convex_hull(pts(spark, sf_dir)).select("z_1", "z_2")


@query("g1_convex_hull_by_group", "SELECT g AS label, ax AS z_1, ay AS z_2 FROM edge", (ad.POINTS, LABEL_HULL), "z_1 z_2")
def g1_by(spark, sf_dir):
    return gm.convex_hull(pts(spark, sf_dir), "label").select("label", "z_1", "z_2")


def _label_polygons(df):
    return gm.convex_hull(df, "label").select(
        F.col("label").cast("string").alias("poly_id"), F.lit(1).alias("part_id"), "seq", "z_1", "z_2"
    )


def _other_label(df, labels):
    return df.withColumn("poly_id", ((F.col("label") + 1) % labels).cast("string"))


_NL = "(SELECT max(label) + 1 FROM points)"
_J10 = f"SELECT instance, {_inside('p.z_1', 'p.z_2', f'((p.label + 1) % {_NL})')} AS inside FROM points p"


@query("j10_point_in_polygon", _J10, (ad.POINTS, LABEL_HULL))
def j10(spark, sf_dir):
    df = pts(spark, sf_dir)
    n = df.agg(F.max("label")).first()[0] + 1
    return gm.point_in_polygon(_other_label(df, n), _label_polygons(df)).select("instance", "inside")


@query("j10_point_in_polygon_by_bands", _J10, (ad.POINTS, LABEL_HULL))
def j10_bands(spark, sf_dir):
    """The same for polygons too large for one array."""
    df = pts(spark, sf_dir)
    n = df.agg(F.max("label")).first()[0] + 1
    return gm.point_in_polygon(_other_label(df, n), _label_polygons(df), max_edges=0).select("instance", "inside")


def _grid(k, pad, src="points"):
    return f"""
box AS (SELECT min(z_1) - {pad} * (max(z_1) - min(z_1)) AS x0, max(z_1) + {pad} * (max(z_1) - min(z_1)) AS x1,
               min(z_2) - {pad} * (max(z_2) - min(z_2)) AS y0, max(z_2) + {pad} * (max(z_2) - min(z_2)) AS y1 FROM {src}),
grid AS (SELECT (id // {k})::INT AS i, (id % {k})::INT AS j, x0 + (id // {k}) * ((x1 - x0) / {k - 1}) AS z_1,
                y0 + (id % {k}) * ((y1 - y0) / {k - 1}) AS z_2 FROM box, range({k * k}) AS r(id))
"""


_K, _PAD = 80, "0.05::DOUBLE"
GRID = _grid(_K, _PAD)
NEAR = "(SELECT min(sqrt((g.z_1 - p.z_1) * (g.z_1 - p.z_1) + (g.z_2 - p.z_2) * (g.z_2 - p.z_2))) FROM points p)"


@query("g2_make_grid", "SELECT * FROM grid", (ad.POINTS, GRID), "z_1 z_2")
def g2(spark, sf_dir):
    return gm.make_grid(spark, gm.padded(gm.bounding_box(pts(spark, sf_dir)), 0.05), _K)


_J11 = f"SELECT i, j, {NEAR} AS nearest_instance_distance FROM grid g"


@query("j11_nearest_distance", _J11, (ad.POINTS, GRID), "nearest_instance_distance")
def j11(spark, sf_dir):
    df = pts(spark, sf_dir)
    grid = gm.make_grid(spark, gm.padded(gm.bounding_box(df), 0.05), _K)
    return nn.nearest_distance(grid, df).select("i", "j", "nearest_instance_distance")


@query("j11_nearest_distance_by_descent", _J11, (ad.POINTS, GRID), "nearest_instance_distance")
def j11_descent(spark, sf_dir):
    """The same with two levels more than are sent to tasks, the way large corpora take."""
    df = pts(spark, sf_dir)
    grid = gm.make_grid(spark, gm.padded(gm.bounding_box(df), 0.05), _K)
    return nn.nearest_distance(grid, df, levels=6).select("i", "j", "nearest_instance_distance")


_TARGETS = "tgt AS (SELECT label AS target, round(avg(z_1) * 3, 4) AS z_1, round(avg(z_2) * 3, 4) AS z_2 FROM points GROUP BY label)"


def targets(spark, sf_dir):
    return pts(spark, sf_dir).groupBy(F.col("label").alias("target")).agg(
        F.round(F.avg("z_1") * 3, 4).alias("z_1"), F.round(F.avg("z_2") * 3, 4).alias("z_2")
    )


@query(
    "j9_nearest_seed",
    """SELECT target, z_1, z_2, arg_min(instance, (d, instance)) AS seed_instance, min(d) AS seed_distance FROM (
         SELECT t.target, t.z_1, t.z_2, p.instance, sqrt((t.z_1 - p.z_1) * (t.z_1 - p.z_1) + (t.z_2 - p.z_2) * (t.z_2 - p.z_2)) AS d
         FROM tgt t, points p) GROUP BY ALL""",
    (ad.POINTS, _TARGETS), "z_1 z_2 seed_distance",
)
def j9(spark, sf_dir):
    return nn.nearest_seed(targets(spark, sf_dir), pts(spark, sf_dir))


_CAND = f"""cand AS (SELECT i, j, z_1, z_2, {NEAR} AS d FROM grid g WHERE {_inside('g.z_1', 'g.z_2')})"""


@query("g3_empty_space_candidates", "SELECT i, j, z_1, z_2, d AS nearest_instance_distance FROM cand",
       (ad.POINTS, HULL, GRID, _CAND), "z_1 z_2 nearest_instance_distance")
def g3(spark, sf_dir):
    return cv.empty_space_candidates(pts(spark, sf_dir))


# One pick per step; what stays is far enough from it.
_PICK = """
sep AS (SELECT 0.12::DOUBLE * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS s FROM box),
left_over AS (
  SELECT 1 AS step, i, j, z_1, z_2, d FROM cand
  UNION ALL
  SELECT step + 1, i, j, z_1, z_2, d FROM (
    SELECT *, first_value(z_1) OVER w AS px, first_value(z_2) OVER w AS py FROM left_over WHERE step < 10 WINDOW w AS (ORDER BY d DESC, i, j))
  WHERE sqrt((z_1 - px) * (z_1 - px) + (z_2 - py) * (z_2 - py)) >= (SELECT s FROM sep)),
picked AS (SELECT * FROM left_over QUALIFY row_number() OVER (PARTITION BY step ORDER BY d DESC, i, j) = 1)
"""
_PICKED = """SELECT 'empty_space_' || lpad(step::VARCHAR, 3, '0') AS target_id, z_1, z_2, d AS nearest_instance_distance,
  80 AS grid_size, (SELECT s FROM sep) AS min_separation FROM picked"""
_PICK_D = "z_1 z_2 nearest_instance_distance min_separation"


@query("g4_select_targets", _PICKED, (ad.POINTS, HULL, GRID, _CAND, _PICK), _PICK_D)
def g4(spark, sf_dir):
    return cv.find_empty_space(pts(spark, sf_dir))


@query("s12_write_targets", _PICKED, (ad.POINTS, HULL, GRID, _CAND, _PICK), _PICK_D)
def s12(spark, sf_dir):
    """Written as CSV and JSON; the result is read back from the JSON payload."""
    df = pts(spark, sf_dir)
    found, path = cv.find_empty_space(df), tables.shared_path(spark, "targets")
    x0, x1, y0, y1 = gm.padded(gm.bounding_box(df), 0.05)
    tables.write_targets(
        found, path, {"method": "grid_maximin_nearest_instance_distance", "grid_size": 80, "top_k": 10},
        {"min_z_1": x0, "max_z_1": x1, "min_z_2": y0, "max_z_2": y1},
    )
    doc = spark.read.text(f"{path}/json").select(
        F.explode(F.from_json(F.get_json_object("value", "$.targets"), found.schema.simpleString().join(["array<", ">"]))).alias("t")
    )
    return doc.select("t.*")


_EDGE_DIST = """(SELECT min(sqrt(power(p.z_1 - (ax + t * (bx - ax)), 2) + power(p.z_2 - (ay + t * ("by" - ay)), 2))) FROM (
   SELECT ax, ay, bx, "by", greatest(0, least(1, ((p.z_1 - ax) * (bx - ax) + (p.z_2 - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) AS t FROM edge))"""


@query("g5_dist_to_boundary", f"SELECT instance, {_EDGE_DIST} AS boundary_distance FROM points p", (ad.POINTS, HULL), "boundary_distance")
def g5(spark, sf_dir):
    df = pts(spark, sf_dir)
    hull = gm.as_polygon(gm.convex_hull(df))
    return gm.dist_to_boundary(df.withColumn("poly_id", F.lit("p")), hull).select("instance", "boundary_distance")


_FAR = f"""
hullbox AS (SELECT min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edge),
inn AS (SELECT i, j, z_1, z_2, {_EDGE_DIST} AS bd FROM grid p WHERE {_inside('p.z_1', 'p.z_2')}),
far AS (SELECT i, j, z_1, z_2, {NEAR} AS d FROM inn g
        WHERE bd >= 0.04::DOUBLE * (SELECT sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) FROM hullbox)),
top AS (SELECT z_1, z_2, d FROM far ORDER BY d DESC, i, j LIMIT 1)
"""
_FAR_CTES = (ad.POINTS, HULL, _grid(40, "0.0::DOUBLE"), _FAR)


@query("g6_farthest_point", "SELECT z_1, z_2, d AS nearest_instance_distance FROM top", _FAR_CTES, "z_1 z_2 nearest_instance_distance")
def g6(spark, sf_dir):
    return cv.farthest_point(pts(spark, sf_dir), None, 40)


@query(
    "g7_closed_polygon",
    "SELECT ax AS z_1, ay AS z_2 FROM edge UNION ALL (SELECT ax, ay FROM edge ORDER BY ax, ay LIMIT 1)",
    (ad.POINTS, HULL), "z_1 z_2",
)
def g7(spark, sf_dir):
    return gm.closed_polygon(None, pts(spark, sf_dir)).select("z_1", "z_2")


@query(
    "g8_coverage_report",
    "SELECT z_1, z_2, d AS final_nearest_instance_distance, d <= 0.05 AS threshold_reached FROM top", _FAR_CTES,
    "z_1 z_2 final_nearest_instance_distance",
)
def g8(spark, sf_dir):
    return cv.coverage_report(pts(spark, sf_dir), None, 0.05, 40)


_SCORE = f"""
scored AS (SELECT instance, target_id, CASE WHEN inside THEN f ELSE f + 10 + 5 * f END AS fitness FROM (
  SELECT p.instance, 't' || t.target AS target_id, sqrt(power(p.z_1 - t.z_1, 2) + power(p.z_2 - t.z_2, 2)) AS f,
         {_inside('p.z_1', 'p.z_2', '0')} AS inside
  FROM points p JOIN tgt t ON t.target = p.label))
"""
_SCORE_CTES = (ad.POINTS, LABEL_HULL, _TARGETS, _SCORE)


def _scored(spark, sf_dir):
    df = pts(spark, sf_dir)
    goal = targets(spark, sf_dir).select(
        F.col("target").alias("label"), F.concat(F.lit("t"), F.col("target").cast("string")).alias("target_id"),
        F.col("z_1").alias("target_z_1"), F.col("z_2").alias("target_z_2"),
    )
    outline = gm.as_polygon(gm.convex_hull(df.where("label = 0")))
    projected = df.join(goal, "label").select(
        "instance", "target_id", "z_1", "z_2", "target_z_1", "target_z_2", F.lit("p").alias("poly_id")
    )
    return cv.score_candidates(projected, outline), outline


@query("g9_score_candidates", "SELECT instance, target_id, fitness FROM scored", _SCORE_CTES, "fitness")
def g9(spark, sf_dir):
    return _scored(spark, sf_dir)[0].select("instance", "target_id", "fitness")


@query(
    "g10_survivors",
    """SELECT instance, target_id, fitness, rn::INT AS place FROM (
         SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY fitness, instance) AS rn FROM scored) WHERE rn <= 10""",
    _SCORE_CTES, "fitness",
)
def g10(spark, sf_dir):
    return cv.survivors(_scored(spark, sf_dir)[0], 10, key="instance").select("instance", "target_id", "fitness", "place")


@query(
    "g11_reject_outside", f"SELECT instance, z_1, z_2 FROM points p WHERE {_inside('p.z_1', 'p.z_2', '0')}",
    (ad.POINTS, LABEL_HULL), "z_1 z_2",
)
def g11(spark, sf_dir):
    df = pts(spark, sf_dir)
    outline = gm.as_polygon(gm.convex_hull(df.where("label = 0")))
    return cv.reject_outside(df.withColumn("poly_id", F.lit("p")), outline).select("instance", "z_1", "z_2")
