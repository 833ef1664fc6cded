"""Planar geometry on tables: polygons, hulls, grids and tests against them.

A polygon is ``(poly_id, part_id, seq, z_1, z_2)``; parts may be closed or open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probscape.common import DataError, MODEL_ROWS, as_model, cut, fits

PART = ["poly_id", "part_id"]


def as_polygon(vertices: DataFrame, poly_id: str = "p", order: str = "seq") -> DataFrame:
    """One single-part polygon from ordered vertices."""
    return vertices.select(
        F.lit(poly_id).alias("poly_id"), F.lit(1).alias("part_id"), F.col(order).alias("seq"), "z_1", "z_2"
    )


def split_parts(rows: DataFrame, order: str = "seq", poly_id: str = "poly_id") -> DataFrame:
    """Number the parts of outlines whose parts are separated by rows without coordinates."""
    gap = F.col("z_1").isNull() | F.isnan("z_1")
    so_far = Window.partitionBy(poly_id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("part_id", 1 + F.sum(F.when(gap, 1).otherwise(0)).over(so_far))
    return numbered.where(~gap)


def polygon_edges(polygon: DataFrame) -> DataFrame:
    """Directed edges ``(poly_id, part_id, seq, ax, ay, bx, by)``, the last vertex joined to the first."""
    ring = Window.partitionBy(*PART).orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def nxt(c):
        return F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))

    return polygon.select(
        *PART, "seq", F.col("z_1").alias("ax"), F.col("z_2").alias("ay"),
        nxt("z_1").alias("bx"), nxt("z_2").alias("by"),
    )


def _edge_arrays(polygon: DataFrame) -> DataFrame:
    """One row per polygon with its edges; only for polygons checked to be model-sized."""
    return polygon_edges(polygon).groupBy("poly_id").agg(
        F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"),
        F.count(F.lit(1)).alias("n_edges"),
    )


def _crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Does the ray from (x, y) to the right cross the edge a–b?"""
    straddles = (by > y) != (ay > y)
    # the guard keeps horizontal edges, which never straddle, away from the division
    at = (ax - bx) * (y - by) / F.when(ay != by, ay - by) + bx
    return straddles & F.coalesce(x < at, F.lit(False))


def _on_edge(x, y, ax, ay, bx, by, tol=1e-12):
    area = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    within = (
        (x >= F.least(ax, bx) - tol) & (x <= F.greatest(ax, bx) + tol)
        & (y >= F.least(ay, by) - tol) & (y <= F.greatest(ay, by) + tol)
    )
    return (F.abs(area) <= tol) & within


def point_in_polygon(
    points: DataFrame, polygon: DataFrame, out: str = "inside", boundary: bool = False,
    max_edges: int = MODEL_ROWS, bands: int = 1024,
) -> DataFrame:
    """Even-odd test of every point against the polygon of its ``poly_id``.

    Model-sized polygons travel as one array per polygon, so points are neither shuffled
    nor multiplied.  Beyond ``max_edges`` both sides meet on (polygon, horizontal band):
    a point is compared with the edges of its band only.  ``boundary`` counts points on
    an edge as inside.
    """
    x, y = F.col("z_1"), F.col("z_2")

    def hits(e):
        return _crosses(x, y, e["ax"], e["ay"], e["bx"], e["by"])

    local = as_model(polygon, max_edges)
    if local is not None:
        joined = points.join(F.broadcast(_edge_arrays(local)), "poly_id", "left")
        odd = F.aggregate("edges", F.lit(0), lambda a, e: a + hits(e).cast("int")) % 2 == 1
        inside = F.coalesce((F.col("n_edges") >= 3) & odd, F.lit(False))
        if boundary:
            touch = F.exists("edges", lambda e: _on_edge(x, y, e["ax"], e["ay"], e["bx"], e["by"]))
            inside = inside | F.coalesce(touch, F.lit(False))
        return joined.select(*points.columns, inside.alias(out))

    edges = polygon_edges(polygon)
    span = polygon.groupBy("poly_id").agg(
        F.min("z_2").alias("y0"), F.max("z_2").alias("y1"), F.count(F.lit(1)).alias("n_edges")
    )
    height = F.greatest((F.col("y1") - F.col("y0")) / bands, F.lit(1e-300))

    def band(v):
        return F.least(F.lit(bands - 1), F.floor((v - F.col("y0")) / height)).cast("int")

    tiled = edges.join(F.broadcast(span) if fits(span, MODEL_ROWS) else span, "poly_id").withColumn(
        "band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by"))))
    ).select("poly_id", "band", "ax", "ay", "bx", "by")
    # cut, so that a point has the same number on both sides of the last join
    keyed = cut(points.withColumn("__pt", F.monotonically_increasing_id()))
    touch = _on_edge(x, y, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    placed = keyed.join(span, "poly_id").where((y >= F.col("y0")) & (y <= F.col("y1"))).select(
        "__pt", "poly_id", "z_1", "z_2", band(y).alias("band"), "n_edges"
    )
    tests = placed.join(tiled, ["poly_id", "band"]).groupBy("__pt").agg(
        (F.sum(_crosses(x, y, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).cast("int")) % 2 == 1).alias("odd"),
        F.bool_or(touch).alias("touch"), F.first("n_edges").alias("n_edges"),
    )
    inside = (F.col("n_edges") >= 3) & F.col("odd")
    if boundary:
        inside = inside | F.col("touch")
    return keyed.join(tests, "__pt", "left").select(
        *points.columns, F.coalesce(inside, F.lit(False)).alias(out)
    )


def dist_to_boundary(points: DataFrame, polygon: DataFrame, out: str = "boundary_distance") -> DataFrame:
    """Least distance from a point to the segments of its (model-sized) polygon."""
    local = as_model(polygon)
    if local is None:
        raise DataError("the polygon is not model-sized")
    x, y = F.col("z_1"), F.col("z_2")

    def sq(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        len2 = dx * dx + dy * dy
        # Fixed value: edges shorter than 1e-12 count as their first vertex
        t = F.when(len2 < 1e-24, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, len2)))
        )
        ex, ey = x - (e["ax"] + t * dx), y - (e["ay"] + t * dy)
        return ex * ex + ey * ey

    joined = points.join(F.broadcast(_edge_arrays(local)), "poly_id", "left")
    return joined.select(*points.columns, F.sqrt(F.array_min(F.transform("edges", sq))).alias(out))


def polygon_area(polygon: DataFrame) -> DataFrame:
    """Shoelace area per polygon; parts of opposite direction (holes) subtract."""
    e = polygon_edges(polygon)
    return e.groupBy("poly_id").agg(
        F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area")
    )


# -------------------------------------------------------------------------------- hull


def _hull_of(pts):
    """Extreme points of sorted distinct points, counter-clockwise from the leftmost."""
    def half(run):
        out = []
        for p in run:
            while len(out) > 1:
                (ox, oy), (ax, ay) = out[-2], out[-1]
                if (ax - ox) * (p[1] - oy) - (ay - oy) * (p[0] - ox) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1]) if len(pts) > 1 else list(pts)


def convex_hull(points: DataFrame, by: str | None = None, salts: int = 32) -> DataFrame:
    """Convex hull ``([by,] seq, z_1, z_2)``, counter-clockwise, collinear points dropped.

    Each partition keeps the hull of what it has read; the survivors are merged in two
    steps, first by salt.  No task ever holds more than hull candidates.
    """
    group = by or "__all"
    src = points if by else points.withColumn("__all", F.lit(0))
    src = src.select(group, F.col("z_1").cast("double").alias("z_1"), F.col("z_2").cast("double").alias("z_2")).dropna()
    kind = src.schema[group].dataType
    schema = T.StructType([T.StructField(group, kind), T.StructField("z_1", T.DoubleType()), T.StructField("z_2", T.DoubleType())])

    def partial(batches):
        import pandas as pd

        best: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby(group, sort=False):
                fresh = set(zip(part["z_1"].tolist(), part["z_2"].tolist()))
                best[g] = _hull_of(sorted(fresh.union(best.get(g, ()))))
        for g, hull in best.items():
            yield pd.DataFrame([(g, a, b) for a, b in hull], columns=schema.names)

    def merged(pdf):
        import pandas as pd

        hull = _hull_of(sorted(set(zip(pdf["z_1"].tolist(), pdf["z_2"].tolist()))))
        return pd.DataFrame([(pdf[group].iloc[0], a, b) for a, b in hull], columns=schema.names)

    def final(pdf):
        out = merged(pdf)
        out["seq"] = range(len(out))
        return out

    salt = F.pmod(F.hash("z_1", "z_2"), F.lit(salts)).alias("salt")
    some = src.mapInPandas(partial, schema).groupBy(F.col(group), salt).applyInPandas(merged, schema)
    whole = some.groupBy(group).applyInPandas(final, T.StructType([*schema.fields, T.StructField("seq", T.LongType())]))
    return whole.select(*([by] if by else []), "seq", "z_1", "z_2")


def closed_polygon(outline: DataFrame | None, coords: DataFrame) -> DataFrame:
    """Vertices ``(seq, z_1, z_2)`` of the outline, or of the hull, closed by the first one."""
    if outline is not None and outline.take(1):
        ring = outline.select(F.col("seq").cast("bigint").alias("seq"), "z_1", "z_2")
    else:
        ring = convex_hull(coords)
    ends = ring.agg(
        F.min_by(F.struct("z_1", "z_2"), "seq").alias("a"), F.max_by(F.struct("z_1", "z_2"), "seq").alias("z"),
        F.max("seq").alias("last"),
    )
    closing = ends.where("a <> z").select((F.col("last") + 1).alias("seq"), F.col("a.z_1").alias("z_1"), F.col("a.z_2").alias("z_2"))
    return ring.unionByName(closing)


# -------------------------------------------------------------------------------- grid


def bounding_box(points: DataFrame) -> tuple[float, float, float, float]:
    """min z_1, max z_1, min z_2, max z_2 — one row of aggregates."""
    row = points.agg(F.min("z_1"), F.max("z_1"), F.min("z_2"), F.max("z_2")).first()
    if row[0] is None:
        raise DataError("no points")
    return tuple(row)


def padded(box: Sequence[float], padding: float) -> tuple[float, float, float, float]:
    x0, x1, y0, y1 = box
    if x1 == x0 or y1 == y0:
        raise DataError("the coordinates are degenerate: no extent along one axis")
    px, py = (x1 - x0) * padding, (y1 - y0) * padding
    return x0 - px, x1 + px, y0 - py, y1 + py


def make_grid(spark, box: Sequence[float], k: int) -> DataFrame:
    """k × k points ``(i, j, z_1, z_2)`` over the box, ends included."""
    if k < 2:
        raise DataError("a grid needs at least 2 points per axis")
    x0, x1, y0, y1 = box
    dx, dy = (x1 - x0) / (k - 1), (y1 - y0) / (k - 1)
    return spark.range(k * k).select(
        F.expr(f"cast(id div {k} AS int)").alias("i"), F.expr(f"cast(id % {k} AS int)").alias("j")
    ).select("i", "j", (F.lit(x0) + F.col("i") * dx).alias("z_1"), (F.lit(y0) + F.col("j") * dy).alias("z_2"))
