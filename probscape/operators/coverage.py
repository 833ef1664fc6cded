"""Empty regions of the space, coverage, and the selection of generated candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probscape.common import DataError, collect_model, finite, keep
from probscape.operators.geometry import (
    as_polygon,
    bounding_box,
    closed_polygon,
    convex_hull,
    dist_to_boundary,
    make_grid,
    padded,
    point_in_polygon,
)
from probscape.operators.nearest import nearest_distance

# Grid per axis, targets, padding and separation shares, border margin share.
GRID, TOP_K, PADDING, SEPARATION, BORDER = 80, 10, 0.05, 0.12, 0.04


def empty_space_candidates(
    points: DataFrame, grid_size: int = GRID, padding: float = PADDING, inside_hull: bool = True,
    box: Sequence[float] | None = None,
) -> DataFrame:
    """Grid positions with the distance to their closest instance, emptiest first.

    The grid is at most ``grid_size``² rows; the instances are reduced to it, not paired.
    """
    spark = points.sparkSession
    points = points.where(finite(F.col("z_1")) & finite(F.col("z_2")))
    grid = make_grid(spark, padded(box or bounding_box(points), padding), grid_size)
    if inside_hull:
        hull = as_polygon(convex_hull(points))
        grid = point_in_polygon(grid.withColumn("poly_id", F.lit("p")), hull).where("inside").drop("poly_id", "inside")
    return nearest_distance(grid, points).orderBy(F.desc("nearest_instance_distance"), "i", "j")


def select_targets(
    candidates: DataFrame, top_k: int, min_separation: float, grid_size: int | None = None
) -> DataFrame:
    """Greedy choice in candidate order, each at least ``min_separation`` from all before it.

    The choice is sequential by nature: ``top_k`` rounds, each of which takes the first position
    left and drops what lies too close to it. Positions without a distance are never chosen.
    """
    cols = ["i", "j", "z_1", "z_2", "nearest_instance_distance"]
    left = keep(candidates.select(*cols).where("nearest_instance_distance IS NOT NULL"))
    chosen: list = []
    far = F.lit(True)
    while len(chosen) < top_k:
        first = left.where(far).orderBy(F.desc("nearest_instance_distance"), "i", "j").first()
        if first is None:
            break
        chosen.append(first)
        far = far & (F.hypot(F.col("z_1") - first["z_1"], F.col("z_2") - first["z_2"]) >= min_separation)
    left.unpersist()
    spark = candidates.sparkSession
    return spark.createDataFrame(
        [
            (f"empty_space_{n:03d}", c["z_1"], c["z_2"], c["nearest_instance_distance"], grid_size, float(min_separation))
            for n, c in enumerate(chosen, 1)
        ],
        "target_id string, z_1 double, z_2 double, nearest_instance_distance double, grid_size int, min_separation double",
    )


def separation(box: Sequence[float], padding: float = PADDING, share: float = SEPARATION) -> float:
    x0, x1, y0, y1 = padded(box, padding)
    return math.dist((x0, y0), (x1, y1)) * share


def find_empty_space(
    points: DataFrame, grid_size: int = GRID, top_k: int = TOP_K, padding: float = PADDING,
    separation_share: float = SEPARATION, inside_hull: bool = True,
) -> DataFrame:
    """The centres of the emptiest regions."""
    points = points.where(finite(F.col("z_1")) & finite(F.col("z_2")))
    box = bounding_box(points)
    cand = empty_space_candidates(points, grid_size, padding, inside_hull, box)
    return select_targets(cand, top_k, separation(box, padding, separation_share), grid_size)


def farthest_point(coords: DataFrame, outline: DataFrame | None = None, grid_size: int = GRID) -> DataFrame:
    """The grid position inside the outline, away from its border, farthest from any instance.

    The border margin is given up if nothing is left inside it.  First grid position on ties.
    """
    spark = coords.sparkSession
    ring = spark.createDataFrame(
        collect_model(closed_polygon(outline, coords), "the outline"), "seq bigint, z_1 double, z_2 double"
    )
    if not ring.limit(4).count() == 4:
        raise DataError("the outline has fewer than three corners")
    x0, x1, y0, y1 = bounding_box(ring)
    margin = BORDER * math.hypot(x1 - x0, y1 - y0)
    polygon = as_polygon(ring)
    grid = make_grid(spark, (x0, x1, y0, y1), grid_size).withColumn("poly_id", F.lit("p"))
    inside = point_in_polygon(grid, polygon).where("inside")
    tested = keep(dist_to_boundary(inside, polygon).select("i", "j", "z_1", "z_2", "boundary_distance"))
    clear = tested.where(F.col("boundary_distance") >= margin)
    pool = clear if clear.take(1) else tested
    if not pool.take(1):
        raise DataError("no grid position lies inside the outline")
    far = nearest_distance(pool.select("i", "j", "z_1", "z_2"), coords)
    best = F.max_by(
        F.struct("z_1", "z_2", "nearest_instance_distance"), F.struct("nearest_instance_distance", -F.col("i"), -F.col("j"))
    )
    return far.agg(best.alias("b")).select("b.*")


def coverage_report(
    coords: DataFrame, outline: DataFrame | None, threshold: float, grid_size: int = GRID
) -> DataFrame:
    """Largest empty distance left, and whether it is within the threshold."""
    return farthest_point(coords, outline, grid_size).select(
        "z_1", "z_2", F.col("nearest_instance_distance").alias("final_nearest_instance_distance"),
        (F.col("nearest_instance_distance") <= threshold).alias("threshold_reached"),
    )


# -------------------------------------------------------------------------- candidates

# Constant and proportional penalty outside the outline.
OUTSIDE_CONST, OUTSIDE_SHARE = 10.0, 5.0


def score_candidates(projected: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Distance from ``(z_1, z_2)`` to ``(target_z_1, target_z_2)`` as ``fitness``.

    With an outline polygon (``poly_id`` in both tables) positions outside it are penalised
    beyond any position inside.
    """
    dx, dy = F.col("z_1") - F.col("target_z_1"), F.col("z_2") - F.col("target_z_2")
    scored = projected.withColumn("fitness", F.sqrt(dx * dx + dy * dy))
    if outline is None:
        return scored
    tested = point_in_polygon(scored, outline, "__in")
    f = F.col("fitness")
    return tested.withColumn(
        "fitness", F.when(F.col("__in"), f).otherwise(f + OUTSIDE_CONST + OUTSIDE_SHARE * f)
    ).drop("__in")


def survivors(scored: DataFrame, mu: int, target: str = "target_id", key: str = "instances") -> DataFrame:
    """The best ``mu`` candidates of every target; the limit applies before the shuffle."""
    order = Window.partitionBy(target).orderBy("fitness", key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= mu)


def reject_outside(results: DataFrame, outline: DataFrame) -> DataFrame:
    return point_in_polygon(results, outline, "__in").where("__in").drop("__in")
