"""Exact nearest neighbours in the plane without pairing everything with everything.

Points are summarised in a grid hierarchy (each level splits a cell into 4 × 4): the number
of points in a cell and their actual bounding box.  A query descends the levels keeping
only cells that can still hold one of its k nearest points: those no farther than a bound
that other cells already guarantee.  That leaves a handful of cells per query, whose points
are then compared.  The upper levels, at most 16**4 cells, go to every task, which descends them
for its own queries without a shuffle; deeper levels are equi-joins and windows.  Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probscape.common import DataError, finite, keep

#: Bits per axis and level, and the deepest grid.
_BITS, _MAX_LEVELS = 2, 12
#: Upper levels that are sent to every task: 16**4 cells at most.
_SENT_LEVELS = 4
#: Groups that may be kept apart: a cell has a count for each.
_MOST_GROUPS = 64
_SLACK = 1 + 1e-9
#: Queries that a task descends with at a time.
_LOT = 4096


def _near2(x: Column, y: Column) -> Column:
    """Squared distance from (x, y) to the cell's bounding box."""
    zero = F.lit(0.0)
    dx = F.greatest(F.col("x0") - x, zero, x - F.col("x1"))
    dy = F.greatest(F.col("y0") - y, zero, y - F.col("y1"))
    return dx * dx + dy * dy


def _far2(x: Column, y: Column) -> Column:
    """Squared distance from (x, y) to the farthest corner of the cell's bounding box."""
    dx = F.greatest(F.abs(x - F.col("x0")), F.abs(x - F.col("x1")))
    dy = F.greatest(F.abs(y - F.col("y0")), F.abs(y - F.col("y1")))
    return dx * dx + dy * dy


def nearest_k(
    queries: DataFrame, points: DataFrame, k: int = 1, pid: str = "instance", apart: str | None = None, levels: int | None = None,
) -> DataFrame:
    """The k nearest points of every distinct query position, ties by ``pid``.

    Returns ``([apart], z_1, z_2, rank, pid, distance)`` per distinct ``([apart], z_1, z_2)`` of
    ``queries``; a query never meets points of its own ``apart``, of which there may be 64 values.
    Points and queries with a null, NaN or infinite coordinate have no neighbours.
    """
    group = [apart] if apart else []
    placed = finite(F.col("z_1").cast("double")) & finite(F.col("z_2").cast("double"))
    doubles = [F.col(c).cast("double").alias(c) for c in ("z_1", "z_2")]
    spots = queries.where(placed).select(*group, *doubles).distinct()
    pts = points.where(placed).select(*[F.col(c).alias("own") for c in group], F.col(pid).alias("pid"), F.col("z_1").cast("double").alias("px"), F.col("z_2").cast("double").alias("py"))
    own = ["own"] if apart else []
    if k > 1:
        # of points in one place only the first k can matter; the limit applies before the shuffle
        same = Window.partitionBy(*own, "px", "py").orderBy("pid")
        pts = pts.withColumn("same", F.row_number().over(same)).where(F.col("same") <= k).drop("same")
    else:
        pts = pts.groupBy(*own, "px", "py").agg(F.min("pid").alias("pid"))
    return _descend(spots, pts, k, group, levels).withColumnRenamed("pid", pid)


def _descend(spots: DataFrame, pts: DataFrame, k: int, group: list[str], levels: int | None) -> DataFrame:
    x, y = F.col("z_1"), F.col("z_2")
    q_key = [*group, "z_1", "z_2"]
    pts = keep(pts)
    names = F.collect_set("own") if group else F.array()
    ext = pts.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count(F.lit(1)), names).first()
    groups = sorted(ext[5])
    if len(groups) > _MOST_GROUPS:
        raise DataError(f"more than {_MOST_GROUPS} groups of points to keep apart")
    if levels is None:
        n_q = max(spots.count(), 1)
        # deep enough for up to 16 points per cell, or — with few queries — for cells
        # so small that the few a query opens hold a negligible share of the points
        levels = math.ceil(math.log(16 * n_q, 16))
        levels = min(levels, math.ceil(math.log(max(ext[4] / 16, 2), 16)))
    levels = max(1, min(levels, _MAX_LEVELS))
    cells = 1 << (_BITS * levels)
    if not ext[4]:
        ext = (0.0, 1.0, 0.0, 1.0, 0)
    wx, wy = max(ext[1] - ext[0], 1e-300), max(ext[3] - ext[2], 1e-300)

    def slot(v, lo, w):
        return F.least(F.lit(cells - 1), F.floor((v - lo) / w * cells)).cast("int")

    placed = pts.withColumns({"ix": slot(F.col("px"), ext[0], wx), "iy": slot(F.col("py"), ext[2], wy)})
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    counts = [f"n{i}" for i in range(len(groups))]
    finest = placed.groupBy("ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"),
        *[F.count_if(F.col("own") == g).alias(c) for c, g in zip(counts, groups, strict=True)])
    sent = min(levels, _SENT_LEVELS)
    summary = {levels: keep(finest) if levels > sent else finest}
    for level in range(levels - 1, sent - 1, -1):
        up = summary[level + 1].withColumns({"ix": F.shiftright("ix", _BITS), "iy": F.shiftright("iy", _BITS)})
        summary[level] = up.groupBy("ix", "iy").agg(F.sum("n").alias("n"), *box, *[F.sum(c).alias(c) for c in counts])

    top = _Top(summary[sent].toArrow(), sent, k, groups, counts)
    schema = T.StructType([*spots.schema.fields, T.StructField("cx", T.IntegerType()), T.StructField("cy", T.IntegerType())])
    pairs = spots.mapInArrow(top, schema)
    for level in range(sent + 1, levels + 1):
        child = summary[level].withColumns({"cx": F.shiftright("ix", _BITS), "cy": F.shiftright("iy", _BITS)})
        met = pairs.join(child, ["cx", "cy"]).withColumns({"near2": _near2(x, y), "far2": _far2(x, y)})
        if group:
            usable = F.col("n")
            for g, c in zip(groups, counts, strict=True):
                usable = F.when(F.col(group[0]) == g, F.col("n") - F.col(c)).otherwise(usable)
            met = met.withColumn("n", usable).where("n > 0")
        if k == 1:
            bound = F.min("far2").over(Window.partitionBy(*q_key))
        else:
            ordered = Window.partitionBy(*q_key).orderBy("far2", "ix", "iy").rowsBetween(Window.unboundedPreceding, 0)
            met = met.withColumn("cum", F.sum("n").over(ordered))
            bound = F.min(F.when(F.col("cum") >= k, F.col("far2"))).over(Window.partitionBy(*q_key))
        met = met.withColumn("bound", bound)
        pairs = met.where(F.col("bound").isNull() | (F.col("near2") <= F.col("bound") * _SLACK)).select(
            *q_key, F.col("ix").alias("cx"), F.col("iy").alias("cy")
        )
    dx, dy = x - F.col("px"), y - F.col("py")
    cand = pairs.join(placed.withColumnsRenamed({"ix": "cx", "iy": "cy"}), ["cx", "cy"])
    if group:
        cand = cand.where(F.col(group[0]) != F.col("own"))
    cand = cand.select(*q_key, "pid", (dx * dx + dy * dy).alias("d2"))
    if k == 1:
        best = cand.groupBy(*q_key).agg(F.min(F.struct("d2", "pid")).alias("b"))
        return best.select(*q_key, F.lit(1).alias("rank"), F.col("b.pid").alias("pid"), F.sqrt("b.d2").alias("distance"))
    order = Window.partitionBy(*q_key).orderBy("d2", "pid")
    return cand.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        *q_key, "rank", "pid", F.sqrt("d2").alias("distance")
    )


class _Top:
    """The upper levels of the hierarchy, and the descent of a task's queries through them."""

    def __init__(self, cells: pa.Table, levels: int, k: int, groups: list, counts: list[str]):
        self.k, self.groups, self.levels = k, groups, []
        code = cells["ix"].to_numpy().astype(np.int64), cells["iy"].to_numpy().astype(np.int64)
        box = [cells[c].to_numpy() for c in ("x0", "x1", "y0", "y1")]
        count = np.column_stack([cells[c].to_numpy() for c in ("n", *counts)]).astype(np.int64)
        for _ in range(levels):
            # cells in the order of their parents, so that a parent's children are one slice
            parent = (code[0] >> _BITS) << 32 | code[1] >> _BITS
            order = np.lexsort((code[1], code[0], parent))
            code, box, count, parent = tuple(c[order] for c in code), [b[order] for b in box], count[order], parent[order]
            parents, first = np.unique(parent, return_index=True)
            self.levels.insert(0, (*code, *box, count, parents, np.append(first, len(parent))))
            code = parents >> 32, parents & 0xFFFFFFFF
            if len(parents):
                box = [f.reduceat(b, first) for f, b in zip((np.minimum, np.maximum, np.minimum, np.maximum), box, strict=True)]
                count = np.add.reduceat(count, first, axis=0)

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _LOT):
                part = batch.slice(at, _LOT)
                if not len(self.levels[0][0]):
                    continue
                own = np.array([self.groups.index(g) if g in self.groups else -1 for g in part.column(0).to_pylist()]) if self.groups else None
                query, cx, cy = self._walk(part.column("z_1").to_numpy(), part.column("z_2").to_numpy(), own)
                taken = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cx, pa.int32()), pa.array(cy, pa.int32())], [*part.schema.names, "cx", "cy"])

    def _walk(self, x: np.ndarray, y: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, px, py = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for ix, iy, x0, x1, y0, y1, count, parents, first in self.levels:
            slot = np.searchsorted(parents, px << 32 | py)
            size = first[slot + 1] - first[slot]
            query = np.repeat(query, size)
            cell = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[slot], size)
            n = count[cell, 0]
            if own is not None:
                mine = own[query]
                n = n - np.where(mine >= 0, count[cell, mine + 1], 0)
                query, cell, n = query[n > 0], cell[n > 0], n[n > 0]
            qx, qy = x[query], y[query]
            near = np.maximum(np.maximum(x0[cell] - qx, qx - x1[cell]), 0) ** 2 + np.maximum(np.maximum(y0[cell] - qy, qy - y1[cell]), 0) ** 2
            far = np.maximum(np.abs(qx - x0[cell]), np.abs(qx - x1[cell])) ** 2 + np.maximum(np.abs(qy - y0[cell]), np.abs(qy - y1[cell])) ** 2
            bound = np.full(len(x), np.inf)
            if self.k == 1:
                np.minimum.at(bound, query, far)
            else:
                order = np.lexsort((far, query))
                total, q = np.cumsum(n[order]), query[order]
                start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
                before = np.repeat((total - n[order])[start], np.diff(np.append(start, len(q))))
                enough = total - before >= self.k
                np.minimum.at(bound, q[enough], far[order][enough])
            stay = near <= bound[query] * _SLACK
            query, px, py = query[stay], ix[cell[stay]], iy[cell[stay]]
        return query, px, py


def nearest_distance(grid: DataFrame, points: DataFrame, out: str = "nearest_instance_distance", **how) -> DataFrame:
    """Distance from every grid position to the closest point."""
    ids = points.select(F.lit(0).alias("instance"), "z_1", "z_2")
    found = nearest_k(grid, ids, 1, **how).select("z_1", "z_2", F.col("distance").alias(out))
    return grid.join(found, ["z_1", "z_2"], "left")


def nearest_seed(targets: DataFrame, coords: DataFrame, key: str = "instance", **how) -> DataFrame:
    """The closest instance of every target, the smallest name on ties."""
    found = nearest_k(targets, coords, 1, pid=key, **how).select(
        "z_1", "z_2", F.col(key).alias("seed_instance"), F.col("distance").alias("seed_distance")
    )
    return targets.join(found, ["z_1", "z_2"], "left")
