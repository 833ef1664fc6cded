"""Footprints of algorithms from points and labels: where a label is dense and pure.

The plane is cut into cells whose size follows from the density of a label's points.  Points are counted by cell,
combined in their tasks; all that follows works on the cells, of which there are at most ``RESOLUTION`` squared for a
label, however many points there are.  A cell is dense if it and its ring of neighbours hold enough of the
label's points, neighbouring dense cells are one cluster, cells at its edge join it, and cells with too few points
of the label among all their points are taken out.  What is left of a cluster is a part of the footprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.common import finite

# The share of a label in a cell, and the neighbours that a dense place needs: a twentieth of the
# label's points, between these bounds.
PURITY, NEIGHBOURS, LEAST, MOST = 0.75, 20, 3, 50
#: Cells along an axis at most.
RESOLUTION = 256

_CELL = "label string, part int, cx int, cy int, n long, good long, side double, x0 double, y0 double"


def cell_sizes(points: DataFrame, labels: Sequence[str], resolution: int = RESOLUTION) -> list[tuple[str, float, int, float, float]]:
    """``(label, side, needed, x0, y0)`` of every label with an extent: the side of its cells and the points that a dense
    place needs.  The side is 1/√2 of the radius in which a place of average density has as many."""
    x, y = F.col("z_1"), F.col("z_2")
    ends = []
    for i, label in enumerate(labels):
        own = F.col(label) == 1
        ends += [F.count_if(own).alias(f"n{i}")]
        ends += [f(F.when(own, c)).alias(f"{name}{i}") for c, axis in ((x, "x"), (y, "y")) for f, name in ((F.min, f"{axis}a"), (F.max, f"{axis}b"))]
    row = points.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), *ends).first()
    out = []
    for i, label in enumerate(labels):
        n = row[f"n{i}"]
        area = (row[f"xb{i}"] - row[f"xa{i}"]) * (row[f"yb{i}"] - row[f"ya{i}"]) if n else 0.0
        if area > 0:
            needed = max(min(-(-n // NEIGHBOURS), MOST), LEAST)
            side = math.sqrt(area * needed / (n * math.pi) / 2)
            out.append((label, max(side, max(row["x1"] - row["x0"], row["y1"] - row["y0"]) / (resolution - 1)), needed, row["x0"], row["y0"]))
    return out


def _ring(cell: tuple[int, int]) -> Iterator[tuple[int, int]]:
    return ((cell[0] + i, cell[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def clusters(good: dict[tuple[int, int], int], needed: int) -> dict[tuple[int, int], int]:
    """The cluster of every cell that has one, numbered from 1 by their first cells."""
    dense = {c for c, g in good.items() if g and sum(good.get(d, 0) for d in _ring(c)) >= needed}
    part: dict[tuple[int, int], int] = {}
    number = 0
    for first in sorted(dense):
        if first in part:
            continue
        number += 1
        part[first], todo = number, [first]
        while todo:
            for d in _ring(todo.pop()):
                if d in dense and d not in part:
                    part[d] = number
                    todo.append(d)
    edge = {c: min(part[d] for d in _ring(c) if d in dense) for c, g in good.items() if g and c not in dense and any(d in dense for d in _ring(c))}
    return part | edge


def rings(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Corners of the closed outlines of a set of cells, cells on the left hand; outlines of holes run the other way."""
    leave: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in cells:
        for beside, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)),
                             ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
            if beside not in cells:
                leave.setdefault(a, []).append(b)
    out = []
    for start in sorted(leave):
        while leave.get(start):
            corners, at, to = [], start, leave[start].pop()
            while True:
                step = (to[0] - at[0], to[1] - at[1])
                if not corners or corners[-1][1] != step:
                    corners.append((at, step))
                if to == start:
                    break
                # of two ways on, the one that keeps cells which touch in a corner apart
                ways = leave[to]
                turn = (to[0] - step[1], to[1] + step[0])
                at, to = to, ways.pop(ways.index(turn) if turn in ways else 0)
            out.append([p for p, _ in corners])
    return out


def footprint_cells(
    points: DataFrame, labels: Sequence[str], purity: float = PURITY, resolution: int = RESOLUTION,
) -> DataFrame:
    """``label, part, cx, cy, n, good, side, x0, y0``: the cells of every part of every label's footprint.

    ``points`` has ``z_1, z_2`` and a 0/1 column for each label (null: 0).  Points without a finite place are left
    out; labels whose points have no extent have no footprint.
    """
    placed = points.where(finite(F.col("z_1")) & finite(F.col("z_2"))).select("z_1", "z_2", *labels)
    sizes = cell_sizes(placed, labels, resolution)
    if not sizes:
        return points.sparkSession.createDataFrame([], _CELL)
    each = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.floor((F.col("z_1") - x0) / side).cast("int").alias("cx"), F.floor((F.col("z_2") - y0) / side).cast("int").alias("cy"),
            F.coalesce((F.col(label) == 1).cast("int"), F.lit(0)).alias("own"))
        for label, side, _, x0, y0 in sizes])
    counted = placed.select(F.inline(each)).groupBy("label", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("good"))
    known = {label: (side, needed, x0, y0) for label, side, needed, x0, y0 in sizes}

    def parts(pdf):
        label = pdf["label"].iloc[0]
        side, needed, x0, y0 = known[label]
        cell = list(zip(pdf["cx"].tolist(), pdf["cy"].tolist(), strict=True))
        part = clusters(dict(zip(cell, pdf["good"].tolist(), strict=True)), needed)
        kept = pdf[[c in part for c in cell] & (pdf["good"] >= purity * pdf["n"])].copy()
        kept["part"] = [part[c] for c in zip(kept["cx"].tolist(), kept["cy"].tolist(), strict=True)]
        return kept.assign(side=side, x0=x0, y0=y0)[["label", "part", "cx", "cy", "n", "good", "side", "x0", "y0"]]

    return counted.groupBy("label").applyInPandas(parts, _CELL)


def footprint_parts(cells: DataFrame) -> DataFrame:
    """``label, part, cells, area, points, good, purity`` of every part."""
    return cells.groupBy("label", "part").agg(
        F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * F.first("side") * F.first("side")).alias("area"),
        F.sum("n").alias("points"), F.sum("good").alias("good"), (F.sum("good") / F.sum("n")).alias("purity"))


def footprint_polygons(cells: DataFrame, kind: str = "good") -> DataFrame:
    """The outlines as polygons ``(poly_id, part_id, seq, z_1, z_2)``, named ``<label>|<kind>``; holes are parts that run
    the other way."""

    def outlined(pdf):
        import pandas as pd

        side, x0, y0 = (pdf[c].iloc[0] for c in ("side", "x0", "y0"))
        rows, number = [], 0
        for _, part in pdf.sort_values("part").groupby("part"):
            for ring in rings(set(zip(part["cx"].tolist(), part["cy"].tolist(), strict=True))):
                number += 1
                rows += [(f"{pdf['label'].iloc[0]}|{kind}", number, k, x0 + x * side, y0 + y * side) for k, (x, y) in enumerate(ring)]
        return pd.DataFrame(rows, columns=["poly_id", "part_id", "seq", "z_1", "z_2"])

    return cells.groupBy("label").applyInPandas(outlined, "poly_id string, part_id int, seq int, z_1 double, z_2 double")
