"""Which algorithms are good where: labels, portfolio, classifier, selector, footprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.common import DataError, collect_model, keep, ratio
from probscape.functions.model import box_cox, fit_box_cox, fit_zscore
from probscape.operators.geometry import point_in_polygon, polygon_area
from probscape.operators.nearest import nearest_k

# The machine epsilon that keeps shifted values positive, default thresholds.
EPS = 2.220446049250313e-16
GOOD_EPSILON, BETA = 0.2, 0.55


def _best(algos: Sequence[str], maximise: bool) -> Column:
    cols = [F.nanvl(F.col(a), F.lit(None)) for a in algos]
    if len(cols) == 1:
        return cols[0]
    return F.greatest(*cols) if maximise else F.least(*cols)


def relative_loss(algos: Sequence[str], maximise: bool = False) -> dict[str, Column]:
    """How far every algorithm is behind the row's best, as a share; null stays null."""
    best = _best(algos, maximise)

    def safe(x):
        return F.when(x == 0, F.lit(EPS)).otherwise(x)

    if maximise:
        return {a: 1 - F.col(a) / safe(best) for a in algos}
    return {a: safe(F.col(a)) / safe(best) - 1 for a in algos}


def label_good(
    df: DataFrame, algos: Sequence[str], epsilon: float = GOOD_EPSILON, absolute: bool = False,
    maximise: bool = False, prefix: str = "good_",
) -> DataFrame:
    """0/1 per algorithm; a missing runtime is the worst there is."""
    if absolute:
        cond = {a: (F.col(a) >= epsilon) if maximise else (F.col(a) <= epsilon) for a in algos}
    else:
        cond = {a: loss <= epsilon for a, loss in relative_loss(algos, maximise).items()}
    known = {a: F.col(a).isNotNull() & ~F.isnan(a) for a in algos}
    return df.withColumns({
        f"{prefix}{a.removeprefix('algo_')}": F.coalesce(known[a] & c, F.lit(False)).cast("int") for a, c in cond.items()
    })


def num_good(df: DataFrame, labels: Sequence[str], beta: float = BETA) -> DataFrame:
    """Number of good algorithms and whether their share makes the instance easy."""
    total = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    return df.withColumns({"num_good": total, "beta_easy": (total / F.lit(float(len(labels))) > beta).cast("int")})


def portfolio(df: DataFrame, algos: Sequence[str], out: str = "best_algo") -> DataFrame:
    """1-based place of the best algorithm, the first on ties; 0 if none has a runtime."""
    best = _best(algos, False)
    place = F.lit(0)
    for i in range(len(algos), 0, -1):
        place = F.when(F.col(algos[i - 1]) == best, i).otherwise(place)
    return df.withColumn(out, place)


def performance_transform(df: DataFrame, algos: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Relative loss → shifted to just above zero → Box-Cox → z-score, per algorithm."""
    loss = df.select(*ids, *[c.alias(a) for a, c in relative_loss(algos).items()])
    low = loss.agg(*[F.min(a).alias(a) for a in algos]).first()
    moved = loss.select(*ids, *[(F.col(a) - low[a] + EPS).alias(a) for a in algos])
    held = keep(moved.select(*algos))  # read once per round of the search
    lam = fit_box_cox(held, list(algos))
    z = fit_zscore(held.select(*[box_cox(F.col(a), lam[a]).alias(a) for a in algos]), list(algos))
    held.unpersist()
    bent = moved.select(*ids, *[box_cox(F.col(a), lam[a]).alias(a) for a in algos])
    return bent.select(*ids, *[((F.col(a) - z[a][0]) / z[a][1]).alias(a) for a in algos])


# ------------------------------------------------------------------------- classifier


def knn_predict(
    df: DataFrame, labels: Sequence[str], k: int, folds: int, fold: Column, key: str = "instance", **how
) -> DataFrame:
    """Cross-validated k-nearest-neighbour vote per label, as ``pred_*`` columns.

    An instance is judged by the other folds: one search over all points, in which a fold does not meet
    itself; instances in one place share one search.  A tie votes 0.
    """
    placed = df.withColumn("fold", fold.cast("int"))
    near = nearest_k(placed.select("fold", "z_1", "z_2"), placed.select("fold", key, "z_1", "z_2"), k, key, "fold", **how)
    voted = near.join(df.select(key, *labels), key)
    votes = voted.groupBy("fold", "z_1", "z_2").agg(
        F.count(F.lit(1)).alias("voters"), *[F.sum(c).alias(c) for c in labels]
    )
    preds = votes.select(
        "fold", "z_1", "z_2", *[(2 * F.col(c) > F.col("voters")).cast("int").alias(f"pred_{c.removeprefix('good_')}") for c in labels]
    )
    return placed.join(preds, ["fold", "z_1", "z_2"], "left").select(
        key, *[F.coalesce(f"pred_{c.removeprefix('good_')}", F.lit(0)).alias(f"pred_{c.removeprefix('good_')}") for c in labels]
    )


def label_precision(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Precision of every predictor: good among predicted good (0 if it predicts none)."""
    row = df.agg(*[
        F.coalesce(F.avg(F.when(F.col(f"pred_{n}") == 1, F.col(f"good_{n}").cast("double"))), F.lit(0.0)).alias(n) for n in names
    ]).first()
    return {n: row[n] for n in names}


def selector(df: DataFrame, names: Sequence[str], precision: Mapping[str, float], out: str = "selected") -> DataFrame:
    """1-based place of the largest precision × prediction, the first on ties; 0 if none."""
    weight = [F.col(f"pred_{n}") * F.lit(float(precision[n])) for n in names]
    top = F.greatest(*weight) if len(weight) > 1 else weight[0]
    place = F.lit(0)
    for i in range(len(names), 0, -1):
        place = F.when(weight[i - 1] == top, i).otherwise(place)
    return df.withColumn(out, F.when(top > 0, place).otherwise(0))


def selector_report(df: DataFrame, names: Sequence[str], selected: str = "selected") -> DataFrame:
    """Summary per algorithm, of the oracle (best per row) and of the selector.

    Columns ``algo_*``, ``good_*``, ``pred_*`` and the selection.  Where the selector picks
    none it falls back to the algorithm that is good most often.  One pass makes the counts;
    the fallback needs them, so the selector row is a second aggregate.
    """
    rates = df.agg(*[F.avg(F.col(f"good_{n}").cast("double")).alias(n) for n in names]).first()
    fallback = max(range(len(names)), key=lambda i: ((rates[names[i]] or 0.0), -i)) + 1

    def tally(pred: Column, good: Column):
        p, g = pred == 1, good == 1
        return {
            "accuracy": 100 * F.avg((p == g).cast("double")),
            "precision": 100 * F.avg(F.when(p, g.cast("double"))),
            "recall": 100 * F.avg(F.when(g, p.cast("double"))),
        }

    def row(name, perf, good_rate, chosen, extra):
        return F.struct(
            F.lit(name).alias("name"), F.avg(perf).alias("avg_perf_all"), F.stddev_samp(perf).alias("std_perf_all"),
            good_rate.alias("p_good"), F.avg(F.when(chosen, perf)).alias("avg_perf_selected"),
            F.stddev_samp(F.when(chosen, perf)).alias("std_perf_selected"),
            *[extra.get(k, F.lit(None).cast("double")).alias(k) for k in ("accuracy", "precision", "recall")],
        )

    def at(place: Column, prefix: str) -> Column:
        out = F.lit(None)
        for i, n in enumerate(names, 1):
            out = F.when(place == i, F.col(f"{prefix}{n}")).otherwise(out)
        return out

    rows = []
    for n in names:
        pred, good = F.col(f"pred_{n}"), F.col(f"good_{n}")
        rows.append(row(n, F.col(f"algo_{n}"), F.avg(good.cast("double")), pred == 1, tally(pred, good)))
    best = _best([f"algo_{n}" for n in names], False)
    rows.append(row("Oracle", best, F.lit(1.0), F.lit(False), {}))
    pick = F.when(F.col(selected) > 0, F.col(selected)).otherwise(fallback)
    picked_good = at(F.col(selected), "good_")
    all_good = sum((F.col(f"good_{n}") for n in names[1:]), F.col(f"good_{names[0]}"))
    rows.append(row(
        "Selector", at(pick, "algo_"), F.avg(at(pick, "good_").cast("double")), F.col(selected) > 0,
        {
            "precision": 100 * ratio(F.sum(picked_good).cast("double"), F.count(picked_good).cast("double")),
            "recall": 100 * ratio(F.sum(picked_good).cast("double"), F.sum(all_good).cast("double")),
        },
    ))
    one = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rows)])
    return one.select(F.inline(F.array(*[f"r{i}" for i in range(len(rows))])))


# --------------------------------------------------------------------------- footprints


def footprint_stats(points: DataFrame, polygons: DataFrame, labels: Sequence[str], space: DataFrame) -> DataFrame:
    """Area, density and purity of footprints, relative to the whole space.

    ``polygons`` are named ``<label>|<kind>``; a polygon's purity is the share of rows with
    that label among the points inside it, boundary included.  ``label`` names a 0/1 column:
    predicted good for a footprint of goodness, chosen by the selector for one of being best.
    ``space`` is the polygon of the whole space.  Points are tested against a few polygons each and never shuffled.
    """
    ids = [r["poly_id"] for r in collect_model(polygons.select("poly_id").distinct(), "the list of footprints")]
    unknown = sorted({i.split("|")[0] for i in ids} - set(labels))
    if unknown:
        raise DataError(f"footprints of unknown labels: {unknown}")
    tagged = points.select(
        "z_1", "z_2",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("poly_id"), F.col(i.split("|")[0]).cast("int").alias("label")) for i in sorted(ids)
        ])).alias("t"),
    ).select("z_1", "z_2", "t.*")
    inside = point_in_polygon(tagged, polygons, boundary=True).where("inside")
    counts = inside.groupBy("poly_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("good")
    )
    whole_area = polygon_area(space).first()["area"]
    in_space = point_in_polygon(
        points.select("z_1", "z_2", F.lit(space.first()["poly_id"]).alias("poly_id")), space, boundary=True
    ).where("inside").count()
    density = in_space / whole_area
    stats = polygon_area(polygons).join(counts, "poly_id", "left")
    n = F.coalesce("n", F.lit(0.0))
    return stats.select(
        F.split_part("poly_id", F.lit("|"), F.lit(1)).alias("label"), F.split_part("poly_id", F.lit("|"), F.lit(2)).alias("kind"),
        "area", (F.col("area") / whole_area).alias("area_normalized"),
        ratio(n, F.col("area")).alias("density"), (ratio(n, F.col("area")) / density).alias("density_normalized"),
        ratio(F.coalesce("good", F.lit(0.0)), n).alias("purity"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
