"""The space model: bounds, Box-Cox, z-scores, projection.

Fits are reductions of the instance table to a model of a few numbers per feature; the
model is small and lives on the driver, the data never does.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probscape.common import DataError, collect_model, keep
from probscape.functions.diagnostics import unpivot
from probscape.functions.order_stats import column_quantiles

# Bounds at median ∓ 5·IQR, and the least positive normal double.
BOUND_SHARE = 5.0
TINY = 2.2250738585072014e-308


@dataclass(frozen=True)
class FeatureModel:
    lo: float
    hi: float
    min_x: float
    lam: float
    mu: float
    sigma: float
    w1: float = 0.0
    w2: float = 0.0


Model = dict[str, FeatureModel]


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(f, m.lo, m.hi, m.min_x, m.lam, m.mu, m.sigma, m.w1, m.w2) for f, m in model.items()]
    return spark.createDataFrame(
        rows, "feature string, lo double, hi double, min_x double, lambda double, mu double, sigma double, w1 double, w2 double"
    )


def load_model(table: DataFrame) -> Model:
    return {
        r["feature"]: FeatureModel(r["lo"], r["hi"], r["min_x"], r["lambda"], r["mu"], r["sigma"], r["w1"], r["w2"])
        for r in collect_model(table, "the model")
    }


# ---------------------------------------------------------------------------------- fit


def fit_bounds(df: DataFrame, cols: Sequence[str], share: float = BOUND_SHARE) -> dict[str, tuple[float, float]]:
    """Outlier bounds per feature from exact mid-point quantiles."""
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], midpoint=True)
    return {c: (q[c][1] - share * (q[c][2] - q[c][0]), q[c][1] + share * (q[c][2] - q[c][0])) for c in cols if c in q}


def clip_shift(x: Column, lo: float, hi: float, min_x: float) -> Column:
    return F.greatest(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - min_x + 1.0, F.lit(TINY))


def box_cox(t: Column, lam: Column | float) -> Column:
    if isinstance(lam, (int, float)):
        return F.ln(t) if lam == 0 else (F.pow(t, F.lit(float(lam))) - 1.0) / float(lam)
    return F.when(lam == 0, F.ln(t)).otherwise((F.pow(t, lam) - 1.0) / F.when(lam != 0, lam))


def minima(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    """Smallest value per feature after clipping."""
    row = df.agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(c) for c in bounds]).first()
    return {c: min(max(row[c], lo), hi) for c, (lo, hi) in bounds.items()}


def shifted(df: DataFrame, shifts: Mapping[str, tuple[float, float, float]], ids: Sequence[str] = ()) -> DataFrame:
    """Features clipped to ``(lo, hi)`` and moved to start at 1, ready for Box-Cox."""
    return df.select(*ids, *[clip_shift(F.col(f"`{c}`").cast("double"), *v).alias(c) for c, v in shifts.items()])


def _box_cox_moments(grid: Sequence[tuple[str, list[float]]]):
    """Per column and exponent of a task's rows: count, mean and squared deviations of Box-Cox values, Σ ln t, extremes of t."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, float], list[float]] = {}
        for batch in batches:
            for (name, lams), column in zip(grid, batch.columns, strict=True):
                t = column.drop_null().to_numpy(zero_copy_only=False)
                if not len(t):
                    continue
                with np.errstate(all="ignore"):
                    ln = np.log(t)
                    extra = (float(ln.sum()), float(t.min()), float(t.max()))
                    for lam in lams:
                        y = ln if lam == 0 else (np.power(t, lam) - 1.0) / lam
                        n, mean = len(y), y.mean()
                        m2 = np.square(y - mean).sum()
                        if (name, lam) not in kept:
                            kept[name, lam] = [n, mean, m2, *extra]
                            continue
                        own = kept[name, lam]
                        total, off = own[0] + n, mean - own[1]
                        own[2] += m2 + off * off * own[0] * n / total
                        own[1] += off * n / total
                        own[0], own[3] = total, own[3] + extra[0]
                        own[4], own[5] = min(own[4], extra[1]), max(own[5], extra[2])
        if kept:
            columns = [*zip(*kept), *zip(*kept.values())]
            kinds = [pa.string(), pa.float64(), pa.int64(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["feature", "lambda", "n", "mean", "m2", "s", "lo", "hi"])

    return run


def box_cox_profile(positive: DataFrame, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Profile log-likelihood ``(feature, lambda, ll)`` of positive columns over a grid of exponents.

    −n/2·ln var(y) + (λ − 1)·Σ ln t.  A task takes its batches through the grid as arrays and hands on one
    row of moments per (feature, λ); those of all tasks are merged around the common mean.
    """
    cols = list(grid)
    moments = positive.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(
        _box_cox_moments([(c, list(map(float, grid[c]))) for c in cols]),
        "feature string, lambda double, n long, mean double, m2 double, s double, lo double, hi double",
    )
    whole = Window.partitionBy("feature", "lambda")
    mean = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    sums = moments.withColumn("off", F.col("mean") - mean).groupBy("feature", "lambda").agg(
        (F.sum(F.col("m2") + F.col("n") * F.col("off") * F.col("off")) / F.sum("n")).alias("v"), F.sum("s").alias("s"), F.sum("n").alias("n"),
        (F.max("hi") > F.min("lo")).alias("varies"),
    )
    ll = F.when(F.col("varies") & (F.col("v") > 0), -F.col("n") / 2 * F.ln("v") + (F.col("lambda") - 1) * F.col("s"))
    return sums.select("feature", "lambda", ll.alias("ll"))


def fit_box_cox(
    positive: DataFrame, cols: Sequence[str], span: float = 40.0, steps: int = 17, tol: float = 1e-6
) -> dict[str, float]:
    """The exponent of greatest likelihood per positive column, by a grid that narrows around its best.

    All features advance together, one aggregation job per round.  A best value at the edge
    widens the grid.  A constant feature gets 1 (no change).
    """
    centre = {c: 0.0 for c in cols}
    width = {c: span for c in cols}
    done: dict[str, float] = {}
    for _ in range(60):
        todo = [c for c in cols if c not in done]
        if not todo:
            break
        grid = {c: [centre[c] + width[c] * (2 * i / (steps - 1) - 1) for i in range(steps)] for c in todo}
        best: dict[str, tuple[float, float]] = {}
        for r in box_cox_profile(positive, grid).collect():
            if r["ll"] is not None and not math.isnan(r["ll"]):
                cand = (r["ll"], -abs(r["lambda"]), r["lambda"])
                if r["feature"] not in best or cand > best[r["feature"]]:
                    best[r["feature"]] = cand
        for c in todo:
            if c not in best:
                done[c] = 1.0
                continue
            lam, step = best[c][2], 2 * width[c] / (steps - 1)
            centre[c] = lam
            if lam in (grid[c][0], grid[c][-1]):
                width[c] *= 2 if width[c] >= span else 1
                if width[c] > 1e4:
                    raise DataError(f"the likelihood of {c!r} has no maximum: its exponent runs to {lam}")
            elif step < tol:
                done[c] = lam
            else:
                width[c] = step
    lacking = [c for c in cols if c not in done]
    if lacking:
        raise DataError(f"the search for an exponent did not converge for {lacking}")
    return done


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation per column; a deviation of 0 (or of one row) counts as 1.

    Merging the moments of tasks can leave a constant column a deviation of about 1e-16, so its extremes tell it.
    """
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(cols)],
        *_extremes(cols),
    ).first()
    return {c: (row[f"m_{i}"], 1.0 if _is_constant(row, i) else row[f"s_{i}"] or 1.0) for i, c in enumerate(cols)}


def _extremes(cols: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]


def _is_constant(row, i: int) -> bool:
    return row[f"lo_{i}"] == row[f"hi_{i}"]


def fit_normalisation(df: DataFrame, cols: Sequence[str]) -> Model:
    """Bounds, shift, exponent and z-score of every feature."""
    bounds = fit_bounds(df, cols)
    low = minima(df, bounds)
    shifts = {c: (*bounds[c], low[c]) for c in cols}
    positive = keep(shifted(df, shifts))  # read once per round of the search
    lam = fit_box_cox(positive, cols)
    z = fit_zscore(positive.select(*[box_cox(F.col(c), lam[c]).alias(c) for c in cols]), cols)
    positive.unpersist()
    return {c: FeatureModel(*bounds[c], low[c], lam[c], *z[c]) for c in cols}


# -------------------------------------------------------------------------------- apply


def feature_column(columns: Sequence[str], name: str) -> str:
    """Features are accepted with or without their prefix."""
    for c in (name, f"feature_{name}", name.removeprefix("feature_")):
        if c in columns:
            return c
    raise DataError(f"feature {name!r} is missing")


def normalised(columns: Sequence[str], model: Model, strict: bool = True) -> dict[str, Column]:
    out = {}
    for name, m in model.items():
        x = F.nanvl(F.col(f"`{feature_column(columns, name)}`").cast("double"), F.lit(None))
        if strict:
            x = F.coalesce(x, F.raise_error(F.lit(f"feature {name} is missing in a row")).cast("double"))
        out[name] = (box_cox(clip_shift(x, m.lo, m.hi, m.min_x), m.lam) - m.mu) / (m.sigma or 1.0)
    return out


def apply_norm(df: DataFrame, model: Model, ids: Sequence[str]) -> DataFrame:
    """Normalised features next to the id columns; a missing value fails the job."""
    return df.select(*ids, *[c.alias(n) for n, c in normalised(df.columns, model).items()])


def project(df: DataFrame, weights: Mapping[str, tuple[float, float]], ids: Sequence[str]) -> DataFrame:
    """z = X·Aᵀ as two sums over columns."""
    def axis(k):
        total = F.lit(0.0)
        for name, w in weights.items():
            total = total + F.lit(float(w[k])) * F.col(f"`{feature_column(df.columns, name)}`")
        return total

    return df.select(*ids, axis(0).alias("z_1"), axis(1).alias("z_2"))


def apply_model(df: DataFrame, model: Model, ids: Sequence[str]) -> DataFrame:
    return project(apply_norm(df, model, ids), {n: (m.w1, m.w2) for n, m in model.items()}, ids)


# --------------------------------------------------------------------------- projection

#: Correlations per aggregate, so that generated code stays small.
_PRODUCTS = 150


def _cross(split: int):
    """Sums of products of the columns before ``split`` with those from it on, one matrix a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]), posinf=np.inf, neginf=-np.inf)
                part = values[:, :split].T @ values[:, split:]
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def gram(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> np.ndarray:
    """Sums of products of columns as a numpy matrix, in one pass: a matrix of as many cells as there are pairs
    of columns leaves each task. Nulls and NaN add nothing."""
    right_ = list(left if right is None else right)
    columns = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*left, *right_])]
    sums = df.select(*columns).mapInArrow(_cross(len(left)), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((len(left), len(right_)))
    for r in sums.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def fit_projection(df: DataFrame, features: Sequence[str], algos: Sequence[str]) -> dict[str, tuple[float, float]]:
    """2-D projection that best reconstructs features and performances linearly.

    Analytic solution: the two leading eigenvectors V of the joint Gram matrix of [F Y], and
    A = Vᵀ·[F Y]ᵀF·(FᵀF)⁻¹.  Each axis is signed so that its largest weight is positive.
    Columns are expected to be normalised, without missing values.
    """
    both = [*features, *algos]
    g = gram(df, both)
    d = len(features)
    vals, vecs = np.linalg.eigh(g)
    v = vecs[:, np.argsort(-np.abs(vals), kind="stable")[:2]]
    a = v.T @ g[:, :d] @ np.linalg.pinv(g[:d, :d])
    for k in range(2):
        if a[k, np.argmax(np.abs(a[k]))] < 0:
            a[k] = -a[k]
    return {f: (float(a[0, i]), float(a[1, i])) for i, f in enumerate(features)}


def select_features_by_corr(df: DataFrame, features: Sequence[str], algos: Sequence[str], rho: float) -> DataFrame:
    """Features whose strongest |correlation| with a performance column reaches ``rho``."""
    out = None
    pairs = [(f, a) for f in features for a in algos]
    for at in range(0, len(pairs), _PRODUCTS):
        chunk = pairs[at : at + _PRODUCTS]
        one = df.agg(*[F.corr(f, a).alias(f"r{i}") for i, (f, a) in enumerate(chunk)])
        part = one.select(F.inline(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"r{i}")).alias("r")) for i, (f, _) in enumerate(chunk)
        ])))
        out = part if out is None else out.unionByName(part)
    strongest = out.groupBy("feature").agg(F.max("r").alias("max_abs_corr"))
    return strongest.where(F.col("max_abs_corr") >= rho)


def outline(spark: SparkSession, box: Mapping[str, tuple[float, float, float, float]]) -> DataFrame:
    """Boundary of the projected box ``{feature: (min, max, w1, w2)}`` as ``(seq, z_1, z_2)``.

    The projection of a d-dimensional box is a zonogon: it is enough to walk its 2d edges by
    direction, instead of projecting all 2^d corners.  Counter-clockwise from the lowest z_1.
    """
    gens, sx, sy = [], 0.0, 0.0
    for lo, hi, w1, w2 in (map(float, v) for v in box.values()):
        gx, gy = (hi - lo) * w1, (hi - lo) * w2
        left = gx > 0 or (gx == 0 and gy >= 0)  # where the leftmost corner takes this feature
        sx, sy = sx + (lo if left else hi) * w1, sy + (lo if left else hi) * w2
        if gx or gy:
            gens.append((gx, gy) if left else (-gx, -gy))
    # parallel generators make one edge; there and back again closes the walk
    merged = spark.createDataFrame(gens, "gx double, gy double").groupBy(
        F.round(F.atan2("gy", "gx"), 12).alias("angle")
    ).agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    steps = merged.select(
        "angle", F.explode(F.array(F.struct(F.lit(0).alias("half"), "gx", "gy"),
                                   F.struct(F.lit(1).alias("half"), (-F.col("gx")).alias("gx"), (-F.col("gy")).alias("gy")))).alias("s")
    ).select("angle", "s.*")
    # 2d rows at most, so one ordered window over all of them is fine
    order = Window.orderBy("half", "angle")
    walk = order.rowsBetween(Window.unboundedPreceding, -1)
    return steps.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("seq"),
        (F.lit(sx) + F.coalesce(F.sum("gx").over(walk), F.lit(0.0))).alias("z_1"),
        (F.lit(sy) + F.coalesce(F.sum("gy").over(walk), F.lit(0.0))).alias("z_2"),
    )


def corners(
    spark: SparkSession, box: Mapping[str, tuple[float, float, float, float]],
    correlated: Sequence[tuple[str, str, float]] = (), max_features: int = 24,
) -> DataFrame:
    """Projected corners ``(z_1, z_2)`` of the box, without those that contradict a correlation.

    ``correlated`` names strongly correlated pairs: a positive one rules out corners that
    put one feature at its minimum and the other at its maximum, a negative one the rest.
    """
    names = list(box)
    if len(names) > max_features:
        raise DataError(f"2^{len(names)} corners; use outline() for more than {max_features} features")
    ids = spark.range(1 << len(names))
    bit = {f: F.shiftrightunsigned("id", i).bitwiseAND(F.lit(1)) for i, f in enumerate(names)}
    for a, b, r in correlated:
        ids = ids.where(bit[a] == bit[b]) if r > 0 else ids.where(bit[a] != bit[b])
    z = []
    for k in (2, 3):
        total = F.lit(0.0)
        for f in names:
            total = total + F.when(bit[f] == 1, F.lit(box[f][1])).otherwise(F.lit(box[f][0])) * F.lit(box[f][k])
        z.append(total)
    return ids.select(z[0].alias("z_1"), z[1].alias("z_2"))


def feature_box(df: DataFrame, weights: Mapping[str, tuple[float, float]]) -> dict[str, tuple[float, float, float, float]]:
    """Extent of every (normalised) feature with its weights — the input of ``outline``."""
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(weights) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"], *w) for i, (c, w) in enumerate(weights.items())}


# ---------------------------------------------------------------------------- analytics


def difficulty_score(df: DataFrame, cols: Sequence[str], n_points: int | None = None) -> DataFrame:
    """Share of the greatest total over the given count columns, 1 = easiest.

    Without such columns, or if ``n_points`` says the tables differ in length, 0.5.
    """
    if not cols:
        return df.withColumn("difficulty", F.lit(0.5))
    total = sum((F.col(c).cast("double") for c in cols[1:]), F.col(cols[0]).cast("double"))
    stats = df.agg(F.max(total).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if n_points is not None and stats["n"] != n_points:
        return df.withColumn("difficulty", F.lit(0.5))
    return df.withColumn("difficulty", total / (stats["m"] or 1.0))


def difficulty_direction(df: DataFrame, span_share: float = 0.30) -> DataFrame:
    """Unit vector from the easy to the hard centroid and the arrow through the box centre.

    Easy means a difficulty value of at least the median.  Empty unless both sides have more
    than one row.
    """
    median = column_quantiles(df, ["difficulty"], [0.5])["difficulty"][0]
    easy = F.col("difficulty") >= median

    def side(cond, c):
        return F.avg(F.when(cond, F.col(c)))

    one = df.agg(
        F.count_if(easy).alias("n_easy"), F.count_if(~easy).alias("n_hard"),
        (side(~easy, "z_1") - side(easy, "z_1")).alias("dx"), (side(~easy, "z_2") - side(easy, "z_2")).alias("dy"),
        F.min("z_1").alias("x0"), F.max("z_1").alias("x1"), F.min("z_2").alias("y0"), F.max("z_2").alias("y1"),
    ).where("n_easy > 1 AND n_hard > 1")
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) + 1e-12
    ux, uy = F.col("dx") / norm, F.col("dy") / norm
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    length = span_share * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0))
    return one.select(
        F.lit(median).alias("median"), "n_easy", "n_hard", ux.alias("dir_1"), uy.alias("dir_2"),
        (cx - ux * length).alias("easy_1"), (cy - uy * length).alias("easy_2"),
        (cx + ux * length).alias("hard_1"), (cy + uy * length).alias("hard_2"),
    )


def feature_contribution(weights: DataFrame) -> DataFrame:
    """``(feature, w1, w2)`` by ascending |w1| + |w2|, with the place in that order."""
    size = F.abs("w1") + F.abs("w2")
    return weights.withColumn("contribution", size).withColumn(
        "place", F.row_number().over(Window.orderBy("contribution", "feature"))
    )


# -------------------------------------------------------------------------- local maps

# Ridge penalty, least usable scale, weights of the two alignments.
RIDGE, LEAST_SCALE = 1e-3, 1e-12
FEATURE_SHARE, SPACE_SHARE = 0.65, 0.35


@dataclass(frozen=True)
class RidgeMap:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    z_mean: tuple[float, float]
    coef: tuple[tuple[float, float], ...]
    ridge: float = RIDGE


def ridge_map(df: DataFrame, features: Sequence[str], ridge: float = RIDGE) -> RidgeMap:
    """Linear map from scaled features to ``(z_1, z_2)``, fitted from sums of products."""
    cols = list(features)
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate([*cols, "z_1", "z_2"])],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)], *_extremes(cols),
    ).first()
    mean = [row[f"m{i}"] for i in range(len(cols))]
    scale = [1.0 if _is_constant(row, i) or row[f"s{i}"] < LEAST_SCALE else row[f"s{i}"] for i in range(len(cols))]
    zm = (row[f"m{len(cols)}"], row[f"m{len(cols) + 1}"])
    centred = df.select(
        *[((F.col(c) - mean[i]) / scale[i]).alias(c) for i, c in enumerate(cols)],
        (F.col("z_1") - zm[0]).alias("z_1"), (F.col("z_2") - zm[1]).alias("z_2"),
    )
    xtx, xtz = gram(centred, cols), gram(centred, cols, ["z_1", "z_2"])
    coef = np.linalg.pinv(xtx + np.eye(len(cols)) * ridge) @ xtz
    return RidgeMap(tuple(cols), tuple(mean), tuple(scale), zm, tuple(map(tuple, coef.tolist())), ridge)


def alignment_score(pairs: DataFrame, fitted: RidgeMap, ids: Sequence[str], parent: str = "p_", child: str = "c_") -> DataFrame:
    """How well a step from parent to child heads for the target, in feature and z space.

    Columns: features and ``z_1``/``z_2`` under both prefixes, ``target_z_1``/``target_z_2``.
    A target at the parent gives null; a child without any feature change 0.
    """
    coef = np.asarray(fitted.coef)
    wanted = coef @ np.linalg.pinv(coef.T @ coef + np.eye(2) * fitted.ridge)
    tx = F.col("target_z_1") - F.col(f"{parent}z_1")
    ty = F.col("target_z_2") - F.col(f"{parent}z_2")
    sx = F.col(f"{child}z_1") - F.col(f"{parent}z_1")
    sy = F.col(f"{child}z_2") - F.col(f"{parent}z_2")
    base = pairs.select(
        *ids, tx.alias("tx"), ty.alias("ty"), sx.alias("sx"), sy.alias("sy"),
        F.array(*[
            (F.col(f"{child}{f}") - F.col(f"{parent}{f}")) / s for f, s in zip(fitted.features, fitted.scale)
        ]).alias("step"),
        F.array(*[F.lit(float(a)) * tx + F.lit(float(b)) * ty for a, b in wanted]).alias("way"),
    )

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    t_norm, s_norm = F.hypot("tx", "ty"), F.hypot("sx", "sy")
    way_norm, step_norm = F.sqrt(dot("way", "way")), F.sqrt(dot("step", "step"))
    in_space = F.when(t_norm * s_norm < LEAST_SCALE, F.lit(0.0)).otherwise(
        F.try_divide(F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty"), t_norm * s_norm)
    )
    in_features = F.try_divide(dot("step", "way"), step_norm * way_norm)
    score = (
        F.when((t_norm < LEAST_SCALE) | (way_norm < LEAST_SCALE), F.lit(None).cast("double"))
        .when(step_norm < LEAST_SCALE, F.lit(0.0))
        .otherwise(FEATURE_SHARE * in_features + SPACE_SHARE * in_space)
    )
    return base.select(*ids, score.alias("score"))
