"""Space model, labels, selectors, footprints and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from probscape import adapters as ad
from probscape.catalog.base import query
from probscape.functions import labels as lb
from probscape.functions import model as ml
from probscape.operators import footprints as fp
from probscape.operators import geometry as gm

C, B = (ad.POINTS,), (ad.METADATA,)
PF = ad.POINT_FEATURES
FEATS = ad.FEATURES


def pts(spark, sf_dir):
    return ad.points(spark, sf_dir)


# Mid-point quantiles by definition: rank k at (k − ½)/n, linear in between.
def _quantile_sql(col, p, src):
    return (
        f"(SELECT CASE WHEN hi_r > n THEN x_lo ELSE x_lo + (pos - lo_r) * (x_hi - x_lo) END FROM (SELECT n, pos, lo_r, lo_r + 1 AS hi_r, "
        f"list_extract(v, lo_r::BIGINT) AS x_lo, list_extract(v, least(lo_r + 1, n)::BIGINT) AS x_hi FROM ("
        f"SELECT v, n, greatest(1.0, least(n, {p} * n + 0.5)) AS pos, floor(greatest(1.0, least(n, {p} * n + 0.5))) AS lo_r "
        f"FROM (SELECT list({col} ORDER BY {col}) AS v, count(*)::DOUBLE AS n FROM {src} WHERE {col} IS NOT NULL))))"
    )


def _bounds_cte(cols, src):
    q = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {_quantile_sql(c, 0.25, src)} AS q1, {_quantile_sql(c, 0.5, src)} AS q2, "
        f"{_quantile_sql(c, 0.75, src)} AS q3" for c in cols
    )
    return f"quart AS ({q}), bnd AS (SELECT feature, q2 - 5 * (q3 - q1) AS lo, q2 + 5 * (q3 - q1) AS hi FROM quart)"


@query("m1_fit_bounds", "SELECT feature, lo, hi FROM bnd", (ad.METADATA, _bounds_cte(FEATS, "metadata")), "lo hi")
def m1(spark, sf_dir):
    b = ml.fit_bounds(ad.metadata(spark, sf_dir), FEATS)
    return spark.createDataFrame([(f, *v) for f, v in b.items()], "feature string, lo double, hi double")


_LAMBDAS = [-2.0, -0.5, 0.0, 0.5, 1.0, 2.0]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT instances, '{c}' AS feature, {c} AS x FROM metadata" for c in FEATS) + ")"
_SHIFTED = """
clipped AS (SELECT instances, l.feature, least(greatest(x, lo), hi) AS x FROM long l JOIN bnd USING (feature)),
mins AS (SELECT feature, min(x) AS min_x FROM clipped GROUP BY feature),
shifted AS (SELECT instances, feature, x - min_x + 1 AS t, min_x FROM clipped JOIN mins USING (feature))
"""


@query(
    "m2_box_cox_profile",
    f"""SELECT feature, lam AS "lambda", -count(*) / 2.0::DOUBLE * ln(var_pop(CASE WHEN lam = 0 THEN ln(t) ELSE (pow(t, lam) - 1) / lam END))
          + (lam - 1) * sum(ln(t)) AS ll
        FROM shifted, (SELECT unnest({_LAMBDAS})::DOUBLE AS lam) GROUP BY feature, lam""",
    (ad.METADATA, _bounds_cte(FEATS, "metadata"), _LONG, _SHIFTED), "lambda ll",
)
def m2_profile(spark, sf_dir):
    df = ad.metadata(spark, sf_dir)
    b = ml.fit_bounds(df, FEATS)
    low = ml.minima(df, b)
    positive = ml.shifted(df, {c: (*b[c], low[c]) for c in FEATS})
    return ml.box_cox_profile(positive, {c: _LAMBDAS for c in FEATS})


@query("m2_fit_boxcox")
def m2(spark, sf_dir):
    """Rows only: the search for the best exponent has no SQL form."""
    model = ml.fit_normalisation(ad.metadata(spark, sf_dir), FEATS)
    return ml.model_table(spark, model).select("feature", "lambda", "mu", "sigma")


@query(
    "m3_fit_zscore",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mu, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS sigma FROM src"
        for c in [*FEATS, "flat"]
    ),
    (ad.METADATA, "src AS (SELECT *, 2.0::DOUBLE AS flat FROM metadata)"), "mu sigma",
)
def m3(spark, sf_dir):
    z = ml.fit_zscore(ad.metadata(spark, sf_dir).withColumn("flat", F.lit(2.0)), [*FEATS, "flat"])
    return spark.createDataFrame([(f, *v) for f, v in z.items()], "feature string, mu double, sigma double")


# Exponents and weights used where the SQL twin needs a given model.
_FIXED_LAM = dict(zip(FEATS, [0.5, 0.0, -0.5, 1.0, 0.25]))
_FIXED_W = dict(zip(FEATS, [(0.4, -0.3), (-0.2, 0.5), (0.3, 0.3), (0.25, -0.1), (-0.5, 0.2)]))
_LAM_CTE = "lam(feature, l, w1, w2) AS (VALUES " + ", ".join(
    f"('{c}', {_FIXED_LAM[c]}::DOUBLE, {_FIXED_W[c][0]}::DOUBLE, {_FIXED_W[c][1]}::DOUBLE)" for c in FEATS
) + ")"
_NORMED = """
bent AS (SELECT instances, feature, w1, w2, CASE WHEN l = 0 THEN ln(t) ELSE (pow(t, l) - 1) / l END AS y FROM shifted JOIN lam USING (feature)),
zst AS (SELECT feature, avg(y) AS mu, stddev_samp(y) AS sigma FROM bent GROUP BY feature),
normed AS (SELECT instances, feature, w1, w2, (y - mu) / sigma AS z FROM bent JOIN zst USING (feature))
"""
_NORM_CTES = (ad.METADATA, _bounds_cte(FEATS, "metadata"), _LONG, _SHIFTED, _LAM_CTE, _NORMED)


def fixed_model(df) -> ml.Model:
    b = ml.fit_bounds(df, FEATS)
    low = ml.minima(df, b)
    positive = ml.shifted(df, {c: (*b[c], low[c]) for c in FEATS})
    z = ml.fit_zscore(positive.select(*[ml.box_cox(F.col(c), _FIXED_LAM[c]).alias(c) for c in FEATS]), FEATS)
    return {c: ml.FeatureModel(*b[c], low[c], _FIXED_LAM[c], *z[c], *_FIXED_W[c]) for c in FEATS}


@query(
    "m4_apply_norm",
    "SELECT instances, " + ", ".join(f"max(z) FILTER (feature = '{c}') AS {c}" for c in FEATS) + " FROM normed GROUP BY instances",
    _NORM_CTES, " ".join(FEATS),
)
def m4(spark, sf_dir):
    df = ad.metadata(spark, sf_dir)
    return ml.apply_norm(df, fixed_model(df), ["instances"])


@query(
    "m5_project",
    "SELECT instances, sum(z * w1) AS z_1, sum(z * w2) AS z_2 FROM normed GROUP BY instances", _NORM_CTES, "z_1 z_2",
)
def m5(spark, sf_dir):
    df = ad.metadata(spark, sf_dir)
    return ml.apply_model(df, fixed_model(df), ["instances"])


@query("m6_fit_projection")
def m6(spark, sf_dir):
    """Rows only: leading eigenvectors."""
    df = pts(spark, sf_dir)
    z = ml.fit_zscore(df, PF)
    normed = df.select(*[((F.col(c) - z[c][0]) / z[c][1]).alias(c) for c in PF], "z_1", F.col("label").cast("double").alias("label"))
    w = ml.fit_projection(normed, PF, ["z_1", "label"])
    return spark.createDataFrame([(f, *v) for f, v in w.items()], "feature string, w1 double, w2 double")


@query(
    "m7_select_features_by_corr",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, greatest(abs(corr({f}, z_1)), abs(corr({f}, z_2))) AS max_abs_corr FROM points" for f in PF
    ) + ") WHERE max_abs_corr >= 0.1",
    C, "max_abs_corr",
)
def m7(spark, sf_dir):
    return ml.select_features_by_corr(pts(spark, sf_dir), PF, ["z_1", "z_2"], 0.1)


# The outline's corners: for the normal of each feature's edge, the corners of the box that lie farthest that
# way; the feature itself may stand at either end.
_BOX = "ext AS (SELECT " + ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in PF) + " FROM points)"
_GENERATORS = "gen AS (" + " UNION ALL ".join(
    f"SELECT {i} AS f, lo_{f} AS lo, hi_{f} AS hi, {ad.POINT_WEIGHTS[f][0]}::DOUBLE AS w1, {ad.POINT_WEIGHTS[f][1]}::DOUBLE AS w2 FROM ext" for i, f in enumerate(PF)
) + ")"
_CORNERS = """cor AS (SELECT f, s, e, sum(place * w1) AS z_1, sum(place * w2) AS z_2 FROM (
    SELECT n.f, s, e, g.w1, g.w2, CASE WHEN g.f = n.f THEN (CASE WHEN e = 1 THEN g.hi ELSE g.lo END)
           WHEN s * (g.w1 * n.w2 - g.w2 * n.w1) > 0 THEN g.hi ELSE g.lo END AS place
    FROM gen n, gen g, (VALUES (1), (-1)) AS sides(s), (VALUES (0), (1)) AS ends(e)) AS c GROUP BY f, s, e)"""


@query("m8_outline", "SELECT DISTINCT round(z_1, 9) AS z_1, round(z_2, 9) AS z_2 FROM cor", (ad.POINTS, _BOX, _GENERATORS, _CORNERS), "z_1 z_2")
def m8(spark, sf_dir):
    ring = ml.outline(spark, ml.feature_box(pts(spark, sf_dir), ad.POINT_WEIGHTS))
    return ring.select(F.round("z_1", 9).alias("z_1"), F.round("z_2", 9).alias("z_2"))


@query("m9_performance_transform")
def m9(spark, sf_dir):
    """Rows only: contains a fitted exponent."""
    return lb.performance_transform(ad.metadata(spark, sf_dir), ad.ALGOS, ["instances"])


_A = ", ".join(ad.ALGOS)
_NAMES = [a.removeprefix("algo_") for a in ad.ALGOS]
_GOOD = ", ".join(
    f"CASE WHEN {a} / least({_A}) - 1 <= 0.2 THEN 1 ELSE 0 END AS good_{a.removeprefix('algo_')}" for a in ad.ALGOS
)
_GOOD_CTE = f"lab AS (SELECT *, {_GOOD} FROM metadata)"
_SUM = " + ".join(f"good_{n}" for n in _NAMES)


@query("m10_label_good", f"SELECT instances, {', '.join(f'good_{n}' for n in _NAMES)} FROM lab", (ad.METADATA, _GOOD_CTE))
def m10(spark, sf_dir):
    return lb.label_good(ad.metadata(spark, sf_dir), ad.ALGOS).select("instances", *[f"good_{n}" for n in _NAMES])


@query(
    "m10_label_good_absolute",
    "SELECT instances, " + ", ".join(f"CASE WHEN {a} <= 150000 THEN 1 ELSE 0 END AS cheap_{a[5:]}, "
    f"CASE WHEN 1 - {a} / greatest({_A}) <= 0.1 THEN 1 ELSE 0 END AS dear_{a[5:]}" for a in ad.ALGOS) + " FROM metadata",
    B,
)
def m10_abs(spark, sf_dir):
    df = lb.label_good(ad.metadata(spark, sf_dir), ad.ALGOS, 150000.0, absolute=True, prefix="cheap_")
    df = lb.label_good(df, ad.ALGOS, 0.1, maximise=True, prefix="dear_")
    return df.select("instances", *[f"{p}_{n}" for n in _NAMES for p in ("cheap", "dear")])


@query(
    "m11_num_good",
    f"SELECT instances, {_SUM} AS num_good, CASE WHEN ({_SUM}) / 5.0 > 0.55 THEN 1 ELSE 0 END AS beta_easy FROM lab",
    (ad.METADATA, _GOOD_CTE),
)
def m11(spark, sf_dir):
    df = lb.label_good(ad.metadata(spark, sf_dir), ad.ALGOS)
    return lb.num_good(df, [f"good_{n}" for n in _NAMES]).select("instances", "num_good", "beta_easy")


@query(
    "m12_portfolio",
    "SELECT instances, CASE " + " ".join(f"WHEN {a} = least({_A}) THEN {i}" for i, a in enumerate(ad.ALGOS, 1)) + " ELSE 0 END AS best_algo FROM metadata",
    B,
)
def m12(spark, sf_dir):
    return lb.portfolio(ad.metadata(spark, sf_dir), ad.ALGOS).select("instances", "best_algo")


# Points with labels: an algorithm is good for some of the vector's labels.
_ALGO2 = ["one", "two", "three"]
_POINT_LABELS = """
plab AS (SELECT *, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS good_one, CASE WHEN label % 3 <> 1 THEN 1 ELSE 0 END AS good_two,
   CASE WHEN z_1 > 0 THEN 1 ELSE 0 END AS good_three, 5 + 10 * abs(f0) AS algo_one, 4 + 12 * abs(f1) AS algo_two, 6 + 8 * abs(f2) AS algo_three FROM points)
"""
_KNN = """
ranked AS (SELECT q.instance, t.good_one, t.good_two, t.good_three,
    row_number() OVER (PARTITION BY q.instance ORDER BY (q.z_1 - t.z_1) * (q.z_1 - t.z_1) + (q.z_2 - t.z_2) * (q.z_2 - t.z_2), t.instance) AS rk
  FROM plab q JOIN plab t ON q.id % 5 <> t.id % 5),
knn AS (SELECT instance, CASE WHEN 2 * sum(good_one) > count(*) THEN 1 ELSE 0 END AS pred_one,
    CASE WHEN 2 * sum(good_two) > count(*) THEN 1 ELSE 0 END AS pred_two,
    CASE WHEN 2 * sum(good_three) > count(*) THEN 1 ELSE 0 END AS pred_three FROM ranked WHERE rk <= 3 GROUP BY instance)
"""


def labelled(spark, sf_dir):
    return pts(spark, sf_dir).selectExpr(
        "*", "CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS good_one", "CASE WHEN label % 3 <> 1 THEN 1 ELSE 0 END AS good_two",
        "CASE WHEN z_1 > 0 THEN 1 ELSE 0 END AS good_three",
        "5 + 10 * abs(f0) AS algo_one", "4 + 12 * abs(f1) AS algo_two", "6 + 8 * abs(f2) AS algo_three",
    )


def _knn(spark, sf_dir, **how):
    return lb.knn_predict(labelled(spark, sf_dir), [f"good_{n}" for n in _ALGO2], 3, 5, F.col("id") % 5, **how)


_KNN_SQL = "SELECT instance, pred_one, pred_two, pred_three FROM knn"


@query("m13_knn_predict", _KNN_SQL, (ad.POINTS, _POINT_LABELS, _KNN))
def m13(spark, sf_dir):
    return _knn(spark, sf_dir)


@query("m13_knn_predict_by_descent", _KNN_SQL, (ad.POINTS, _POINT_LABELS, _KNN))
def m13_descent(spark, sf_dir):
    """The same with two levels more than are sent to tasks, the way large corpora take."""
    return _knn(spark, sf_dir, levels=6)


# Cheap predictions with an SQL form, for the queries downstream of a classifier.
_PRED = """
pred AS (SELECT *, CASE WHEN f3 > 0 OR label % 2 = 0 THEN 1 ELSE 0 END AS pred_one, CASE WHEN f4 > 0.05 THEN 1 ELSE 0 END AS pred_two,
   CASE WHEN f5 > 0.15 THEN 1 ELSE 0 END AS pred_three FROM plab),
prec AS (SELECT avg(good_one) FILTER (pred_one = 1) AS p1, avg(good_two) FILTER (pred_two = 1) AS p2,
                avg(good_three) FILTER (pred_three = 1) AS p3 FROM pred),
sel AS (SELECT pred.*, CASE WHEN greatest(pred_one * p1, pred_two * p2, pred_three * p3) <= 0 THEN 0
     WHEN pred_one * p1 >= greatest(pred_two * p2, pred_three * p3) THEN 1 WHEN pred_two * p2 >= pred_three * p3 THEN 2 ELSE 3 END AS selected FROM pred, prec)
"""


def selected(spark, sf_dir):
    df = labelled(spark, sf_dir).selectExpr(
        "*", "CASE WHEN f3 > 0 OR label % 2 = 0 THEN 1 ELSE 0 END AS pred_one", "CASE WHEN f4 > 0.05 THEN 1 ELSE 0 END AS pred_two",
        "CASE WHEN f5 > 0.15 THEN 1 ELSE 0 END AS pred_three",
    )
    return lb.selector(df, _ALGO2, lb.label_precision(df, _ALGO2))


_SEL_CTES = (ad.POINTS, _POINT_LABELS, _PRED)


@query("m14_selector", "SELECT instance, selected FROM sel", _SEL_CTES)
def m14(spark, sf_dir):
    return selected(spark, sf_dir).select("instance", "selected")


_METRICS = "avg_perf_all std_perf_all p_good avg_perf_selected std_perf_selected accuracy precision recall"
_REPORT = " UNION ALL ".join(
    f"""SELECT '{n}' AS name, avg(algo_{n}) AS avg_perf_all, stddev_samp(algo_{n}) AS std_perf_all, avg(good_{n}) AS p_good,
      avg(algo_{n}) FILTER (pred_{n} = 1) AS avg_perf_selected, stddev_samp(algo_{n}) FILTER (pred_{n} = 1) AS std_perf_selected,
      100 * avg((pred_{n} = good_{n})::INT) AS accuracy, 100 * avg(good_{n}) FILTER (pred_{n} = 1) AS precision,
      100 * avg(pred_{n}) FILTER (good_{n} = 1) AS recall FROM sel""" for n in _ALGO2
) + """ UNION ALL SELECT 'Oracle', avg(least(algo_one, algo_two, algo_three)), stddev_samp(least(algo_one, algo_two, algo_three)), 1.0, NULL, NULL, NULL, NULL, NULL FROM sel
UNION ALL SELECT 'Selector', avg(p), stddev_samp(p), avg(g), avg(p) FILTER (selected > 0), stddev_samp(p) FILTER (selected > 0), NULL,
   100.0 * sum(g) FILTER (selected > 0) / count(*) FILTER (selected > 0), 100.0 * sum(g) FILTER (selected > 0) / sum(good_one + good_two + good_three)
 FROM (SELECT *, CASE pick WHEN 1 THEN algo_one WHEN 2 THEN algo_two ELSE algo_three END AS p, CASE pick WHEN 1 THEN good_one WHEN 2 THEN good_two ELSE good_three END AS g
   FROM (SELECT sel.*, CASE WHEN selected > 0 THEN selected ELSE (SELECT CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END
           FROM (SELECT avg(good_one) AS a, avg(good_two) AS b, avg(good_three) AS c FROM sel)) END AS pick FROM sel))"""


@query("m15_selector_report", _REPORT, _SEL_CTES, _METRICS)
def m15(spark, sf_dir):
    return lb.selector_report(selected(spark, sf_dir), _ALGO2)


# Footprints: two-part boxes around each label's quartiles; the space is the bounding box.
_FP = """
box AS (SELECT min(z_1) AS x0, max(z_1) AS x1, min(z_2) AS y0, max(z_2) AS y1 FROM points),
foot AS (SELECT p AS poly_id, part, a, b, c, d FROM box, LATERAL (VALUES
   ('good_one|good', 1, x0 + 0.2::DOUBLE * (x1 - x0), x0 + 0.5::DOUBLE * (x1 - x0), y0 + 0.1::DOUBLE * (y1 - y0), y0 + 0.6::DOUBLE * (y1 - y0)),
   ('good_one|good', 2, x0 + 0.6::DOUBLE * (x1 - x0), x0 + 0.9::DOUBLE * (x1 - x0), y0 + 0.4::DOUBLE * (y1 - y0), y0 + 0.9::DOUBLE * (y1 - y0)),
   ('good_two|best', 1, x0, x1, y0, y0 + 0.5::DOUBLE * (y1 - y0))) AS v(p, part, a, b, c, d)),
inn AS (SELECT poly_id, count(*) AS n, avg(CASE poly_id WHEN 'good_one|good' THEN good_one ELSE good_two END) AS purity
        FROM foot, plab WHERE z_1 BETWEEN a AND b AND z_2 BETWEEN c AND d GROUP BY poly_id),
ar AS (SELECT poly_id, sum((b - a) * (d - c)) AS area FROM foot GROUP BY poly_id),
tot AS (SELECT (x1 - x0) * (y1 - y0) AS area, (SELECT count(*) FROM points) AS n FROM box)
"""


@query(
    "m16_footprint_stats",
    """SELECT split_part(poly_id, '|', 1) AS label, split_part(poly_id, '|', 2) AS kind, ar.area, ar.area / tot.area AS area_normalized,
         inn.n / ar.area AS density, (inn.n / ar.area) / (tot.n / tot.area) AS density_normalized, purity
       FROM ar JOIN inn USING (poly_id), tot""",
    (ad.POINTS, _POINT_LABELS, _FP), "area area_normalized density density_normalized purity",
)
def m16(spark, sf_dir):
    from probscape.operators.geometry import bounding_box

    df = labelled(spark, sf_dir)
    x0, x1, y0, y1 = bounding_box(df)
    w, h = x1 - x0, y1 - y0

    def ring(pid, part, a, b, c, d):
        return [(pid, part, i, x, y) for i, (x, y) in enumerate([(a, c), (b, c), (b, d), (a, d), (a, c)])]

    rows = (
        ring("good_one|good", 1, x0 + 0.2 * w, x0 + 0.5 * w, y0 + 0.1 * h, y0 + 0.6 * h)
        + ring("good_one|good", 2, x0 + 0.6 * w, x0 + 0.9 * w, y0 + 0.4 * h, y0 + 0.9 * h)
        + ring("good_two|best", 1, x0, x1, y0, y0 + 0.5 * h)
    )
    schema = "poly_id string, part_id int, seq int, z_1 double, z_2 double"
    polygons = spark.createDataFrame(rows, schema)
    space = spark.createDataFrame(ring("space", 1, x0, x1, y0, y1), schema)
    return lb.footprint_stats(df, polygons, ["good_one", "good_two"], space)


# A wider epsilon spreads the counts, so that the median divides them.
_WIDE = 1.0
_LOOSE = "loose AS (SELECT *, " + ", ".join(
    f"CASE WHEN {a} / least({_A}) - 1 <= {_WIDE} THEN 1 ELSE 0 END AS good_{a[5:]}" for a in ad.ALGOS
) + " FROM metadata)"
_DIFF = f"diff AS (SELECT instances, feature_mean_price / 1e5 AS z_1, feature_n_orders AS z_2, ({_SUM}) / (SELECT max({_SUM}) FROM loose) AS difficulty FROM loose)"


@query("m17_difficulty_score", "SELECT instances, difficulty FROM diff", (ad.METADATA, _LOOSE, _DIFF), "difficulty")
def m17(spark, sf_dir):
    return _difficulty(spark, sf_dir).select("instances", "difficulty")


def _difficulty(spark, sf_dir):
    df = lb.label_good(ad.metadata(spark, sf_dir), ad.ALGOS, _WIDE).selectExpr(
        "instances", "feature_mean_price / 1e5 AS z_1", "feature_n_orders AS z_2", *[f"good_{n}" for n in _NAMES]
    )
    return ml.difficulty_score(df, [f"good_{n}" for n in _NAMES])


@query(
    "m18_difficulty_direction",
    """SELECT med AS median, n_easy, n_hard, dx / norm AS dir_1, dy / norm AS dir_2, cx - dx / norm * len AS easy_1, cy - dy / norm * len AS easy_2,
         cx + dx / norm * len AS hard_1, cy + dy / norm * len AS hard_2
       FROM (SELECT *, sqrt(dx * dx + dy * dy) + 1e-12 AS norm FROM (
         SELECT any_value(med) AS med, count(*) FILTER (difficulty >= med) AS n_easy, count(*) FILTER (difficulty < med) AS n_hard,
           avg(z_1) FILTER (difficulty < med) - avg(z_1) FILTER (difficulty >= med) AS dx,
           avg(z_2) FILTER (difficulty < med) - avg(z_2) FILTER (difficulty >= med) AS dy,
           (min(z_1) + max(z_1)) / 2 AS cx, (min(z_2) + max(z_2)) / 2 AS cy,
           0.3::DOUBLE * greatest(max(z_1) - min(z_1), max(z_2) - min(z_2), 1) AS len
         FROM diff, (SELECT median(difficulty) AS med FROM diff)))""",
    (ad.METADATA, _LOOSE, _DIFF), "median dir_1 dir_2 easy_1 easy_2 hard_1 hard_2",
)
def m18(spark, sf_dir):
    return ml.difficulty_direction(_difficulty(spark, sf_dir))


@query(
    "m19_feature_contribution",
    "SELECT feature, w1, w2, abs(w1) + abs(w2) AS contribution, (row_number() OVER (ORDER BY abs(w1) + abs(w2), feature))::INT AS place FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, z_1) AS w1, corr({f}, z_2) AS w2 FROM points" for f in PF) + ")",
    C, "w1 w2 contribution",
)
def m19(spark, sf_dir):
    one = pts(spark, sf_dir).agg(*[F.struct(F.lit(f).alias("feature"), F.corr(f, "z_1").alias("w1"), F.corr(f, "z_2").alias("w2")).alias(f) for f in PF])
    return ml.feature_contribution(one.select(F.inline(F.array(*PF))))


@query("m20_ridge_map")
def m20(spark, sf_dir):
    """Rows only: a regularised solve."""
    fit = ml.ridge_map(pts(spark, sf_dir), PF)
    return spark.createDataFrame([(f, *c) for f, c in zip(fit.features, fit.coef)], "feature string, w1 double, w2 double")


# The step of an instance to its successor, aimed at a target two ids on, under a given map.
_MAP = ml.RidgeMap(("f0", "f1", "f2"), (0.0, 0.0, 0.0), (0.5, 1.0, 2.0), (0.0, 0.0), ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)), 1.0)


@query(
    "m21_alignment_score",
    """SELECT instance, CASE WHEN tn < 1e-12 OR wn < 1e-12 THEN NULL WHEN sn < 1e-12 THEN 0
          ELSE 0.65 * (s0 * w0 + s1 * w1) / (sn * wn) + 0.35 * (CASE WHEN tn * mn < 1e-12 THEN 0 ELSE (sx * tx + sy * ty) / (tn * mn) END) END AS score
       FROM (SELECT *, sqrt(tx * tx + ty * ty) AS tn, sqrt(sx * sx + sy * sy) AS mn, sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS sn, sqrt(w0 * w0 + w1 * w1) AS wn FROM (
         SELECT a.instance, t.z_1 - a.z_1 AS tx, t.z_2 - a.z_2 AS ty, b.z_1 - a.z_1 AS sx, b.z_2 - a.z_2 AS sy,
           (b.f0 - a.f0) / 0.5 AS s0, (b.f1 - a.f1) AS s1, (b.f2 - a.f2) / 2 AS s2, 0.5 * (t.z_1 - a.z_1) AS w0, 0.5 * (t.z_2 - a.z_2) AS w1
         FROM points a JOIN points b ON b.id = (a.id // 2) * 2 JOIN points t ON t.id = (a.id // 3) * 3))""",
    C, "score",
)
def m21(spark, sf_dir):
    df = pts(spark, sf_dir)

    def side(prefix):
        return [F.col(c).alias(f"{prefix}{c}") for c in ("f0", "f1", "f2", "z_1", "z_2")]

    pairs = (
        df.select("instance", "id", *side("p_"))
        .join(df.select(F.col("id").alias("id2"), *side("c_")), F.expr("id2 = id div 2 * 2"))
        .join(df.select(F.col("id").alias("id3"), F.col("z_1").alias("target_z_1"), F.col("z_2").alias("target_z_2")), F.expr("id3 = id div 3 * 3"))
    )
    return ml.alignment_score(pairs, _MAP, ["instance"])


# Footprints from points: the same cells, clusters and parts in SQL.
_FP_LABELS = [f"good_{n}" for n in _ALGO2]
_FP_CELLS = ("tall AS (" + " UNION ALL ".join(f"SELECT '{c}' AS label, z_1, z_2, {c} AS own FROM plab" for c in _FP_LABELS) + ")", """
size AS (SELECT label, k, x0, y0, greatest(sqrt(area * k / (n * pi()) / 2), ext / 255) AS side FROM (
  SELECT label, n, area, x0, y0, ext, greatest(least(ceil(n / 20.0), 50), 3) AS k FROM (
    SELECT label, sum(own) AS n, (max(z_1) FILTER (own = 1) - min(z_1) FILTER (own = 1)) * (max(z_2) FILTER (own = 1) - min(z_2) FILTER (own = 1)) AS area,
           min(z_1) AS x0, min(z_2) AS y0, greatest(max(z_1) - min(z_1), max(z_2) - min(z_2)) AS ext FROM tall GROUP BY label)) WHERE area > 0)""", """
cells AS (SELECT label, floor((z_1 - x0) / side)::INT AS cx, floor((z_2 - y0) / side)::INT AS cy, count(*) AS n, sum(own) AS good, any_value(k) AS k, any_value(side) AS side
  FROM tall JOIN size USING (label) GROUP BY ALL)""", """
dense AS (SELECT a.label, a.cx, a.cy FROM cells a JOIN cells b ON a.label = b.label AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1
  WHERE a.good > 0 GROUP BY a.label, a.cx, a.cy, a.k HAVING sum(b.good) >= a.k)""", """
reach AS (SELECT label, cx, cy, cx AS rx, cy AS ry FROM dense UNION
  SELECT r.label, r.cx, r.cy, d.cx, d.cy FROM reach r JOIN dense d ON d.label = r.label AND abs(d.cx - r.rx) <= 1 AND abs(d.cy - r.ry) <= 1)""", """
part AS (SELECT label, cx, cy, dense_rank() OVER (PARTITION BY label ORDER BY root)::INT AS part FROM (
  SELECT label, cx, cy, min((rx, ry)) AS root FROM reach GROUP BY label, cx, cy))""", """
member AS (SELECT * FROM part UNION ALL
  SELECT c.label, c.cx, c.cy, min(p.part) FROM cells c JOIN part p ON c.label = p.label AND abs(c.cx - p.cx) <= 1 AND abs(c.cy - p.cy) <= 1
  WHERE c.good > 0 AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.label = c.label AND d.cx = c.cx AND d.cy = c.cy) GROUP BY c.label, c.cx, c.cy)""", """
foot AS (SELECT m.part, c.* FROM member m JOIN cells c USING (label, cx, cy) WHERE c.good >= 0.75 * c.n)""")
_FP_CTES = (ad.POINTS, _POINT_LABELS, *_FP_CELLS)


def _footprint_cells(spark, sf_dir):
    return fp.footprint_cells(labelled(spark, sf_dir), _FP_LABELS)


@query(
    "m16_footprints_from_points",
    """SELECT label, part, count(*) AS cells, count(*) * any_value(side) * any_value(side) AS area, sum(n)::BIGINT AS points, sum(good)::BIGINT AS good, sum(good) / sum(n) AS purity
       FROM foot GROUP BY label, part""",
    _FP_CTES, "area purity",
)
def m16_points(spark, sf_dir):
    return fp.footprint_parts(_footprint_cells(spark, sf_dir))


@query("m16_footprint_outlines", "SELECT label || '|good' AS poly_id, count(*) * any_value(side) * any_value(side) AS area FROM foot GROUP BY label", _FP_CTES, "area")
def m16_outlines(spark, sf_dir):
    """The area inside the outlines; holes subtract."""
    return gm.polygon_area(fp.footprint_polygons(_footprint_cells(spark, sf_dir)))
