"""Metadata tables, runs and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from probscape import adapters as ad
from probscape.catalog.base import query
from probscape.common import table
from probscape.functions import diagnostics as dg
from probscape.operators import metadata as md
from probscape.operators import runs as rn
from probscape.sources.tables import shared_path

B = (ad.METADATA,)
FEAT = " ".join(ad.FEATURES)
ALGO = " ".join(ad.ALGOS)
BOTH = f"{FEAT} {ALGO}"
F_LIST, A_LIST = ", ".join(ad.FEATURES), ", ".join(ad.ALGOS)


def base(spark, sf_dir, ordered=False):
    return ad.metadata(spark, sf_dir, ordered)


# ---------------------------------------------------------------- projections and checks


@query(
    "p2_classify_source",
    """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE label END AS strict_label,
         CASE WHEN page_id % 9 = 0 THEN 'Unknown' ELSE label END AS lenient_label
       FROM (SELECT page_id, CASE split_part(url, '/', 4) WHEN 'de' THEN 'SDPLIB' WHEN 'en' THEN 'DIMACS'
         WHEN 'es' THEN 'Genetically Generated to Fill Empty Space'
         ELSE 'Genetically Generated from Point Target' END AS label FROM pages)""",
)
def p2(spark, sf_dir):
    folder = (
        "CASE split(url, '/')[3] WHEN 'de' THEN 'sdplib' WHEN 'en' THEN 'DIMACS' "
        "WHEN 'es' THEN 'genetic generated/fill empty space' ELSE 'genetic generated/point target' END"
    )
    paths = table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"concat('/corpus/', CASE WHEN page_id % 9 = 0 THEN 'elsewhere' ELSE {folder} END, "
        "'/p', cast(page_id AS string), '.dat-s') AS path",
    )
    known = ~F.col("path").contains("/elsewhere/")
    return paths.select(
        "page_id",
        F.when(known, md.classify_source(F.col("path"), "/corpus")).alias("strict_label"),
        md.classify_source(F.col("path"), strict=False).alias("lenient_label"),
    )


@query(
    "p3_normalize_keys",
    "SELECT k::VARCHAR AS instances, source, feature_n_orders, feature_mean_price AS z_1, "
    "feature_price_sum AS z_2 FROM metadata",
    B, "feature_n_orders z_1 z_2",
)
def p3(spark, sf_dir):
    odd = base(spark, sf_dir).select(
        F.col("k").alias("Row"), F.col("source").alias("SOURCE"), "feature_n_orders",
        F.col("feature_mean_price").alias("Z1"), F.col("feature_price_sum").alias("z_2"),
    )
    return md.normalize_keys(odd)


_ORDERED = ",".join(["instances", "source", *sorted(ad.FEATURES), *sorted(ad.ALGOS), "k"])


@query(
    "p4_order_columns",
    f"SELECT instances, k, '{_ORDERED}' AS column_order FROM metadata", B,
)
def p4(spark, sf_dir):
    df = base(spark, sf_dir)
    mixed = md.order_columns(df.select("k", *reversed(ad.ALGOS), "source", *reversed(ad.FEATURES), "instances"))
    return mixed.select("instances", "k", F.lit(",".join(mixed.columns)).alias("column_order"))


@query(
    "p7_validate_patch",
    "SELECT instances, source, feature_n_orders FROM metadata", B, "feature_n_orders",
)
def p7(spark, sf_dir):
    patch = base(spark, sf_dir).select("instances", "source", "feature_n_orders")
    md.validate_patch(patch.columns, ("feature_",))
    return patch


@query("p8_validate_metadata", f"SELECT instances, {F_LIST}, {A_LIST} FROM metadata", B, BOTH)
def p8(spark, sf_dir):
    df = base(spark, sf_dir).select("instances", *ad.FEATURES, *ad.ALGOS)
    md.validate_metadata(df.columns)
    return df


_RUN_SQL = """
SELECT event_id, style, p AS phi, coalesce(p <= {tol}, false) AS optimal,
  CASE WHEN coalesce(p <= {tol}, false) THEN 'OPTIMAL'
       WHEN style = 'sdpt3' AND st IN ('OPTIMAL', 'STOPPED', 'TIME_LIMIT', 'FAILED') THEN st
       WHEN style = 'sedumi' AND st IN ('TIME_LIMIT', 'FAILED') THEN st ELSE 'STOPPED' END AS status
FROM (SELECT event_id, style, upper(coalesce(status, 'FAILED')) AS st,
        CASE WHEN style = 'sedumi' AND phi IS NOT NULL THEN phi
             WHEN gap IS NULL OR pinfeas IS NULL OR dinfeas IS NULL THEN NULL
             ELSE greatest(gap, pinfeas, dinfeas) END AS p
      FROM raw, (VALUES ('sdpt3'), ('sedumi')) AS v(style))
""".format(tol=ad.RUN_TOL)


@query("p11_normalize_run", _RUN_SQL, (ad.RAW_RESULTS,), "phi")
def p11(spark, sf_dir):
    raw = ad.raw_results(spark, sf_dir)
    out = [
        rn.normalize_run(raw, style, ad.RUN_TOL).select(
            "event_id", F.lit(style).alias("style"), "phi", "optimal", "status"
        )
        for style in ("sdpt3", "sedumi")
    ]
    return out[0].unionByName(out[1])


@query(
    "p12_run_status",
    f"""SELECT event_id,
      CASE WHEN runtime > {ad.RUN_LIMIT} THEN 'TIME_LIMIT' WHEN phi <= {ad.RUN_TOL} THEN 'OPTIMAL' ELSE 'STOPPED' END AS first_style,
      CASE WHEN runtime > {ad.RUN_LIMIT} THEN 'TIME_LIMIT' WHEN phi <= {ad.RUN_TOL} THEN 'OPTIMAL' ELSE 'STOPPED' END AS second_style
    FROM raw""",
    (ad.RAW_RESULTS,),
)
def p12(spark, sf_dir):
    rt, phi = F.col("runtime"), F.col("phi")
    return ad.raw_results(spark, sf_dir).select(
        "event_id",
        rn.run_status(rt, phi, "sdpt3", ad.RUN_LIMIT, ad.RUN_TOL).alias("first_style"),
        rn.run_status(rt, phi, "sedumi", ad.RUN_LIMIT, ad.RUN_TOL).alias("second_style"),
    )


@query(
    "p13_residual_metrics",
    """SELECT event_id, abs(pobj - dobj) / (1 + abs(pobj) + abs(dobj)) AS gap,
         runtime / (1 + user_k) AS pinfeas, greatest(0, -(runtime - 20)) / (1 + user_k * 2) AS dinfeas FROM raw""",
    (ad.RAW_RESULTS,), "gap pinfeas dinfeas",
)
def p13(spark, sf_dir):
    k = F.col("user_k").cast("double")
    m = rn.residual_metrics(F.col("pobj"), F.col("dobj"), F.col("runtime"), k, F.col("runtime") - 20, k * 2)
    return ad.raw_results(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in m.items()])


@query(
    "p14_safe_runtime",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN value END AS runtime FROM events""", doubles="runtime",
)
def p14(spark, sf_dir):
    text = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN cast(value AS string) WHEN 2 THEN '' ELSE 'nan' END AS t"
    )
    return text.select("event_id", rn.safe_runtime(F.col("t")).alias("runtime"))


@query(
    "p15_drop_null_coords",
    "SELECT instance, z_1, z_2 FROM points WHERE id % 5 <> 0 AND id % 7 <> 0", (ad.POINTS,), "z_1 z_2",
)
def p15(spark, sf_dir):
    holes = ad.points(spark, sf_dir).selectExpr(
        "instance", "CASE WHEN id % 5 <> 0 THEN z_1 END AS z_1", "CASE WHEN id % 7 <> 0 THEN z_2 ELSE double('NaN') END AS z_2"
    )
    return md.drop_null_coords(holes)


@query(
    "p16_coerce_finite",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN value ELSE 0 END AS feature_a,
              CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS feature_b FROM events""",
    doubles="feature_a feature_b",
)
def p16(spark, sf_dir):
    text = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN cast(value AS string) WHEN 2 THEN 'inf' ELSE 'nan' END AS feature_a",
        "CASE WHEN event_id % 3 = 0 THEN double('-Infinity') ELSE value END AS feature_b",
    )
    return md.coerce_finite(text, ["feature_a", "feature_b"])


# ------------------------------------------------------------------------------- joins

_THIRD = "k % 3 <> 0"


@query(
    "j1_build_metadata",
    f"SELECT instances AS Instances, source AS Source, {F_LIST}, {A_LIST} FROM metadata WHERE k % 3 <> 0 AND k % 5 <> 0",
    B, BOTH,
)
def j1(spark, sf_dir):
    df = base(spark, sf_dir).withColumnRenamed("instances", "Instance")
    path = shared_path(spark, "metadata")
    df.write.parquet(path)  # the three stage tables come from one pass over the orders
    stage = spark.read.parquet(path)
    return md.build_metadata(
        stage.where("k % 3 <> 0").select("Instance", *ad.FEATURES),
        stage.where("k % 5 <> 0").select("Instance", *ad.ALGOS),
        stage.select("Instance", F.col("source").alias("Source")),
    )


@query(
    "j2_attach_source",
    "SELECT instances, feature_mean_price AS z_1, CASE WHEN k % 3 <> 0 THEN source ELSE 'unknown' END AS source FROM metadata",
    B, "z_1",
)
def j2(spark, sf_dir):
    df = base(spark, sf_dir)
    return md.attach_source(df.select("instances", F.col("feature_mean_price").alias("z_1")), df.where(_THIRD))


_J3_SQL = (
    "SELECT instances, source, {f}, CASE WHEN {cond} THEN algo_low END AS algo_low, "
    "CASE WHEN {cond} THEN algo_high END AS algo_high FROM metadata"
).format(f=F_LIST, cond="k % 3 <> 0")


@query("j3_append_instances", _J3_SQL, B, f"{FEAT} algo_low algo_high")
def j3(spark, sf_dir):
    df = base(spark, sf_dir)
    new = df.where("k % 3 = 0").select(F.col("instances").alias("Instances"), "source", *ad.FEATURES)
    return md.append_instances(df.where(_THIRD).select("instances", "source", *ad.FEATURES, "algo_low", "algo_high"), new)


@query(
    "j4_merge_patch",
    """SELECT instances, CASE WHEN k % 4 = 0 THEN 'patched' ELSE source END AS source,
        CASE WHEN k % 4 = 0 THEN (CASE WHEN k % 8 = 0 THEN NULL ELSE feature_n_orders + 1 END) ELSE feature_n_orders END AS feature_n_orders,
        feature_price_sum, CASE WHEN k % 4 = 0 THEN feature_mean_price * 2 END AS feature_new FROM metadata""",
    B, "feature_n_orders feature_price_sum feature_new",
)
def j4(spark, sf_dir):
    df = base(spark, sf_dir)
    patch = df.where("k % 4 = 0").selectExpr(
        "instances AS Instances", "'patched' AS Source",
        "CASE WHEN k % 8 = 0 THEN NULL ELSE feature_n_orders + 1 END AS feature_n_orders",
        "feature_mean_price * 2 AS feature_new",
    )
    return md.merge_patch(df.select("instances", "source", "feature_n_orders", "feature_price_sum"), patch, ("feature_",))


@query(
    "j5_build_metadata_test",
    """SELECT instances, source, CASE WHEN k % 6 = 0 THEN feature_n_orders + 10 ELSE feature_n_orders END AS feature_n_orders,
        CASE WHEN k % 5 = 0 THEN algo_high WHEN k % 3 = 0 THEN NULL ELSE algo_low END AS algo_low,
        CASE WHEN k % 5 = 0 THEN algo_plain END AS algo_plain FROM metadata""",
    B, "feature_n_orders algo_low algo_plain",
)
def j5(spark, sf_dir):
    df = base(spark, sf_dir)
    return md.build_metadata_test(
        df.where(_THIRD).selectExpr("instances AS Instance", "source AS Source", "feature_n_orders", "algo_low"),
        df.where("k % 3 = 0").select("instances", "source", "feature_n_orders"),
        df.where("k % 6 = 0").selectExpr("instances", "feature_n_orders + 10 AS feature_n_orders"),
        df.where("k % 5 = 0").selectExpr("instances", "algo_high AS algo_low", "algo_plain"),
    )


@query(
    "j6_append_if_absent",
    """SELECT instance, solver, runtime, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts, event_id) AS rn FROM runs
        WHERE solver <> 'view' AND instance NOT IN (SELECT instance FROM runs WHERE solver = 'view'))
       WHERE rn = 1
       UNION ALL SELECT instance, 'view', max(runtime), NULL FROM runs WHERE solver = 'view' GROUP BY instance""",
    (ad.RUNS,), "runtime",
)
def j6(spark, sf_dir):
    """Users with a view are stored; the first other run of everyone else is new."""
    all_runs = ad.runs(spark, sf_dir)
    view = F.col("solver") == "view"
    have = all_runs.where(view).groupBy("instance").agg(
        F.lit("view").alias("solver"), F.max("runtime").alias("runtime"), F.lit(None).cast("bigint").alias("event_id")
    )
    return md.append_if_absent(have, all_runs.where(~view), "instance", ["ts", "event_id"])


@query(
    "j7_missing_instances",
    "SELECT source, instances FROM metadata WHERE k % 3 = 0 AND k % 2 = 0", B,
)
def j7(spark, sf_dir):
    df = base(spark, sf_dir)
    return md.missing_instances(
        df.select("source", "instances"), df.where(_THIRD), df.where("k % 2 = 0").select("source", "instances")
    )


@query(
    "j8_backfill_column",
    """SELECT instances, CASE WHEN k % 4 = 1 THEN coalesce((round(algo_low))::BIGINT::VARCHAR, '') ELSE '' END AS algo_low
       FROM metadata""",
    B,
)
def j8(spark, sf_dir):
    df = base(spark, sf_dir, ordered=True)
    no_column = df.select("instances", "algo_high")
    chosen = df.where("k % 4 = 1").selectExpr("instances AS Instance", "cast(round(algo_low) AS bigint) AS algo_low")
    ignored = df.selectExpr("instances", "-1 AS algo_low")
    return md.backfill_column(df.select("instances"), "algo_low", [no_column, chosen, ignored])


@query(
    "j12_template_row",
    """SELECT 'new' || c.k AS instances, 'Genetically Generated to Fill Empty Space' AS source,
         c.feature_mean_price * 2 AS feature_mean_price, s.feature_n_orders, s.algo_low, s.algo_high
       FROM metadata c JOIN metadata s ON s.k = c.k // 10 * 10""",
    B, "feature_mean_price feature_n_orders algo_low algo_high",
)
def j12(spark, sf_dir):
    df = base(spark, sf_dir)
    cand = df.selectExpr(
        "concat('new', cast(k AS string)) AS instances", "concat('c', cast(k div 10 * 10 AS string)) AS seed",
        "feature_mean_price * 2 AS feature_mean_price",
    )
    return md.template_row(cand, df.select("instances", "source", "feature_mean_price", "feature_n_orders", "algo_low", "algo_high"), strict=False)


# ------------------------------------------------------------------------- diagnostics


@query(
    "a12_build_runs_wide",
    "SELECT instance, " + ", ".join(
        f"arg_min(runtime, (ts, event_id)) FILTER (solver = '{s}') AS algo_{s}" for s in ad.SOLVERS
    ) + " FROM runs GROUP BY instance",
    (ad.RUNS,), " ".join(f"algo_{s}" for s in ad.SOLVERS),
)
def a12(spark, sf_dir):
    return rn.build_runs_wide(ad.runs(spark, sf_dir), ad.SOLVERS, first_by=["ts", "event_id"])


_DIAG_COLS = [*ad.FEATURES, "feature_low", "feature_none", "feature_const"]


@query(
    "a13_feature_diagnostics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, "
        f"count(DISTINCT {c}) <= 1 AS constant, count({c}) = 0 AS all_missing FROM wide"
        for c in _DIAG_COLS
    ),
    (ad.METADATA, "wide AS (SELECT *, algo_low AS feature_low, NULL::DOUBLE AS feature_none, 3.0::DOUBLE AS feature_const FROM metadata)"),
)
def a13(spark, sf_dir):
    df = base(spark, sf_dir, ordered=True).withColumns({
        "feature_low": F.col("algo_low"), "feature_none": F.lit(None).cast("double"), "feature_const": F.lit(3.0)
    })
    return dg.feature_diagnostics(df)


@query(
    "a14_algorithm_diagnostics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS algorithm, count(*) - count({c}) AS missing, count({c}) AS present, min({c}) AS min, max({c}) AS max, "
        f"(SELECT count(*) FROM metadata WHERE coalesce({A_LIST}) IS NULL) AS rows_all_missing FROM metadata"
        for c in ad.ALGOS
    ),
    B, "min max",
)
def a14(spark, sf_dir):
    return dg.algorithm_diagnostics(base(spark, sf_dir))


@query(
    "a15_metadata_summary",
    f"SELECT count(*) AS rows, {3 + len(ad.FEATURES) + len(ad.ALGOS)} AS columns, {len(ad.FEATURES)} AS features, "
    f"{len(ad.ALGOS)} AS algorithms, true AS has_source FROM metadata",
    B,
)
def a15(spark, sf_dir):
    return dg.metadata_summary(base(spark, sf_dir))


@query(
    "a18_find_duplicates",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def a18(spark, sf_dir):
    return md.find_duplicates(table(spark, sf_dir, "orders"), "o_custkey")


_CORR = [*ad.POINT_FEATURES, "label"]


@query(
    "a19_correlation_matrix",
    "SELECT x.c AS a, y.c AS b, corr(x.v, y.v) AS r FROM tall x JOIN tall y USING (id) GROUP BY x.c, y.c",
    (ad.POINTS, "tall AS (UNPIVOT (SELECT id, label::DOUBLE AS label, " + ", ".join(ad.POINT_FEATURES) + " FROM points) ON " + ", ".join(_CORR) + " INTO NAME c VALUE v)"), "r",
)
def a19(spark, sf_dir):
    return dg.correlation_matrix(ad.points(spark, sf_dir).withColumn("gone", F.lit(None).cast("double")), [*_CORR, "gone"])


# ---------------------------------------------------------------------------- streaming


@query(
    "t1_stream_append",
    """SELECT instance, solver, runtime, event_id FROM runs
       QUALIFY row_number() OVER (PARTITION BY instance ORDER BY ts, event_id) = 1""",
    (ad.RUNS,), "runtime",
)
def t1(spark, sf_dir):
    from probscape.streaming.append import read_appended, stream_append

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t")
    stream = events.select(
        "event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("instance"),
        F.col("event_type").alias("solver"), F.col("value").alias("runtime"),
    )
    out = shared_path(spark, "appended")
    q = stream_append(stream, out, shared_path(spark, "offsets"), "instance", ["ts", "event_id"])
    q.awaitTermination()
    return read_appended(spark, out).select("instance", "solver", "runtime", "event_id")
