"""The composed jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from probscape import adapters as ad
from probscape.catalog import features as cf
from probscape.catalog.base import query
from probscape.operators import coverage as cv
from probscape.operators.augment import restrict
from probscape.plans import jobs
from probscape.sources.tables import shared_path

_FEATURES = ["m", "n_total_matrix", "max_block_size", "total_nnz_ai_upper", "c_fro_norm_upper", "b_l2_norm"]
_RUNS = """
wide AS (SELECT 'inst' || user_id AS instance, max(value) FILTER (event_type = 'click') AS algo_click,
           max(value) FILTER (event_type = 'view') AS algo_view FROM events GROUP BY 1)
"""


def _metadata(spark, sf_dir):
    runs = ad.runs(spark, sf_dir).withColumn("instance", F.concat(F.lit("inst"), F.substring("instance", 2, 20)))
    c = ad.corpus(spark, sf_dir)
    sources = c.problems.select("instance", F.lit("SDPLIB").alias("source"))
    return jobs.build_metadata_job(
        spark, c, runs, sources, ["click", "view"], jobs.Stages(shared_path(spark, "stages")), [f"feature_{n}" for n in _FEATURES]
    )


@query(
    "l1_build_metadata",
    "SELECT f.* RENAME (instance AS \"Instances\"), 'SDPLIB' AS \"Source\", algo_click, algo_view FROM ("
    + cf.feature_sql(_FEATURES, cf._ALL_JOINS)[0] + ") f JOIN wide USING (instance)",
    (*cf.CTES, _RUNS), " ".join(f"feature_{n}" for n in _FEATURES) + " algo_click algo_view",
)
def l1(spark, sf_dir):
    return _metadata(spark, sf_dir)


@query("l2_build_space")
def l2(spark, sf_dir):
    """Rows only: fitted exponents and eigenvectors."""
    space = jobs.build_space(ad.metadata(spark, sf_dir).drop("k"))
    return space.coords.join(space.labels.select("instances", "num_good", "best_algo"), "instances")


@query("l3_fill_gaps")
def l3(spark, sf_dir):
    """Rows only: one generation of mutated children per empty-space target."""
    meta = _metadata(spark, sf_dir)
    space = jobs.build_space(meta)
    targets = cv.find_empty_space(space.coords, grid_size=40, top_k=4)
    plain = meta.withColumnsRenamed({"Instances": "instances", "Source": "source"})
    corpus = restrict(ad.corpus(spark, sf_dir), space.coords.select(F.col("instances").alias("instance")))
    _, best = jobs.fill_gaps(corpus, plain, space.coords, space.model, targets, 12, 5)
    return best.select("instances", "source", "target_id", "place", "fitness", "z_1", "z_2")
