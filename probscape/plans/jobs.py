"""The composed jobs: metadata build, space build, and one generation of gap filling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probscape.common import cut, keep, prefixed
from probscape.functions import labels as lb
from probscape.functions import model as ml
from probscape.functions.draws import Draws, HashDraws
from probscape.functions.features import KEY, Corpus, FeatureRegistry, build_features
from probscape.functions.registry import DEFAULT_ENABLED
from probscape.operators import augment as ag
from probscape.operators import coverage as cv
from probscape.operators import metadata as md
from probscape.operators.geometry import as_polygon
from probscape.operators.nearest import nearest_seed
from probscape.operators.runs import build_runs_wide
from probscape.sources.tables import load_stage


@dataclass(frozen=True)
class Stages:
    """Where the three stage tables live, and which of them are built or loaded."""

    folder: str
    features: str = "build"
    runtimes: str = "build"
    sources: str = "build"


def build_metadata_job(
    spark: SparkSession, corpus: Corpus, runs: DataFrame, sources: DataFrame, solvers: Sequence[str],
    stages: Stages, enabled: Sequence[str] = tuple(DEFAULT_ENABLED), registry: FeatureRegistry | None = None,
) -> DataFrame:
    """Features, runtimes and sources, each persisted as a stage table, joined into metadata.

    The entries are read once, for the features; the join then works on the small stages.
    """
    def stage(mode, name, build):
        return load_stage(spark, mode, f"{stages.folder}/{name}", build, what=name)

    features = stage(
        stages.features, "features", lambda: build_features(corpus, enabled, registry).withColumnRenamed(KEY, "Instance")
    )
    runtimes = stage(stages.runtimes, "runtimes", lambda: build_runs_wide(runs, solvers).withColumnRenamed(KEY, "Instance"))
    source = stage(stages.sources, "sources", lambda: sources.select(F.col(KEY).alias("Instance"), F.col("source").alias("Source")))
    return md.build_metadata(features, runtimes, source)


@dataclass(frozen=True)
class Space:
    model: ml.Model
    coords: DataFrame
    labels: DataFrame
    outline: DataFrame


def build_space(
    metadata: DataFrame, features: Sequence[str] | None = None, rho: float | None = None, epsilon: float = lb.GOOD_EPSILON
) -> Space:
    """Normalise the features, project to the plane, label good algorithms, draw the outline.

    Rows without a value in every feature are left out of the fit; they are labelled like all others
    and have null coordinates. Runtimes that are missing count as the worst of their column in the
    projection.
    """
    meta = md.normalize_keys(metadata)
    md.validate_metadata(meta.columns)
    algos = sorted(prefixed(meta.columns, "algo_"))
    names = list(features or sorted(prefixed(meta.columns, "feature_")))
    whole = keep(meta.dropna(subset=names))
    model = ml.fit_normalisation(whole, names)
    performance = lb.performance_transform(whole, algos, ["instances"])
    worst = performance.agg(*[F.max(a).alias(a) for a in algos]).first()
    filled = performance.select("instances", *[F.coalesce(F.col(a), F.lit(worst[a])).alias(a) for a in algos])
    normed = keep(ml.apply_norm(whole, model, ["instances"]).join(filled, "instances"))
    if rho is not None:
        names = [r["feature"] for r in ml.select_features_by_corr(normed, names, algos, rho).orderBy("feature").collect()]
    weights = ml.fit_projection(normed, names, algos)
    model = {n: ml.FeatureModel(*[getattr(model[n], f) for f in ("lo", "hi", "min_x", "lam", "mu", "sigma")], *weights[n]) for n in names}
    coords = meta.select("instances").join(ml.project(normed, weights, ["instances"]), "instances", "left")
    good = lb.label_good(meta, algos, epsilon)
    labels = lb.portfolio(lb.num_good(good, [f"good_{a.removeprefix('algo_')}" for a in algos]), algos)
    outline = ml.outline(metadata.sparkSession, ml.feature_box(normed, weights))
    return Space(model, coords, labels.drop(*names), outline)


def fill_gaps(
    corpus: Corpus, metadata: DataFrame, coords: DataFrame, model: ml.Model, targets: DataFrame,
    children: int = 30, mu: int = 10, outline: DataFrame | None = None, draws: Draws | None = None,
) -> tuple[Corpus, DataFrame]:
    """One generation for all targets at once: ``(children's corpus, best mu per target)``.

    The instance nearest to a target seeds it; ``children`` mutated copies of the seed are
    measured, projected and ranked by their distance to the target.
    """
    draws = draws or HashDraws()
    aims = nearest_seed(targets, coords.withColumnRenamed("instances", KEY)).select(
        "target_id", F.col("z_1").alias("target_z_1"), F.col("z_2").alias("target_z_2"), F.col("seed_instance").alias("seed")
    )
    aims = cut(aims)
    born = cut(
        aims.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(children))))
        .withColumn("child", F.concat_ws("-", F.lit("gen"), "target_id", "seed", F.col("n").cast("string")))
    )
    seeds = ag.restrict(corpus, aims.select(F.col("seed").alias(KEY)))
    unique = Corpus(seeds.problems, seeds.blocks, seeds.rhs, ag.unique_entries(seeds.entries))
    grown = ag.mutate(ag.copies(unique, born.select("child", F.col("seed").alias("parent"))), draws)
    offspring = Corpus(*[cut(t) for t in (grown.problems, grown.blocks, grown.rhs, grown.entries)])
    wanted = [n if n.startswith("feature_") else f"feature_{n}" for n in model]
    features = build_features(offspring, wanted)
    rows = md.template_row(
        features.withColumnRenamed(KEY, "instances").join(born.select(F.col("child").alias("instances"), "seed"), "instances"),
        metadata,
    )
    placed = ml.apply_model(rows, model, ["instances"]).join(
        born.select(F.col("child").alias("instances"), "target_id", "target_z_1", "target_z_2"), "instances"
    )
    ring = as_polygon(outline) if outline is not None else None
    scored = cv.score_candidates(placed.withColumn("poly_id", F.lit("p")), ring)
    best = cv.survivors(scored, mu)
    return offspring, best.join(rows, "instances")
