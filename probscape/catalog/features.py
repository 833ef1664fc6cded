"""Feature extractors over the corpus view."""

from __future__ import annotations

from probscape import adapters as ad
from probscape.catalog.base import query
from probscape.common import DataError
from probscape.functions import registry as reg
from probscape.functions.features import FeatureRegistry, block_statistics, build_features, fold_symmetric
from pyspark.sql import functions as F

# The definitions, spelled out: every one of the m matrices is a row, empty ones included.
BLOCK_STATS = """
blk AS (SELECT instance, sum(abs(size))::DOUBLE AS total, max(abs(size))::DOUBLE AS largest,
    min(abs(size))::DOUBLE AS smallest, avg(abs(size)) AS mean, stddev_pop(abs(size)) AS std,
    (count(*) FILTER (size > 0))::DOUBLE AS n_sdp, (count(*) FILTER (size < 0))::DOUBLE AS n_lp,
    (count(*) FILTER (abs(size) = 1))::DOUBLE AS n_unit,
    (count(*) FILTER (abs(size) >= 10))::DOUBLE AS n_ge10,
    (count(*) FILTER (abs(size) >= 50))::DOUBLE AS n_ge50,
    coalesce(sum(size) FILTER (size > 0), 0)::DOUBLE AS sdp_size,
    coalesce(sum(-size) FILTER (size < 0), 0)::DOUBLE AS lp_size,
    sum(CASE WHEN size > 0 THEN size * (size + 1) // 2 ELSE -size END)::DOUBLE AS cap_upper,
    sum(CASE WHEN size > 0 THEN size * size ELSE -size END)::DOUBLE AS cap_full,
    string_agg(size::VARCHAR, ';' ORDER BY block_id) AS listed
  FROM blocks GROUP BY instance),
ent AS (SELECT instance, -sum((abs(size) / total) * ln(abs(size) / total)) AS entropy
        FROM blocks JOIN blk USING (instance) GROUP BY instance)
"""
MATRIX_STATS = """
folded AS (SELECT instance, mat_id, block_id, least(row, col) AS row, greatest(row, col) AS col, value FROM entries),
pat AS (SELECT instance, mat_id, count(*)::DOUBLE AS nnz,
               sum(CASE WHEN row = col THEN 1 ELSE 2 END)::DOUBLE AS nnz_full
        FROM (SELECT DISTINCT instance, mat_id, block_id, row, col FROM folded) GROUP BY ALL),
nrm AS (SELECT instance, mat_id, sqrt(sum(value * value * CASE WHEN row = col THEN 1 ELSE 2 END)) AS fro,
               sum(abs(value)) AS l1, max(abs(value)) AS hi, min(abs(value)) FILTER (value <> 0) AS lo
        FROM folded GROUP BY ALL),
mats AS (SELECT p.instance, p.m, t.mat_id, coalesce(nnz, 0) AS nnz, coalesce(nnz_full, 0) AS nnz_full,
                coalesce(fro, 0) AS fro, coalesce(l1, 0) AS l1, hi, lo, hi / nullif(lo, 0) AS span
         FROM problems p, LATERAL (SELECT unnest(generate_series(0, p.m))::INT AS mat_id) t
         LEFT JOIN pat ON pat.instance = p.instance AND pat.mat_id = t.mat_id
         LEFT JOIN nrm ON nrm.instance = p.instance AND nrm.mat_id = t.mat_id),
obj AS (SELECT * FROM mats WHERE mat_id = 0),
con AS (SELECT instance, sum(nnz) AS nnz_sum, avg(nnz) AS nnz_avg, max(nnz) AS nnz_max, min(nnz) AS nnz_min,
               stddev_pop(nnz) AS nnz_std, sum(nnz_full) AS full_sum, avg(nnz_full) AS full_avg,
               (count(*) FILTER (nnz = 0))::DOUBLE AS n_empty,
               avg(fro) AS fro_avg, max(fro) AS fro_max, min(fro) AS fro_min, stddev_pop(fro) AS fro_std,
               avg(l1) AS l1_avg, max(l1) AS l1_max, min(l1) AS l1_min, avg(hi) AS hi_avg, max(hi) AS hi_max,
               avg(lo) AS lo_avg, min(lo) AS lo_min, avg(span) AS span_avg, max(span) AS span_max, min(span) AS span_min
        FROM mats WHERE mat_id > 0 GROUP BY instance),
bee AS (SELECT instance, sum(abs(b)) AS l1, sqrt(sum(b * b)) AS l2, max(abs(b)) AS hi,
               min(abs(b)) FILTER (b <> 0) AS lo, avg(b) AS b_avg, stddev_pop(b) AS b_dev FROM rhs GROUP BY instance),
glo AS (SELECT instance, max(abs(value)) AS hi, min(abs(value)) FILTER (value <> 0) AS lo FROM entries GROUP BY instance)
"""
# One defining expression per feature.
DEFINITION = {
    "m": "p.m::DOUBLE", "n_blocks": "p.n_blocks::DOUBLE", "n_total_matrix": "total",
    "max_block_size": "largest", "min_block_size": "smallest", "mean_block_size": "mean",
    "std_block_size": "std", "num_positive_blocks": "n_sdp", "num_negative_blocks": "n_lp",
    "num_unit_blocks": "n_unit", "sum_positive_blocks": "sdp_size", "sum_negative_abs_blocks": "lp_size",
    "aspect_ratio_m_over_n": "p.m / total", "aspect_ratio_m_over_nsq": "p.m / (total * total)",
    "block_sizes_raw": "listed",
    "num_sdp_blocks": "n_sdp", "num_lp_like_blocks": "n_lp",
    "is_single_block": "(p.n_blocks = 1)::INT::DOUBLE", "is_multi_block": "(p.n_blocks > 1)::INT::DOUBLE",
    "has_sdp_blocks": "(n_sdp > 0)::INT::DOUBLE", "has_lp_blocks": "(n_lp > 0)::INT::DOUBLE",
    "is_pure_sdp": "(n_sdp = p.n_blocks)::INT::DOUBLE",
    "is_mixed_sdp_lp": "(n_sdp > 0 AND n_lp > 0)::INT::DOUBLE",
    "sdp_total_size": "sdp_size", "lp_total_size": "lp_size", "sdp_size_fraction": "sdp_size / total",
    "lp_size_fraction": "lp_size / total", "largest_block_fraction": "largest / total",
    "smallest_block_fraction": "smallest / total", "nonlargest_fraction": "1 - largest / total",
    "block_dominance_ratio": "largest / mean", "block_size_entropy": "ent.entropy",
    "block_size_range": "largest - smallest", "cv_block_size": "std / mean",
    "num_singleton_blocks": "n_unit", "singleton_block_fraction": "n_unit / p.n_blocks",
    "num_large_blocks_ge_10": "n_ge10", "num_large_blocks_ge_50": "n_ge50",
    "large_blocks_ge_10_fraction": "n_ge10 / p.n_blocks", "large_blocks_ge_50_fraction": "n_ge50 / p.n_blocks",
    "upper_capacity_per_matrix": "cap_upper", "full_capacity_per_matrix": "cap_full",
    "total_possible_upper_all_ai": "p.m * cap_upper", "total_possible_full_all_ai": "p.m * cap_full",
    "nnz_c_upper": "obj.nnz", "density_c_upper": "obj.nnz / cap_upper",
    "nnz_c_full_implied": "obj.nnz_full", "density_c_full_implied": "obj.nnz_full / cap_full",
    "total_nnz_ai_upper": "con.nnz_sum", "avg_nnz_ai_upper": "con.nnz_avg", "max_nnz_ai_upper": "con.nnz_max",
    "min_nnz_ai_upper": "con.nnz_min", "std_nnz_ai_upper": "con.nnz_std",
    "avg_density_ai_upper": "con.nnz_avg / cap_upper", "max_density_ai_upper": "con.nnz_max / cap_upper",
    "min_density_ai_upper": "con.nnz_min / cap_upper", "std_density_ai_upper": "con.nnz_std / cap_upper",
    "total_density_all_ai_upper": "con.nnz_sum / (p.m * cap_upper)",
    "total_nnz_ai_full_implied": "con.full_sum", "avg_nnz_ai_full_implied": "con.full_avg",
    "avg_density_ai_full_implied": "con.full_avg / cap_full",
    "total_density_all_ai_full_implied": "con.full_sum / (p.m * cap_full)",
    "num_empty_ai": "con.n_empty", "fraction_empty_ai": "con.n_empty / p.m",
    "c_fro_norm_upper": "obj.fro", "c_max_abs_entry": "obj.hi", "c_min_abs_nonzero_entry": "obj.lo",
    "c_dynamic_range": "obj.span", "avg_ai_fro_norm_upper": "con.fro_avg",
    "max_ai_fro_norm_upper": "con.fro_max", "min_ai_fro_norm_upper": "con.fro_min",
    "std_ai_fro_norm_upper": "con.fro_std", "ai_fro_norm_cv": "con.fro_std / con.fro_avg",
    "avg_ai_l1_norm": "con.l1_avg", "max_ai_l1_norm": "con.l1_max", "min_ai_l1_norm": "con.l1_min",
    "avg_ai_max_abs_entry": "con.hi_avg", "max_ai_max_abs_entry": "con.hi_max",
    "avg_ai_min_abs_nonzero_entry": "con.lo_avg", "min_ai_min_abs_nonzero_entry": "con.lo_min",
    "avg_ai_dynamic_range": "con.span_avg", "max_ai_dynamic_range": "con.span_max",
    "min_ai_dynamic_range": "con.span_min", "b_l1_norm": "bee.l1", "b_l2_norm": "bee.l2",
    "b_max_abs": "bee.hi", "b_min_abs_nonzero": "bee.lo", "b_dynamic_range": "bee.hi / nullif(bee.lo, 0)",
    "b_mean": "bee.b_avg", "b_std": "bee.b_dev", "global_all_coeff_max_abs": "glo.hi",
    "global_all_coeff_min_abs_nonzero": "glo.lo", "global_all_coeff_dynamic_range": "glo.hi / nullif(glo.lo, 0)",
    "ratio_c_to_avg_ai_fro": "obj.fro / nullif(con.fro_avg, 0)", "ratio_c_to_b_l2": "obj.fro / nullif(bee.l2, 0)",
    "ratio_avg_ai_to_b_l2": "con.fro_avg / nullif(bee.l2, 0)",
    "max_ai_to_min_ai_fro_ratio": "con.fro_max / nullif(con.fro_min, 0)",
    "max_ai_to_avg_ai_fro_ratio": "con.fro_max / nullif(con.fro_avg, 0)",
}
_JOINS = {
    "size": "JOIN blk USING (instance)",
    "structure": "JOIN blk USING (instance) JOIN ent USING (instance)",
    "sparsity": "JOIN blk USING (instance) JOIN obj USING (instance) JOIN con USING (instance)",
    "scaling": "JOIN obj USING (instance) JOIN con USING (instance) JOIN bee USING (instance) "
    "LEFT JOIN glo USING (instance)",
}
_ALL_JOINS = (
    "JOIN blk USING (instance) JOIN ent USING (instance) JOIN obj USING (instance) "
    "JOIN con USING (instance) JOIN bee USING (instance) LEFT JOIN glo USING (instance)"
)
CTES = (ad.CORPUS, BLOCK_STATS, MATRIX_STATS)


def feature_sql(names: list[str], joins: str) -> tuple[str, str]:
    body = "SELECT p.instance, " + ", ".join(
        f"{DEFINITION[n]} AS feature_{n}" for n in names
    ) + f" FROM problems p {joins}"
    return body, " ".join(f"feature_{n}" for n in names if n != "block_sizes_raw")


def _register(name: str, names: list[str], joins: str) -> None:
    sql, doubles = feature_sql(names, joins)

    @query(name, sql, CTES, doubles)
    def run(spark, sf_dir, wanted=tuple(f"feature_{n}" for n in names)):
        return build_features(ad.corpus(spark, sf_dir), wanted)


G = reg.FEATURE_GROUPS
_register("a1_size_features", G["size"], _JOINS["size"])
_register("a2_structure_features", G["structure"], _JOINS["structure"])
_register("a3_sparsity_capacity", G["sparsity"][:4], _JOINS["sparsity"])
_register("a4_sparsity_objective", G["sparsity"][4:8], _JOINS["sparsity"])
_register("a5_sparsity_constraints", G["sparsity"][8:], _JOINS["sparsity"])
_register("a6_scaling_objective", G["scaling"][:4], _JOINS["scaling"])
_register("a7_scaling_constraints", G["scaling"][4:19], _JOINS["scaling"])
_register("a8_scaling_rhs", G["scaling"][19:26], _JOINS["scaling"])
_register("a9_scaling_global", G["scaling"][26:29], _JOINS["scaling"])
_register("a10_scaling_ratios", G["scaling"][29:], _JOINS["scaling"])
_register("a11_build_features", [n.removeprefix("feature_") for n in reg.DEFAULT_ENABLED], _ALL_JOINS)
_register("a11_build_features_all", [n for names in G.values() for n in names], _ALL_JOINS)
_register("s4_header_only", ["m", "n_blocks", "n_total_matrix", "num_sdp_blocks", "num_lp_like_blocks"], _JOINS["size"])


@query(
    "p1_fold_symmetric",
    "SELECT instance, mat_id, block_id, row, col, count(*) AS n, sum(value) AS value "
    "FROM folded GROUP BY ALL",
    CTES, "value",
)
def p1(spark, sf_dir):
    return (
        fold_symmetric(ad.corpus(spark, sf_dir).entries)
        .groupBy("instance", "mat_id", "block_id", "row", "col")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    )


@query(
    "p5_select_features",
    *(lambda s: (s[0], CTES, s[1]))(
        feature_sql(["b_l2_norm", "max_block_size", "nnz_c_upper", "total_nnz_ai_upper"], _ALL_JOINS)
    ),
)
def p5(spark, sf_dir):
    """The checks run when the plan is made; the choice then prunes columns and tables."""
    wanted = ["feature_max_block_size", "feature_nnz_c_upper", "feature_b_l2_norm", "feature_total_nnz_ai_upper"]
    for bad in (wanted + wanted[:1], ["feature_nothing"], []):
        try:
            reg.select_features(bad)
        except DataError:
            continue
        raise AssertionError(f"accepted {bad}")
    return build_features(ad.corpus(spark, sf_dir), wanted)


@query(
    "p6_needed_only",
    *(lambda s: (s[0], CTES, s[1]))(feature_sql(["m", "max_block_size"], _ALL_JOINS)),
)
def p6(spark, sf_dir):
    have = ["instances", "source", "feature_m", "feature_max_block_size", "feature_gone", "algo_view"]
    groups, _ = reg.needed_only(have, reg.DEFAULT_ENABLED, ad.SOLVERS)
    return build_features(ad.corpus(spark, sf_dir), [n for names in groups.values() for n in names])


@query(
    "u1_register_features",
    "SELECT p.instance, feature_asymmetry, total / p.n_blocks AS feature_mean_width, p.m::DOUBLE AS feature_m "
    "FROM problems p JOIN blk USING (instance) LEFT JOIN (SELECT instance, "
    "avg(CASE WHEN row <> col THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS feature_asymmetry "
    "FROM entries GROUP BY instance) USING (instance)",
    CTES, "feature_asymmetry feature_mean_width feature_m",
)
def u1(spark, sf_dir):
    registry = FeatureRegistry()
    registry.register_features(
        "triangle", ["feature_asymmetry"],
        lambda c: c.entries.groupBy("instance").agg(
            F.avg((F.col("row") != F.col("col")).cast("double")).alias("feature_asymmetry")
        ),
    )
    registry.register_features(
        "width", ["feature_mean_width"],
        lambda c: block_statistics(c.blocks).select("instance", F.col("mean").alias("feature_mean_width")),
    )
    return build_features(
        ad.corpus(spark, sf_dir), ["feature_asymmetry", "feature_mean_width", "feature_m"], registry
    )
