"""Names of the features each extractor group provides, and the choice among them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from probscape.common import DataError

# The feature names of the four built-in groups, in output order.
FEATURE_GROUPS: dict[str, list[str]] = {
    "size": [
        "m", "n_blocks", "n_total_matrix", "max_block_size", "min_block_size",
        "mean_block_size", "std_block_size", "num_positive_blocks", "num_negative_blocks",
        "num_unit_blocks", "sum_positive_blocks", "sum_negative_abs_blocks",
        "aspect_ratio_m_over_n", "aspect_ratio_m_over_nsq", "block_sizes_raw",
    ],
    "structure": [
        "num_sdp_blocks", "num_lp_like_blocks", "is_single_block", "is_multi_block",
        "has_sdp_blocks", "has_lp_blocks", "is_pure_sdp", "is_mixed_sdp_lp",
        "sdp_total_size", "lp_total_size", "sdp_size_fraction", "lp_size_fraction",
        "largest_block_fraction", "smallest_block_fraction", "nonlargest_fraction",
        "block_dominance_ratio", "block_size_entropy", "block_size_range", "cv_block_size",
        "num_singleton_blocks", "singleton_block_fraction", "num_large_blocks_ge_10",
        "num_large_blocks_ge_50", "large_blocks_ge_10_fraction", "large_blocks_ge_50_fraction",
    ],
    "sparsity": [
        "upper_capacity_per_matrix", "full_capacity_per_matrix",
        "total_possible_upper_all_ai", "total_possible_full_all_ai",
        "nnz_c_upper", "density_c_upper", "nnz_c_full_implied", "density_c_full_implied",
        "total_nnz_ai_upper", "avg_nnz_ai_upper", "max_nnz_ai_upper", "min_nnz_ai_upper",
        "std_nnz_ai_upper", "avg_density_ai_upper", "max_density_ai_upper",
        "min_density_ai_upper", "std_density_ai_upper", "total_density_all_ai_upper",
        "total_nnz_ai_full_implied", "avg_nnz_ai_full_implied",
        "avg_density_ai_full_implied", "total_density_all_ai_full_implied",
        "num_empty_ai", "fraction_empty_ai",
    ],
    "scaling": [
        "c_fro_norm_upper", "c_max_abs_entry", "c_min_abs_nonzero_entry", "c_dynamic_range",
        "avg_ai_fro_norm_upper", "max_ai_fro_norm_upper", "min_ai_fro_norm_upper",
        "std_ai_fro_norm_upper", "ai_fro_norm_cv", "avg_ai_l1_norm", "max_ai_l1_norm",
        "min_ai_l1_norm", "avg_ai_max_abs_entry", "max_ai_max_abs_entry",
        "avg_ai_min_abs_nonzero_entry", "min_ai_min_abs_nonzero_entry",
        "avg_ai_dynamic_range", "max_ai_dynamic_range", "min_ai_dynamic_range",
        "b_l1_norm", "b_l2_norm", "b_max_abs", "b_min_abs_nonzero", "b_dynamic_range",
        "b_mean", "b_std", "global_all_coeff_max_abs", "global_all_coeff_min_abs_nonzero",
        "global_all_coeff_dynamic_range", "ratio_c_to_avg_ai_fro", "ratio_c_to_b_l2",
        "ratio_avg_ai_to_b_l2", "max_ai_to_min_ai_fro_ratio", "max_ai_to_avg_ai_fro_ratio",
    ],
}

# The features switched on by default.
DEFAULT_ENABLED: list[str] = [
    "feature_m", "feature_n_blocks", "feature_n_total_matrix", "feature_max_block_size",
    "feature_min_block_size", "feature_mean_block_size", "feature_std_block_size",
    "feature_num_sdp_blocks", "feature_largest_block_fraction", "feature_nnz_c_upper",
    "feature_density_c_upper", "feature_total_nnz_ai_upper", "feature_avg_density_ai_upper",
    "feature_c_fro_norm_upper", "feature_c_max_abs_entry", "feature_b_l2_norm",
    "feature_global_all_coeff_dynamic_range",
]

#: The one feature that is text; all others are doubles.
TEXT_FEATURES = {"feature_block_sizes_raw"}


def builtin_groups() -> dict[str, list[str]]:
    return {g: [f"feature_{n}" for n in names] for g, names in FEATURE_GROUPS.items()}


def select_features(
    enabled: Sequence[str], available: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[str]]:
    """Enabled names per group, groups without any left out.

    Refused: an empty choice, a name chosen twice, an unknown name, and a name that two
    groups (or one group twice) claim to provide.
    """
    groups = dict(available) if available is not None else builtin_groups()
    owner: dict[str, str] = {}
    for group, names in groups.items():
        for name in names:
            if name in owner:
                raise DataError(f"feature {name!r} is provided by {owner[name]!r} and {group!r}")
            owner[name] = group
    if not enabled:
        raise DataError("no feature is enabled")
    repeated = sorted({n for n in enabled if list(enabled).count(n) > 1})
    if repeated:
        raise DataError(f"features enabled twice: {repeated}")
    unknown = [n for n in enabled if n not in owner]
    if unknown:
        raise DataError(f"unknown features: {unknown}")
    chosen: dict[str, list[str]] = {}
    for name in enabled:
        chosen.setdefault(owner[name], []).append(name)
    return {g: chosen[g] for g in groups if g in chosen}


def needed_only(
    existing: Iterable[str],
    enabled: Sequence[str],
    solvers: Sequence[str],
    available: Mapping[str, Sequence[str]] | None = None,
) -> tuple[dict[str, list[str]], list[str]]:
    """The part of the enabled work whose columns the target table already has."""
    have = set(existing)
    groups = {
        g: [n for n in names if n in have]
        for g, names in select_features(enabled, available).items()
    }
    return (
        {g: names for g, names in groups.items() if names},
        [s for s in solvers if f"algo_{s}" in have],
    )
