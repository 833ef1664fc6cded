"""Structural features of block-structured sparse problems.

The corpus is four long tables, keyed by ``instance``:

``problems(instance, m, n_blocks)``, ``blocks(instance, block_id, size)``,
``rhs(instance, mat_id, b)`` and ``entries(instance, mat_id, block_id, row, col, value)``.

Only ``entries`` is large.  It is reduced in steps whose keys get coarser: coordinate →
matrix → instance.  The first shuffle is keyed by the full coordinate, so an instance (or
one matrix) holding a third of all entries still spreads over every task; the later ones
move one row per matrix and per instance.  Every step combines map-side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probscape.common import DataError, ratio
from probscape.functions.registry import (
    DEFAULT_ENABLED,
    TEXT_FEATURES,
    builtin_groups,
    select_features,
)

KEY = "instance"


@dataclass(frozen=True)
class Corpus:
    problems: DataFrame
    blocks: DataFrame
    rhs: DataFrame
    entries: DataFrame


def fold_symmetric(entries: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Move every coordinate to the upper triangle (row ≤ col)."""
    return entries.withColumns({row: F.least(row, col), col: F.greatest(row, col)})


# --------------------------------------------------------------------------- statistics


def block_statistics(blocks: DataFrame) -> DataFrame:
    """One row per instance with every block-level quantity the features need."""
    s = F.abs("size").cast("double")
    is_sdp, is_lp = F.col("size") > 0, F.col("size") < 0
    tri, sq = s * (s + 1) / 2, s * s
    listed = F.array_sort(F.collect_list(F.struct("block_id", "size")))
    return blocks.groupBy(KEY).agg(
        F.sum(s).alias("total"),
        F.max(s).alias("largest"),
        F.min(s).alias("smallest"),
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
        F.count_if(is_sdp).cast("double").alias("n_sdp"),
        F.count_if(is_lp).cast("double").alias("n_lp"),
        F.count_if(s == 1).cast("double").alias("n_unit"),
        F.count_if(s >= 10).cast("double").alias("n_ge10"),
        F.count_if(s >= 50).cast("double").alias("n_ge50"),
        F.coalesce(F.sum(F.when(is_sdp, s)), F.lit(0.0)).alias("sdp_size"),
        F.coalesce(F.sum(F.when(is_lp, s)), F.lit(0.0)).alias("lp_size"),
        F.coalesce(F.sum(F.when(s > 0, s * F.ln(s))), F.lit(0.0)).alias("s_ln_s"),
        F.sum(F.when(is_sdp, tri).otherwise(s)).alias("cap_upper"),
        F.sum(F.when(is_sdp, sq).otherwise(s)).alias("cap_full"),
        F.array_join(
            F.transform(listed, lambda x: x["size"].cast("string")), ";"
        ).alias("listed"),
    )


def coordinate_statistics(entries: DataFrame) -> DataFrame:
    """One row per distinct coordinate; repeated entries of a coordinate are combined."""
    v = F.abs("value")
    return fold_symmetric(entries).groupBy(KEY, "mat_id", "block_id", "row", "col").agg(
        F.sum(F.col("value") * F.col("value")).alias("sq"),
        F.sum(v).alias("l1"),
        F.max(v).alias("hi"),
        F.min(F.when(v > 0, v)).alias("lo"),
    )


def matrix_statistics(entries: DataFrame) -> DataFrame:
    """One row per non-empty matrix: distinct non-zeros and norms (off-diagonals count twice)."""
    weight = F.when(F.col("row") == F.col("col"), 1.0).otherwise(2.0)
    return coordinate_statistics(entries).groupBy(KEY, "mat_id").agg(
        F.count(F.lit(1)).cast("double").alias("nnz"),
        F.sum(weight).alias("nnz_full"),
        F.sqrt(F.sum(weight * F.col("sq"))).alias("fro"),
        F.sum("l1").alias("l1"),
        F.max("hi").alias("hi"),
        F.min("lo").alias("lo"),
    )


def entry_statistics(entries: DataFrame) -> DataFrame:
    """One row per instance, the objective (matrix 0) and the constraints kept apart."""
    c, a = F.col("mat_id") == 0, F.col("mat_id") > 0

    def obj(x):
        return F.max(F.when(c, F.col(x)))

    span = ratio(F.col("hi"), F.col("lo"))
    return matrix_statistics(entries).groupBy(KEY).agg(
        obj("nnz").alias("c_nnz"),
        obj("nnz_full").alias("c_nnz_full"),
        obj("fro").alias("c_fro"),
        obj("hi").alias("c_hi"),
        obj("lo").alias("c_lo"),
        F.count_if(a).cast("double").alias("k"),
        *[
            agg(F.when(a, F.col(x))).alias(f"{x}_{tag}")
            for x in ("nnz", "fro")
            for tag, agg in (
                ("sum", F.sum), ("avg", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min)
            )
        ],
        F.sum(F.when(a, F.col("nnz_full"))).alias("full_sum"),
        F.sum(F.when(a, F.col("l1"))).alias("l1_sum"),
        F.max(F.when(a, F.col("l1"))).alias("l1_max"),
        F.min(F.when(a, F.col("l1"))).alias("l1_min"),
        F.avg(F.when(a, F.col("hi"))).alias("hi_avg"),
        F.max(F.when(a, F.col("hi"))).alias("hi_max"),
        F.avg(F.when(a, F.col("lo"))).alias("lo_avg"),
        F.min(F.when(a, F.col("lo"))).alias("lo_min"),
        F.avg(F.when(a, span)).alias("span_avg"),
        F.max(F.when(a, span)).alias("span_max"),
        F.min(F.when(a, span)).alias("span_min"),
        F.max("hi").alias("all_hi"),
        F.min("lo").alias("all_lo"),
    )


def rhs_statistics(rhs: DataFrame) -> DataFrame:
    b = F.col("b")
    return rhs.groupBy(KEY).agg(
        F.sum(F.abs(b)).alias("b_l1"),
        F.sqrt(F.sum(b * b)).alias("b_l2"),
        F.max(F.abs(b)).alias("b_hi"),
        F.min(F.when(b != 0, F.abs(b))).alias("b_lo"),
        F.avg(b).alias("b_avg"),
        F.stddev_pop(b).alias("b_std"),
    )


# --------------------------------------------------------------------- feature formulas


def _or0(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def _over_all(m: Column, k: Column, x: str) -> dict[str, Column]:
    """Mean, population std, extremes of ``x`` over all m matrices from those of the k non-empty ones.

    The m − k empty matrices are zeros; merging two groups' moments keeps the result
    exact without writing a row for each of them.
    """
    mean, std = _or0(F.col(f"{x}_avg")), _or0(F.col(f"{x}_std"))
    var = ratio(k * std * std + ratio(mean * mean * k * (m - k), m), m)
    some = m > 0
    return {
        "avg": ratio(_or0(F.col(f"{x}_sum")), m),
        "std": F.when(some, F.sqrt(var)),
        "max": F.when(some, _or0(F.col(f"{x}_max"))),
        "min": F.when(some, F.when(k < m, F.lit(0.0)).otherwise(F.col(f"{x}_min"))),
    }


def size_columns() -> dict[str, Column]:
    m, total = F.col("m"), F.col("total")
    return {
        "m": m,
        "n_blocks": F.col("n_blocks"),
        "n_total_matrix": total,
        "max_block_size": F.col("largest"),
        "min_block_size": F.col("smallest"),
        "mean_block_size": F.col("mean"),
        "std_block_size": F.col("std"),
        "num_positive_blocks": F.col("n_sdp"),
        "num_negative_blocks": F.col("n_lp"),
        "num_unit_blocks": F.col("n_unit"),
        "sum_positive_blocks": F.col("sdp_size"),
        "sum_negative_abs_blocks": F.col("lp_size"),
        "aspect_ratio_m_over_n": ratio(m, total),
        "aspect_ratio_m_over_nsq": ratio(m, total * total),
        "block_sizes_raw": F.col("listed"),
    }


def structure_columns() -> dict[str, Column]:
    nb, total, sdp, lp = F.col("n_blocks"), F.col("total"), F.col("n_sdp"), F.col("n_lp")
    largest, smallest, mean = F.col("largest"), F.col("smallest"), F.col("mean")

    def flag(cond: Column) -> Column:
        return cond.cast("double")

    return {
        "num_sdp_blocks": sdp,
        "num_lp_like_blocks": lp,
        "is_single_block": flag(nb == 1),
        "is_multi_block": flag(nb > 1),
        "has_sdp_blocks": flag(sdp > 0),
        "has_lp_blocks": flag(lp > 0),
        "is_pure_sdp": flag(sdp == nb),
        "is_mixed_sdp_lp": flag((sdp > 0) & (lp > 0)),
        "sdp_total_size": F.col("sdp_size"),
        "lp_total_size": F.col("lp_size"),
        "sdp_size_fraction": ratio(F.col("sdp_size"), total),
        "lp_size_fraction": ratio(F.col("lp_size"), total),
        "largest_block_fraction": ratio(largest, total),
        "smallest_block_fraction": ratio(smallest, total),
        "nonlargest_fraction": 1.0 - ratio(largest, total),
        "block_dominance_ratio": ratio(largest, mean),
        # -sum(p ln p) with p = s / total, in one pass over s
        "block_size_entropy": F.when(
            total > 0, F.greatest(F.lit(0.0), F.ln(total) - ratio(F.col("s_ln_s"), total))
        ),
        "block_size_range": largest - smallest,
        "cv_block_size": ratio(F.col("std"), mean),
        "num_singleton_blocks": F.col("n_unit"),
        "singleton_block_fraction": ratio(F.col("n_unit"), nb),
        "num_large_blocks_ge_10": F.col("n_ge10"),
        "num_large_blocks_ge_50": F.col("n_ge50"),
        "large_blocks_ge_10_fraction": ratio(F.col("n_ge10"), nb),
        "large_blocks_ge_50_fraction": ratio(F.col("n_ge50"), nb),
    }


def sparsity_columns() -> dict[str, Column]:
    m, k = F.col("m"), _or0(F.col("k"))
    up, full = F.col("cap_upper"), F.col("cap_full")
    nnz = _over_all(m, k, "nnz")
    total, total_full = _or0(F.col("nnz_sum")), _or0(F.col("full_sum"))
    return {
        "upper_capacity_per_matrix": up,
        "full_capacity_per_matrix": full,
        "total_possible_upper_all_ai": m * up,
        "total_possible_full_all_ai": m * full,
        "nnz_c_upper": _or0(F.col("c_nnz")),
        "density_c_upper": ratio(_or0(F.col("c_nnz")), up),
        "nnz_c_full_implied": _or0(F.col("c_nnz_full")),
        "density_c_full_implied": ratio(_or0(F.col("c_nnz_full")), full),
        "total_nnz_ai_upper": total,
        "avg_nnz_ai_upper": nnz["avg"],
        "max_nnz_ai_upper": nnz["max"],
        "min_nnz_ai_upper": nnz["min"],
        "std_nnz_ai_upper": nnz["std"],
        "avg_density_ai_upper": ratio(nnz["avg"], up),
        "max_density_ai_upper": ratio(nnz["max"], up),
        "min_density_ai_upper": ratio(nnz["min"], up),
        "std_density_ai_upper": ratio(nnz["std"], up),
        "total_density_all_ai_upper": ratio(total, m * up),
        "total_nnz_ai_full_implied": total_full,
        "avg_nnz_ai_full_implied": ratio(total_full, m),
        "avg_density_ai_full_implied": ratio(ratio(total_full, m), full),
        "total_density_all_ai_full_implied": ratio(total_full, m * full),
        "num_empty_ai": m - k,
        "fraction_empty_ai": ratio(m - k, m),
    }


def scaling_columns() -> dict[str, Column]:
    m, k = F.col("m"), _or0(F.col("k"))
    fro = _over_all(m, k, "fro")
    c_fro, b_l2 = _or0(F.col("c_fro")), _or0(F.col("b_l2"))
    some = m > 0
    return {
        "c_fro_norm_upper": c_fro,
        "c_max_abs_entry": F.col("c_hi"),
        "c_min_abs_nonzero_entry": F.col("c_lo"),
        "c_dynamic_range": ratio(F.col("c_hi"), F.col("c_lo")),
        "avg_ai_fro_norm_upper": fro["avg"],
        "max_ai_fro_norm_upper": fro["max"],
        "min_ai_fro_norm_upper": fro["min"],
        "std_ai_fro_norm_upper": fro["std"],
        "ai_fro_norm_cv": ratio(fro["std"], fro["avg"]),
        "avg_ai_l1_norm": ratio(_or0(F.col("l1_sum")), m),
        "max_ai_l1_norm": F.when(some, _or0(F.col("l1_max"))),
        "min_ai_l1_norm": F.when(some, F.when(k < m, F.lit(0.0)).otherwise(F.col("l1_min"))),
        "avg_ai_max_abs_entry": F.col("hi_avg"),
        "max_ai_max_abs_entry": F.col("hi_max"),
        "avg_ai_min_abs_nonzero_entry": F.col("lo_avg"),
        "min_ai_min_abs_nonzero_entry": F.col("lo_min"),
        "avg_ai_dynamic_range": F.col("span_avg"),
        "max_ai_dynamic_range": F.col("span_max"),
        "min_ai_dynamic_range": F.col("span_min"),
        "b_l1_norm": _or0(F.col("b_l1")),
        "b_l2_norm": b_l2,
        "b_max_abs": F.col("b_hi"),
        "b_min_abs_nonzero": F.col("b_lo"),
        "b_dynamic_range": ratio(F.col("b_hi"), F.col("b_lo")),
        "b_mean": F.col("b_avg"),
        "b_std": F.col("b_std"),
        "global_all_coeff_max_abs": F.col("all_hi"),
        "global_all_coeff_min_abs_nonzero": F.col("all_lo"),
        "global_all_coeff_dynamic_range": ratio(F.col("all_hi"), F.col("all_lo")),
        "ratio_c_to_avg_ai_fro": ratio(c_fro, fro["avg"]),
        "ratio_c_to_b_l2": ratio(c_fro, b_l2),
        "ratio_avg_ai_to_b_l2": ratio(fro["avg"], b_l2),
        "max_ai_to_min_ai_fro_ratio": ratio(fro["max"], fro["min"]),
        "max_ai_to_avg_ai_fro_ratio": ratio(fro["max"], fro["avg"]),
    }


# Which statistics tables each group reads.
_READS = {
    "size": ("blocks",),
    "structure": ("blocks",),
    "sparsity": ("blocks", "entries"),
    "scaling": ("entries", "rhs"),
}
_FORMULAS = {
    "size": size_columns,
    "structure": structure_columns,
    "sparsity": sparsity_columns,
    "scaling": scaling_columns,
}


# ------------------------------------------------------------------------ user features


@dataclass
class FeatureRegistry:
    """Built-in groups plus the user's own.

    A user group is either *relational* — ``fn(corpus) -> DataFrame`` of aggregates keyed
    by instance, planned by Catalyst — or *per instance*: ``fn(pandas.DataFrame) -> dict``
    over the instance's entries, for code that cannot be written as columns.  That form is
    handed one instance at a time, so it suits instances that fit a task.  For larger ones
    there is the *partial* form: ``partial(pandas.DataFrame) -> bytes`` of any share of an
    instance's entries, ``merge(bytes, bytes) -> bytes`` and ``finish(bytes) -> dict``.
    """

    groups: dict[str, list[str]] = field(default_factory=builtin_groups)
    relational: dict[str, Callable[[Corpus], DataFrame]] = field(default_factory=dict)
    opaque: dict[str, Callable] = field(default_factory=dict)
    partial: dict[str, tuple[Callable, Callable, Callable]] = field(default_factory=dict)

    def _claim(self, group: str, names: Sequence[str]) -> None:
        if group in self.groups:
            raise DataError(f"group {group!r} is registered already")
        taken = {n: g for g, ns in self.groups.items() for n in ns}
        clash = [n for n in names if n in taken] + [n for n in names if list(names).count(n) > 1]
        if clash:
            raise DataError(f"features registered twice: {sorted(set(clash))}")
        self.groups[group] = list(names)

    def register_features(self, group: str, names: Sequence[str], fn) -> None:
        self._claim(group, names)
        self.relational[group] = fn

    def register_opaque(self, group: str, names: Sequence[str], fn) -> None:
        self._claim(group, names)
        self.opaque[group] = fn

    def register_partial(self, group: str, names: Sequence[str], partial, merge, finish) -> None:
        self._claim(group, names)
        self.partial[group] = (partial, merge, finish)

    def evaluate(self, group: str, names: Sequence[str], corpus: Corpus) -> DataFrame:
        if group in self.relational:
            out = self.relational[group](corpus)
            lacking = [n for n in names if n not in out.columns]
            if lacking:
                raise DataError(f"group {group!r} did not return {lacking}")
            return out.select(KEY, *names)
        schema = T.StructType(
            [T.StructField(KEY, T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names]
        )

        def row(instance, got):
            import pandas as pd

            lacking = [n for n in names if n not in got]
            if lacking:
                raise DataError(f"group {group!r} did not return {lacking}")
            return pd.DataFrame([[instance] + [got[n] for n in names]], columns=[KEY, *names])

        if group in self.opaque:
            fn = self.opaque[group]
            return corpus.entries.groupBy(KEY).applyInPandas(lambda key, pdf: row(key[0], fn(pdf)), schema)

        partial, merge, finish = self.partial[group]

        def states(batches):
            import pandas as pd

            held: dict = {}
            for batch in batches:
                for instance, part in batch.groupby(KEY, sort=False):
                    state = partial(part)
                    held[instance] = merge(held[instance], state) if instance in held else state
            yield pd.DataFrame({KEY: list(held), "state": list(held.values())})

        def merged(key, pdf):
            return row(key[0], finish(reduce(merge, pdf["state"])))

        # a state for each instance and task: small, however large the instance is
        found = corpus.entries.mapInPandas(states, f"{KEY} string, state binary")
        return found.groupBy(KEY).applyInPandas(merged, schema)


def build_features(
    corpus: Corpus,
    enabled: Sequence[str] = tuple(DEFAULT_ENABLED),
    registry: FeatureRegistry | None = None,
) -> DataFrame:
    """One row per instance with the enabled features, sorted by name.

    Tables no enabled group reads are not scanned at all, and aggregates nothing enabled
    needs are pruned by the optimizer.  The joined tables are all hashed by instance
    already, so the joins add no shuffle.
    """
    registry = registry or FeatureRegistry()
    chosen = select_features(enabled, registry.groups)
    builtin = [g for g in chosen if g in _FORMULAS]
    reads = {t for g in builtin for t in _READS[g]}

    base = corpus.problems.select(
        KEY, F.col("m").cast("double").alias("m"), F.col("n_blocks").cast("double").alias("n_blocks")
    )
    tables = []
    if "blocks" in reads:
        tables.append(block_statistics(corpus.blocks))
    if "entries" in reads:
        tables.append(entry_statistics(corpus.entries))
    if "rhs" in reads:
        tables.append(rhs_statistics(corpus.rhs))
    joined = reduce(lambda left, right: left.join(right, KEY, "left"), tables, base)

    columns: dict[str, Column] = {}
    for group in builtin:
        formulas = _FORMULAS[group]()
        for name in chosen[group]:
            columns[name] = formulas[name.removeprefix("feature_")]
    result = joined.select(KEY, *[c.alias(n) for n, c in columns.items()])
    for group in chosen:
        if group not in _FORMULAS:
            result = result.join(registry.evaluate(group, chosen[group], corpus), KEY, "left")
    return result.select(
        KEY,
        *[
            F.col(n) if n in TEXT_FEATURES else F.col(n).cast("double").alias(n)
            for n in sorted(enabled)
        ],
    )
