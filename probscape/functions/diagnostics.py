"""Summaries of a metadata table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.common import prefixed


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    return df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name, value
    )


def feature_diagnostics(metadata: DataFrame) -> DataFrame:
    """Per feature: missing values, distinct values, constant or entirely missing.

    Distinct values are counted from (column, value) groups, combined map-side, instead
    of a distinct aggregate per column that would copy every row once per column.
    """
    cols = prefixed(metadata.columns, "feature_")
    values = unpivot(metadata, cols, "feature").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    distinct = F.count("value")
    return values.groupBy("feature").agg(
        missing.alias("missing"),
        distinct.alias("distinct_values"),
        (distinct <= 1).alias("constant"),
        (missing == F.sum("n")).alias("all_missing"),
    )


def algorithm_diagnostics(metadata: DataFrame) -> DataFrame:
    """Per algorithm: missing, present, extremes; and the rows without any runtime at all."""
    cols = prefixed(metadata.columns, "algo_")
    none = F.count_if(F.coalesce(*[F.col(c) for c in cols]).isNull()).alias("rows_all_missing")
    stats = metadata.agg(
        none,
        *[
            F.struct(
                F.lit(c).alias("algorithm"), F.count_if(F.col(c).isNull()).alias("missing"),
                F.count(c).alias("present"), F.min(c).alias("min"), F.max(c).alias("max"),
            ).alias(c)
            for c in cols
        ],
    )
    return stats.select("rows_all_missing", F.inline(F.array(*cols)))


def metadata_summary(metadata: DataFrame) -> DataFrame:
    cols = metadata.columns
    return metadata.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(cols)).alias("columns"),
        F.lit(len(prefixed(cols, "feature_"))).alias("features"),
        F.lit(len(prefixed(cols, "algo_"))).alias("algorithms"),
        F.lit("source" in cols).alias("has_source"),
    )


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every pair of columns (values less a shift): rows with both, and sums over them."""
    sums = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        values = np.where(known > 0, values, 0.0)
        part = np.stack([known.T @ known, values.T @ known, (values * values).T @ known, values.T @ values])
        sums = part if sums is None else sums + part
    if sums is not None:
        d = sums.shape[1]
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(c, pa.float64()) for c in (
                sums[0][i, j], sums[1][i, j], sums[1][j, i], sums[2][i, j], sums[2][j, i], sums[3][i, j])]],
            ["i", "j", "n", "si", "sj", "qi", "qj", "p"])


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation as ``(a, b, r)``; all-null columns are left out.

    One aggregate for the means, by which values are shifted, and one pass in which a task turns its rows
    into the sums of all pairs: matrices of as many rows as there are columns move, whatever their number.
    """
    cols = list(cols)
    source = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    finite_ = [F.when(F.abs(F.col(f"c{i}")) < float("inf"), F.col(f"c{i}")) for i in range(len(cols))]
    means = source.agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate(finite_)], *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    used = [i for i in range(len(cols)) if means[f"n{i}"]]
    if not used:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    shifted = source.select(*[(F.col(f"c{i}") - F.lit(means[f"c{i}"] or 0.0)).alias(f"c{i}") for i in used])
    sums = shifted.mapInArrow(_products, "i int, j int, n double, si double, sj double, qi double, qj double, p double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])
    spread = F.sqrt(F.expr("(n * qi - si * si) * (n * qj - sj * sj)"))
    name = F.array(*[F.lit(cols[i]) for i in used])
    pairs = sums.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), F.try_divide(F.expr("n * p - si * sj"), spread).alias("r"))
    return pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
