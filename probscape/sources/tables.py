"""Stage tables: write a result once, load it instead of building it again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probscape.common import DataError, require_rows, shared_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite ``path``; CSV carries a header, and a missing value is an empty field."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").option("nullValue", "").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise DataError(f"unknown table format {fmt!r}")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Without a schema CSV types are inferred, at the price of one more scan."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true").option("nullValue", "")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)


# The names of the stage modes; "csv" means load whatever was persisted.
STAGE_MODES = ("build", "csv")


def load_stage(
    spark: SparkSession, mode: str, path: str, build: Callable[[], DataFrame],
    fmt: str = "parquet", schema=None, what: str = "stage table",
) -> DataFrame:
    """Build the stage and persist it at ``path``, or load what is there; empty is an error."""
    if mode not in STAGE_MODES:
        raise DataError(f"unknown stage mode {mode!r}, expected one of {STAGE_MODES}")
    if mode == "build":
        write_table(build(), path, fmt)
    return require_rows(read_table(spark, path, fmt, schema), what)


def write_targets(targets: DataFrame, path: str, params: dict, bounds: dict) -> None:
    """Targets as CSV, and as one JSON payload with the parameters that led to them."""
    write_table(targets, f"{path}/csv", "csv")
    targets_payload(targets, params, bounds).write.mode("overwrite").text(f"{path}/json")


def targets_payload(targets: DataFrame, params: dict, bounds: dict) -> DataFrame:
    """One JSON document; the targets are at most top-k rows."""
    def consts(d):
        return F.struct(*[F.lit(v).alias(k) for k, v in d.items()])

    rows = F.sort_array(F.collect_list(F.struct(*targets.columns)))
    doc = F.struct(*[F.lit(v).alias(k) for k, v in params.items()], consts(bounds).alias("bounds"), F.col("targets"))
    return targets.agg(rows.alias("targets")).select(F.to_json(doc).alias("value"))
