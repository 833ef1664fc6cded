"""Small helpers shared by every operator."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have before it stops counting as "model-sized" (and so may be
#: turned into a literal, collected for a fit, or broadcast).
MODEL_ROWS = 20_000


#: Rows of a narrow table (a key and a few numbers) that may be sent to every task.
SHARED_ROWS = 1_000_000


class DataError(ValueError):
    """An input table breaks the contract of an operator."""


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN means *missing* at every boundary; inside the library only nulls do."""
    picked = set(cols) if cols is not None else None
    out = []
    for field in df.schema.fields:
        name = field.name
        is_float = field.dataType.typeName() in ("double", "float")
        if is_float and (picked is None or name in picked):
            out.append(F.nanvl(F.col(f"`{name}`"), F.lit(None)).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is zero or null."""
    return F.try_divide(num, F.nullif(den, F.lit(0.0)))


def prefixed(columns: Sequence[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]


def finite(col: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if not has_rows(df):
        raise DataError(f"{what} has no rows")
    return df


def keep(df: DataFrame) -> DataFrame:
    """Hold a result that several jobs read; spills to disk, recomputed after a lost executor."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A session that runs in one process (``local[...]``) may do without the setting and gets a folder
    of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise DataError("spark.checkpoint.dir names no shared folder")
    if sc.applicationId not in _local_folder:
        _local_folder[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local_folder[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def collect_model(df: DataFrame, what: str, limit: int = MODEL_ROWS) -> list:
    """Bring a model-sized table to the driver, refusing anything larger."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise DataError(f"{what} is not model-sized: more than {limit} rows")
    return rows


def as_model(df: DataFrame, limit: int = MODEL_ROWS) -> DataFrame | None:
    """The same table held locally if it is model-sized, else None; evaluates ``df`` once."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else df.sparkSession.createDataFrame(rows, df.schema)


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; counted in parallel, one number a task."""
    return df.count() <= limit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame, limit: int = SHARED_ROWS) -> DataFrame:
    """Broadcast a narrow table after counting it; a larger one is joined by shuffle."""
    return F.broadcast(df) if fits(df, limit) else df
