"""Registration of queries with their SQL twins, and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OFF_TIES = 1.0000000003


def canonical(col: Column) -> Column:
    """Eight significant digits, noise below 1e-9 to zero.

    Sums of doubles depend on the order of the summands, so values are compared after
    this rounding; both engines print and re-read the same decimal.  The factor moves
    values that lie exactly between two roundings (prices often do) to one side.
    """
    shown = F.format_string("%.7e", col * OFF_TIES).cast("double")
    return F.when(col.isNull(), None).when(F.abs(col) < 1e-9, F.lit(0.0)).otherwise(shown)


def rounded(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(canonical(c).alias(f.name) if f.dataType.typeName() == "double" else c)
    return df.select(*out)


def rounded_sql(body: str, doubles: str) -> str:
    names = doubles.split()
    if not names:
        return body
    repl = ", ".join(
        f"CASE WHEN abs(\"{n}\") < 1e-9 THEN 0.0::DOUBLE ELSE CAST(printf('%.7e', \"{n}\"::DOUBLE * {OFF_TIES}::DOUBLE) AS DOUBLE) END AS \"{n}\""
        for n in names
    )
    return f"SELECT * REPLACE ({repl}) FROM ({body}) AS canonical_rows"


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the body of its twin over the given CTEs."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            body = rounded_sql(sql.strip(), doubles)
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(c.strip() for c in ctes)}\n" if ctes else "") + body
        return fn

    return wrap
