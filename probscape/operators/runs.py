"""Solver result records and the runtime table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.common import DataError

# Result styles, statuses each keeps as reported, the default tolerance and limit.
KEPT_STATUS = {
    "sdpt3": ("OPTIMAL", "STOPPED", "TIME_LIMIT", "FAILED"),
    "sedumi": ("TIME_LIMIT", "FAILED"),
}
TOLERANCE = 1e-5
TIME_LIMIT = 360.0


def _style(style: str) -> str:
    if style not in KEPT_STATUS:
        raise DataError(f"unknown result style {style!r}")
    return style


def worst_residual(gap: Column, pinfeas: Column, dinfeas: Column) -> Column:
    """The largest of the three, null as soon as one is missing (``greatest`` skips nulls)."""
    parts = [F.nanvl(c, F.lit(None)) for c in (gap, pinfeas, dinfeas)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.greatest(*parts))


def normalize_run(raw: DataFrame, style: str, tol: float = TOLERANCE) -> DataFrame:
    """Set ``phi``, ``optimal`` and ``status`` of raw records; optimality beats any status."""
    phi = worst_residual(F.col("gap"), F.col("pinfeas"), F.col("dinfeas"))
    if _style(style) == "sedumi" and "phi" in raw.columns:
        phi = F.coalesce(F.nanvl("phi", F.lit(None)), phi)
    optimal = F.coalesce(phi <= tol, F.lit(False))
    reported = F.upper(F.coalesce(F.col("status"), F.lit("FAILED")))
    status = (
        F.when(optimal, "OPTIMAL")
        .when(reported.isin(*KEPT_STATUS[style]), reported)
        .otherwise("STOPPED")
    )
    return raw.withColumns({"phi": phi, "optimal": optimal, "status": status})


def run_status(runtime: Column, phi: Column, style: str, limit: float = TIME_LIMIT, tol: float = TOLERANCE) -> Column:
    """Status a runner reports: the time limit outranks the tolerance in both styles."""
    _style(style)
    good = F.coalesce(phi <= tol, F.lit(False))
    if style == "sdpt3":  # a runtime over the limit replaces the verdict on phi
        verdict = F.when(good & ~F.isnan(phi), "OPTIMAL").otherwise("STOPPED")
        return F.when(runtime > limit, "TIME_LIMIT").otherwise(verdict)
    return F.when(runtime > limit, "TIME_LIMIT").when(good, "OPTIMAL").otherwise("STOPPED")


def residual_metrics(
    pobj: Column, dobj: Column, residual_norm: Column, b_norm: Column, min_eig: Column, c_norm: Column
) -> dict[str, Column]:
    return {
        "gap": F.abs(pobj - dobj) / (1 + F.abs(pobj) + F.abs(dobj)),
        "pinfeas": residual_norm / (1 + b_norm),
        "dinfeas": F.greatest(F.lit(0.0), -min_eig) / (1 + c_norm),
    }


def safe_runtime(value: Column) -> Column:
    """A number, or null for anything that is none."""
    return F.nanvl(value.try_cast("double"), F.lit(None))


def build_runs_wide(
    runs: DataFrame, solvers: Sequence[str], key: str = "instance", first_by: str | Sequence[str] | None = None
) -> DataFrame:
    """One row per instance, one ``algo_*`` column per solver in the given order.

    The solver list is known, so this is one aggregate with conditional columns and no
    extra pass for the pivot values.  ``first_by`` decides between repeated runs.
    """
    def pick(solver):
        value = F.when(F.col("solver") == solver, F.col("runtime"))
        if first_by is None:
            return F.max(value)
        names = [first_by] if isinstance(first_by, str) else list(first_by)
        order = F.struct(*names) if len(names) > 1 else F.col(names[0])
        return F.min_by("runtime", F.when(F.col("solver") == solver, order))

    if len(set(solvers)) != len(solvers) or not solvers:
        raise DataError("solvers must be a non-empty list without repeats")
    return runs.groupBy(key).agg(*[pick(s).alias(f"algo_{s}") for s in solvers])
