"""Exact order statistics of columns too large to sort in one place.

Selection by histogram refinement: each pass counts the values of a shrinking interval
into equal buckets, map-side, and keeps the bucket that holds the wanted rank.  A pass
moves only counts; values are fetched when few are left.  Ties and heavy repetition are
safe, because a bucket whose smallest and largest value agree is resolved at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.common import DataError, MODEL_ROWS, collect_model, finite
from probscape.functions.diagnostics import unpivot

#: Values of one interval that may be fetched and sorted.
_FEW = 4096
_CELLS = 200_000


def _known(long: DataFrame) -> DataFrame:
    """NaN counts as missing."""
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def column_extent(long: DataFrame) -> dict[str, tuple[int, int, int, float, float]]:
    """``{key: (n, n of -inf, n of finite, least finite, greatest finite)}`` of ``(key, value)``."""
    own = F.when(finite(F.col("value")), F.col("value"))
    rows = collect_model(
        _known(long).groupBy("key").agg(
            F.count("value").alias("n"), F.count_if(F.col("value") == float("-inf")).alias("low"),
            F.count(own).alias("mid"), F.min(own).alias("lo"), F.max(own).alias("hi")),
        "the list of keys",
    )
    return {r["key"]: (r["n"], r["low"], r["mid"], r["lo"], r["hi"]) for r in rows}


def select_ranks(
    long: DataFrame, wanted: Mapping[str, Sequence[int]], extent: Mapping[str, tuple] | None = None
) -> dict[tuple[str, int], float]:
    """The values at the given 1-based ranks of ``(key, value)``, nulls and NaN left out.

    Infinite values take the first and last ranks; the search runs over the finite ones.
    """
    spark = long.sparkSession
    extent = extent or column_extent(long)
    found: dict[tuple[str, int], float] = {}
    # open intervals: (key, lo, hi) -> {rank: number of values below the interval}
    open_: dict[tuple[str, float, float], dict[int, int]] = {}
    for key, ranks in wanted.items():
        n, low, mid, lo, hi = extent.get(key, (0, 0, 0, None, None))
        for rank in ranks:
            if not 1 <= rank <= n:
                raise DataError(f"rank {rank} of {key!r} is outside 1..{n}")
            if rank <= low:
                found[key, rank] = float("-inf")
            elif rank > low + mid:
                found[key, rank] = float("inf")
            elif lo == hi:
                found[key, rank] = lo
            else:
                open_.setdefault((key, lo, hi), {})[rank] = low
    long = long.where(finite(F.col("value")))

    while open_:
        if len(open_) > MODEL_ROWS:
            raise DataError(f"too many order statistics at once: {len(open_)}")
        spans = list(open_)
        before = open_
        buckets = max(16, min(4096, _CELLS // len(spans)))
        model = spark.createDataFrame(
            [(i, k, lo, hi) for i, (k, lo, hi) in enumerate(spans)], "iv int, key string, lo double, hi double"
        )
        inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
        # halves keep the difference of two huge values finite
        share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int"))
        counts = (
            long.join(F.broadcast(model), "key").where(inside)
            .groupBy("iv", cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        by_span: dict[int, list] = {}
        for r in counts:
            by_span.setdefault(r["iv"], []).append(r)
        next_: dict[tuple[str, float, float], dict[int, int]] = {}
        fetch: dict[tuple[str, float, float], dict[int, int]] = {}
        for i, span in enumerate(spans):
            cells = sorted(by_span.get(i, []), key=lambda r: r["cell"])
            for rank, below in open_[span].items():
                for r in cells:
                    if rank <= below + r["n"]:
                        break
                    below += r["n"]
                sub = (span[0], r["lo"], r["hi"])
                if r["lo"] == r["hi"]:
                    found[span[0], rank] = r["lo"]
                elif r["n"] <= _FEW:
                    fetch.setdefault(sub, {})[rank] = below
                else:
                    next_.setdefault(sub, {})[rank] = below
        if fetch:
            few = list(fetch)
            model = spark.createDataFrame(
                [(i, k, lo, hi) for i, (k, lo, hi) in enumerate(few)], "iv int, key string, lo double, hi double"
            )
            values: dict[int, list[float]] = {}
            for r in long.join(F.broadcast(model), "key").where(inside).select("iv", "value").collect():
                values.setdefault(r["iv"], []).append(r["value"])
            for i, sub in enumerate(few):
                ordered = sorted(values[i])
                for rank, below in fetch[sub].items():
                    found[sub[0], rank] = ordered[rank - below - 1]
        if set(next_) == set(before):
            raise DataError("the search for order statistics does not narrow")
        open_ = next_
    return found


def _positions(n: int, p: float, midpoint: bool) -> tuple[int, int, float]:
    """Ranks around quantile p and the weight of the upper one.

    Mid-point quantiles put rank k at (k − ½)/n; otherwise rank k sits at (k − 1)/(n − 1).
    """
    pos = p * n + 0.5 if midpoint else p * (n - 1) + 1
    pos = min(max(pos, 1.0), float(n))
    k = min(int(math.floor(pos)), n)
    return k, min(k + 1, n), pos - k


def quantiles(long: DataFrame, probs: Sequence[float], midpoint: bool = False) -> dict[str, list[float]]:
    """Exact quantiles per key of ``(key, value)``."""
    extent = column_extent(long)
    spots = {k: [_positions(n, p, midpoint) for p in probs] for k, (n, *_) in extent.items() if n > 0}
    ranks = {k: sorted({r for a, b, _ in v for r in (a, b)}) for k, v in spots.items()}
    at = select_ranks(long, ranks, extent)

    def between(x: float, y: float, w: float) -> float:
        return x if w == 0 or x == y else x + w * (y - x)

    return {k: [between(at[k, a], at[k, b], w) for a, b, w in v] for k, v in spots.items()}


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], midpoint: bool = False
) -> dict[str, list[float]]:
    return quantiles(unpivot(df, cols, "key", "value").where(F.col("value").isNotNull()), probs, midpoint)


#: Rows of a group whose median one task may compute.
GROUP_ROWS = 1_000_000


def grouped_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median per group, hot groups by selection and all others by a plain aggregate; NaN is missing."""
    df = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None)))
    hot = collect_model(
        df.groupBy(*keys).agg(F.count(value).alias("n")).where(F.col("n") > GROUP_ROWS), "the list of hot groups"
    )
    if not hot:
        return df.groupBy(*keys).agg(F.median(value).alias("median"))
    spark = df.sparkSession
    schema = df.select(*keys).schema
    names = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], schema)
    tagged = F.to_json(F.struct(*keys))
    big = df.join(F.broadcast(names), list(keys), "left_semi").select(tagged.alias("key"), F.col(value).alias("value"))
    med = quantiles(big, [0.5])
    labels = {r["key"]: r for r in names.select(tagged.alias("key"), *keys).collect()}
    rows = [tuple(labels[k][c] for c in keys) + (v[0],) for k, v in med.items()]
    found = spark.createDataFrame(rows, schema.add("median", "double"))
    rest = df.join(F.broadcast(names), list(keys), "left_anti").groupBy(*keys).agg(F.median(value).alias("median"))
    return rest.unionByName(found)
