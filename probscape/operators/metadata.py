"""Metadata tables: one row per instance with its source, features and runtimes.

A table's schema is dynamic: ``feature_*`` and ``algo_*`` columns, a key and a source.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.common import DataError, has_rows, prefixed, require_rows

# Provenance labels, and the folders they are read from.
SOURCES = {
    "sdplib": "SDPLIB",
    "DIMACS": "DIMACS",
    "genetic generated/fill empty space": "Genetically Generated to Fill Empty Space",
    "genetic generated/point target": "Genetically Generated from Point Target",
}
FILL_LABEL = SOURCES["genetic generated/fill empty space"]
UNKNOWN_SOURCE = "Unknown"

# Spellings of the core columns, lower case.
KEY_NAMES = ("instance", "instances", "row")
AXIS_NAMES = {"z1": "z_1", "z_1": "z_1", "z2": "z_2", "z_2": "z_2"}


# ------------------------------------------------------------------ columns and checks


def classify_source(path: Column, root: str = "", strict: bool = True) -> Column:
    """Provenance of a file from its folder below ``root``.

    ``strict`` fails on a path of no known folder (batch builds); otherwise the folder names
    are looked for anywhere in the path and an unknown one is labelled ``Unknown``.
    """
    base = root.rstrip("/") + "/" if root else ""
    label = None
    if strict:
        for folder, name in SOURCES.items():
            cond = path.startswith(f"{base}{folder}/")
            label = F.when(cond, name) if label is None else label.when(cond, name)
        return label.otherwise(
            F.raise_error(F.concat(F.lit("cannot tell the source of "), path)).cast("string")
        )
    for folder, name in (("sdplib", "SDPLIB"), ("DIMACS", "DIMACS")):
        cond = path.contains(folder)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    generated = path.contains("genetic generated")
    label = label.when(generated & path.contains("point target"), SOURCES["genetic generated/point target"])
    return label.when(generated, FILL_LABEL).otherwise(UNKNOWN_SOURCE)


def normalize_keys(df: DataFrame, key: str = "instances", source: str = "source") -> DataFrame:
    """Rename the core columns, however they are spelled; the key becomes a string."""
    out, seen = [], set()
    for name in df.columns:
        low = name.strip().lower()
        new = key if low in KEY_NAMES else source if low == "source" else AXIS_NAMES.get(low, name)
        if new in seen:
            raise DataError(f"two columns would both be named {new!r}")
        seen.add(new)
        col = F.col(f"`{name}`")
        out.append((col.cast("string") if new == key else col).alias(new))
    if key not in seen:
        raise DataError(f"no key column (one of {KEY_NAMES}) among {df.columns}")
    return df.select(*out)


def order_columns(df: DataFrame, key: str = "instances", source: str = "source") -> DataFrame:
    """Key, source, features by name, algorithms by name, everything else as it was."""
    core = [c for c in (key, source) if c in df.columns]
    features, algos = sorted(prefixed(df.columns, "feature_")), sorted(prefixed(df.columns, "algo_"))
    first = core + features + algos
    return df.select(*first, *[c for c in df.columns if c not in set(first)])


def validate_patch(
    columns: Sequence[str], prefixes: Iterable[str], key: str = "instances", source: str = "source"
) -> None:
    allowed = tuple(prefixes)
    odd = [c for c in columns if c not in (key, source) and not c.startswith(allowed)]
    if odd:
        raise DataError(f"columns not allowed in a patch: {odd}; allowed prefixes: {allowed}")


def validate_metadata(columns: Sequence[str], key: str = "instances") -> None:
    if key not in columns:
        raise DataError(f"metadata lacks the key {key!r}")
    for prefix in ("feature_", "algo_"):
        if not prefixed(columns, prefix):
            raise DataError(f"metadata has no {prefix}* column")


def find_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts (combined map-side)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_or_fail(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` itself, failing while it runs if a key repeats.

    The check shares the shuffle by key that the following join needs anyway.
    """
    others = [c for c in df.columns if c != key]
    once = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.first(F.struct(*others)).alias("__row")
    )
    ok = F.when(F.col("__n") == 1, F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit(f"duplicate keys in {what}: "), F.col(key).cast("string"))).cast("string")
    )
    return once.select(ok.alias(key), *[F.col(f"__row.`{c}`").alias(c) for c in others])


def drop_null_coords(df: DataFrame, z1: str = "z_1", z2: str = "z_2") -> DataFrame:
    kept = df.where(~F.isnan(z1) & ~F.isnan(z2)).dropna(subset=[z1, z2])
    return require_rows(kept, "the coordinate table")


def coerce_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Anything that is not a finite number becomes 0."""
    def clean(name):
        x = F.col(f"`{name}`").try_cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(ok, x).otherwise(F.lit(0.0)).alias(name)

    picked = set(cols)
    return df.select(*[clean(c) if c in picked else F.col(f"`{c}`") for c in df.columns])


# ------------------------------------------------------------------------------ joins


def build_metadata(
    features: DataFrame, runs: DataFrame, source: DataFrame, key: str = "Instance", check_rows: bool = True
) -> DataFrame:
    """Features, runtimes and sources joined one-to-one on the instance.

    Keys must be unique in every input.  With ``check_rows`` an empty input or result is an
    error; those checks read one row each, so hand in stage tables rather than long plans.
    """
    if check_rows:
        for df, what in ((features, "features"), (runs, "runtimes"), (source, "sources")):
            require_rows(df, f"the table of {what}")
    joined = (
        unique_or_fail(source, key, "the sources")
        .join(unique_or_fail(features, key, "the features"), key)
        .join(unique_or_fail(runs, key, "the runtimes"), key)
    )
    out = joined.withColumnRenamed(key, "Instances")
    if check_rows:
        require_rows(out, "the joined metadata")
    return order_columns(out, "Instances", "Source")


def attach_source(coords: DataFrame, metadata: DataFrame, key: str = "instances") -> DataFrame:
    found = metadata.select(key, "source")
    return coords.join(found, key, "left").withColumn("source", F.coalesce("source", F.lit("unknown")))


def append_instances(base: DataFrame, new: DataFrame, key: str = "instances") -> DataFrame:
    """Union by name; a key known already or given twice is an error."""
    new = normalize_keys(new, key)
    validate_patch(new.columns, ("feature_", "algo_"), key)
    known = new.select(key).join(base.select(key), key, "left_semi").take(5)
    if known:
        raise DataError(f"instances present already: {[r[0] for r in known]}")
    twice = find_duplicates(new.select(key), key).take(5)
    if twice:
        raise DataError(f"new instances given twice: {[r[0] for r in twice]}")
    return base.unionByName(new, allowMissingColumns=True)


def merge_patch(
    base: DataFrame, patch: DataFrame, prefixes: Iterable[str], key: str = "instances"
) -> DataFrame:
    """Overwrite the patch's columns in the rows it names — with nulls where it has nulls.

    Columns the base lacks are added, null elsewhere.  Unknown or repeated keys are errors.
    """
    patch = normalize_keys(patch, key)
    validate_patch(patch.columns, prefixes, key)
    twice = find_duplicates(patch.select(key), key).take(5)
    if twice:
        raise DataError(f"patch names instances twice: {[r[0] for r in twice]}")
    unknown = patch.select(key).join(base.select(key), key, "left_anti").take(5)
    if unknown:
        raise DataError(f"patch names unknown instances: {[r[0] for r in unknown]}")
    values = [c for c in patch.columns if c != key]
    renamed = patch.select(
        F.col(key), F.lit(True).alias("__hit"), *[F.col(f"`{c}`").alias(f"__new_{c}") for c in values]
    )
    joined = base.join(renamed, key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    out = []
    for c in base.columns:
        old = F.col(f"`{c}`")
        out.append(F.when(hit, F.col(f"`__new_{c}`")).otherwise(old).alias(c) if c in values else old)
    out += [F.col(f"`__new_{c}`").alias(c) for c in values if c not in base.columns]
    return joined.select(*out)


def build_metadata_test(
    base: DataFrame,
    add_instances: DataFrame | None = None,
    add_features: DataFrame | None = None,
    add_algorithms: DataFrame | None = None,
    key: str = "instances",
) -> DataFrame:
    """New rows first, then feature and algorithm patches (which may name the new rows)."""
    out = normalize_keys(base, key)
    if add_instances is not None:
        out = append_instances(out, add_instances, key)
    if add_features is not None:
        out = merge_patch(out, add_features, ("feature_",), key)
    if add_algorithms is not None:
        out = merge_patch(out, add_algorithms, ("algo_",), key)
    return order_columns(out, key)


def append_if_absent(
    table: DataFrame, rows: DataFrame, key: str = "instances", first_by: Sequence[str] | None = None
) -> DataFrame:
    """Add rows of unknown keys, cut to the table's columns; the first row of a key wins.

    ``first_by`` orders rows that share a new key.  The choice is an aggregate, so a key that
    repeats without end is combined before the shuffle.
    """
    fresh = rows.join(table.select(key), key, "left_anti")
    if first_by is not None:
        others = [c for c in fresh.columns if c != key]
        order = F.struct(*first_by)
        picked = fresh.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__row"))
        fresh = picked.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in others])
    have = {c.lower(): c for c in fresh.columns}
    types = {f.name: f.dataType for f in table.schema.fields}
    aligned = fresh.select(*[
        (F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(types[c]).alias(c)
        for c in table.columns
    ])
    return table.unionByName(aligned)


def missing_instances(
    available: DataFrame, table: DataFrame, existing_files: DataFrame, key: str = "instances"
) -> DataFrame:
    """Configured ``(source, instances)`` that are not in the table and whose file exists."""
    return available.join(table.select(key), key, "left_anti").join(
        existing_files.select("source", key), ["source", key], "left_semi"
    )


def backfill_column(
    table: DataFrame, column: str, sources: Sequence[DataFrame], key: str = "instances"
) -> DataFrame:
    """Add ``column`` as text from the first source table that has it and names an instance.

    The choice is made per table, not per row: rows the chosen table lacks get ''.
    """
    if column.lower() in {c.lower() for c in table.columns}:
        raise DataError(f"column {column!r} is present already")
    for src in sources:
        if column not in src.columns:
            continue
        src = normalize_keys(src, key)
        named = src.where(F.trim(key) != "").select(key, F.trim(F.col(column).cast("string")).alias("__v"))
        if has_rows(named):
            values = named.groupBy(key).agg(F.max("__v").alias("__v"))
            filled = table.join(values, key, "left")
            return filled.select(*table.columns, F.coalesce("__v", F.lit("")).alias(column))
    return table.withColumn(column, F.lit(""))


def template_row(
    candidates: DataFrame, seeds: DataFrame, key: str = "instances", seed: str = "seed", strict: bool = True
) -> DataFrame:
    """Candidates in the metadata's shape: own features, the seed row's other columns.

    A candidate whose seed has no row is an error, or left out unless ``strict``.
    """
    own = set(prefixed(candidates.columns, "feature_"))
    seed_cols = [c for c in seeds.columns if c not in own and c not in (key, "source")]
    base = seeds.select(F.col(key).alias(seed), *seed_cols)
    lost = F.raise_error(F.concat(F.lit("no row of the seed of "), F.col(key))).cast("boolean") if strict else F.lit(False)
    joined = candidates.join(base.withColumn("__has", F.lit(True)), seed, "left").where(F.coalesce("__has", lost))
    return joined.select(*[
        F.col(key) if c == key else F.lit(FILL_LABEL).alias("source") if c == "source" else F.col(f"`{c}`")
        for c in seeds.columns
    ])
