"""Reading, addressing and writing corpora of sparse problem text."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probscape.common import DataError, cut, require_rows, shared
from probscape.functions.features import KEY, Corpus, fold_symmetric
from probscape.sources.text import (
    decimal,
    integer,
    is_relevant,
    parse_block_sizes,
    tokens,
)

# The file suffixes of problem instances.
SUFFIXES = (".dat-s", ".mat")


def is_supported(path: Column) -> Column:
    name = F.lower(path)
    return F.reduce(
        F.array(*[F.lit(s) for s in SUFFIXES]), F.lit(False), lambda acc, s: acc | name.endswith(s)
    )


def supported_instances(listing: DataFrame) -> DataFrame:
    """The instance files of a listing with a ``path`` column, in path order."""
    return listing.where(is_supported(F.col("path"))).orderBy("path")


def discover_instances(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Instance files below the given folders (or the given files): ``path``, ``size_bytes``.

    Only the listing is read; file contents are pruned from the scan.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(paths) if not isinstance(paths, str) else paths)
        .select("path", F.col("length").alias("size_bytes"))
    )
    return require_rows(supported_instances(listing), "the instance listing")


def display_name(path: Column, root: str) -> Column:
    """The path below ``root``, or the bare file name for a path elsewhere."""
    prefix = root.rstrip("/") + "/"
    inside = F.startswith(path, F.lit(prefix))
    return F.when(inside, F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(
        F.regexp_extract(path, r"([^/]*)$", 1)
    )


# ------------------------------------------------------------------------------ parsing


def number_lines(raw: DataFrame, name: Column, keep: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Number the lines of text files: ``(instance, seq, line)``, ``seq`` from 0 per instance.

    ``raw`` is ``(value, file_path, start)`` from a text scan, ``name`` the instance of a
    file, ``keep`` the lines that count, ``owner`` what must be one for each instance (the
    file by default): two files of one name are an error, not one instance.  Within a split the reader keeps line order, so an
    increasing id tells the position relative to the split's first line; the splits' line
    counts give the offset.  That table (one row per split) is made first, in a pass of its
    own; no line is shuffled or sorted, and files may span any number of splits.
    """
    lines = (raw if keep is None else raw.where(keep)).select(
        F.col("value").alias("line"), "file_path", "start", F.monotonically_increasing_id().alias("at")
    )
    splits = lines.groupBy("file_path", "start").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    ).withColumn(KEY, name)
    before = Window.partitionBy(KEY).orderBy("file_path", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut(splits.select(
        KEY, "file_path", "start",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    ))
    owner = F.col("file_path") if owner is None else owner
    clash = splits.groupBy(KEY).agg(F.min(owner).alias("one"), F.max(owner).alias("other")).where("one <> other").take(1)
    if clash:
        raise DataError(f"two files are named {clash[0][KEY]!r}: {clash[0]['one']}, {clash[0]['other']}")
    # every line finds its split; a miss would mean the two scans split the files differently
    lost = F.raise_error(F.lit("file splits changed between scans"))
    return lines.join(shared(splits), ["file_path", "start"], "left").select(
        F.coalesce(KEY, lost.cast("string")).alias(KEY),
        (F.coalesce("shift", lost.cast("bigint")) + F.col("at")).alias("seq"),
        "line",
    )


def scan_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.text(list(paths) if not isinstance(paths, str) else paths).select(
        "value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start")
    )



def _unquoted(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def path_below(paths: str | Sequence[str], path: str = "file_path") -> Column:
    """A file's path below the folder it was found in, or its bare name if it was given itself."""
    full = _unquoted(F.col(path))
    name = F.regexp_extract(full, r"([^/]*)$", 1)
    for root in [paths] if isinstance(paths, str) else paths:
        base = root.rstrip("/") + "/"
        name = F.when(F.contains(full, F.lit(base)), F.substring_index(full, base, -1)).otherwise(name)
    return name


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], suffix: str = ".dat-s") -> DataFrame:
    """Relevant lines of problem text below ``paths``.

    An instance is named by its path below the folder it was found in.  A folder ``instance=X``
    of ordered part files (what ``export_corpus`` writes) is one instance.
    """
    raw = scan_text(spark, paths)
    raw = raw.where(F.lower("file_path").endswith(suffix) | F.col("file_path").contains("/instance="))
    part_of = F.regexp_extract("file_path", r"/instance=([^/]*)/[^/]*$", 1)
    # the folder's name is escaped by the writer, and its path once more
    name = F.when(part_of != "", _unquoted(_unquoted(part_of))).otherwise(path_below(paths))
    owner = F.when(part_of != "", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)).otherwise(F.col("file_path"))
    return number_lines(raw, name, is_relevant(F.col("value")), owner)


def parse_lines(lines: DataFrame) -> Corpus:
    """Problem tables from ``(instance, seq, line)`` with comments already dropped.

    Lines 0–3 are the header (m, n_blocks, block sizes, b); it is parsed at once, one row per
    instance, and must be consistent.  Of the body, rows that are short, not numeric, zero
    or out of range are skipped.
    """
    heads = lines.where(F.col("seq") < 4).groupBy(KEY).agg(
        *[F.max(F.when(F.col("seq") == i, F.trim("line"))).alias(f"l{i}") for i in range(4)]
    )

    def fault(text: str, kind: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{text}: "), F.col(KEY))).cast(kind)

    b_tokens = tokens(F.regexp_replace("l3", r"[{},]", " "))
    parsed = heads.select(
        KEY,
        F.when(F.col("l3").isNull(), fault("fewer than four lines", "int"))
        .otherwise(F.coalesce(integer(F.col("l0")), fault("bad header", "int"))).alias("m"),
        F.coalesce(integer(F.col("l1")), fault("bad header", "int")).alias("n_blocks"),
        parse_block_sizes(F.col("l2")).alias("sizes"),
        F.transform(
            b_tokens, lambda t: F.coalesce(decimal(t), F.raise_error(F.lit("bad vector b")).cast("double"))
        ).alias("b"),
    )
    checked = cut(parsed.select(
        KEY, "m",
        F.when(F.size("sizes") == F.col("n_blocks"), F.col("n_blocks"))
        .otherwise(fault("block count differs from the header", "int")).alias("n_blocks"),
        "sizes",
        F.when(F.size("b") == F.col("m"), F.col("b"))
        .otherwise(fault("length of b differs from m", "array<double>")).alias("b"),
    ))
    problems = checked.select(KEY, "m", "n_blocks")
    blocks = checked.select(KEY, F.posexplode("sizes").alias("pos", "size")).select(
        KEY, (F.col("pos") + 1).alias("block_id"), "size"
    )
    rhs = checked.select(KEY, F.posexplode("b").alias("pos", "b")).select(KEY, (F.col("pos") + 1).alias("mat_id"), "b")

    names, t = ("mat_id", "block_id", "row", "col"), F.col("t")
    parsed_row = F.struct(
        *[integer(F.get(t, i)).alias(c) for i, c in enumerate(names)], decimal(F.get(t, 4)).alias("value")
    )
    # each generator keeps the filters above it from being pushed into more evaluations of the
    # same text: a line is split once, a token parsed once, and the generated code stays small
    body = (
        lines.where(F.col("seq") >= 4)
        .select(KEY, F.explode(F.array(tokens(F.col("line")))).alias("t"))
        .where(F.size("t") >= 5)
        .select(KEY, F.inline(F.array(parsed_row)))
        .dropna(subset=[*names, "value"])
        .where((F.col("value") != 0) & (F.col("mat_id") >= 0) & (F.col("block_id") >= 1))
    )
    entries = fold_symmetric(
        body.join(shared(problems), KEY)
        .where((F.col("mat_id") <= F.col("m")) & (F.col("block_id") <= F.col("n_blocks")))
        .select(KEY, "mat_id", "block_id", "row", "col", "value")
    )
    return Corpus(problems, blocks, rhs, entries)


def read_problem_corpus(spark: SparkSession, paths: str | Sequence[str]) -> Corpus:
    return parse_lines(numbered_lines(spark, paths))


# --------------------------------------------------------- vector layout of cone problems


def cone_blocks(cones: DataFrame) -> DataFrame:
    """Block sizes of ``(instance, f, l, q, r, s)`` cone arrays, in layout order.

    The free and linear parts make one diagonal block each, every q and r cone one
    diagonal block, every s cone a semidefinite one; zeros are dropped.
    """
    def ints(name):
        whole = F.transform(F.coalesce(F.col(name), F.array().cast("array<double>")), lambda v: v.cast("int"))
        return F.filter(whole, lambda v: v != 0)

    def total(name):
        return F.aggregate(ints(name), F.lit(0), lambda a, v: a + v)

    merged = [F.filter(F.array(-total(n)), lambda v: v < 0) for n in ("f", "l")]
    single = [F.transform(ints(n), lambda v: -v) for n in ("q", "r")]
    sizes = F.concat(*merged, *single, ints("s"))
    checked = F.when(F.size(sizes) > 0, sizes).otherwise(
        F.raise_error(F.concat(F.lit("no cone blocks: "), F.col(KEY))).cast("array<int>")
    )
    return cones.select(KEY, F.posexplode(checked).alias("pos", "size")).select(
        KEY, (F.col("pos") + 1).alias("block_id"), "size"
    )


def block_offsets(blocks: DataFrame) -> DataFrame:
    """``start``/``end`` of every block in the vector of its instance (s² or s wide).

    An instance's blocks are the tokens of one header line, so its window fits a task.
    """
    s = F.abs("size").cast("bigint")
    order = Window.partitionBy(KEY).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    wide = blocks.withColumn("width", F.when(F.col("size") > 0, s * s).otherwise(s))
    return wide.withColumn("start", F.coalesce(F.sum("width").over(order), F.lit(0))).withColumn(
        "end", F.col("start") + F.col("width")
    )


#: Bins of an instance with few blocks, and the least width of a bin.
BINS, BIN_WIDTH = 4096, 4096


def vec_to_block(vec: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turn 0-based vector indices ``(instance, idx, …)`` into block coordinates.

    A range join.  Each instance's index space is cut into equal bins, at least as many as it has
    blocks and up to ``BINS`` for a few large ones, and both sides meet on (instance, bin): a row meets
    the few blocks of its bin, and a large instance spreads over its bins.  An index outside the
    instance's vector is an error.
    """
    offs = block_offsets(blocks)
    bins = offs.groupBy(KEY).agg(
        F.greatest(F.lit(BIN_WIDTH), F.ceil(F.max("end") / F.greatest(F.lit(BINS), F.count(F.lit(1))))).cast("bigint").alias("bin_width"),
        F.max("end").alias("whole"),
    )
    spread = offs.where(F.col("width") > 0).join(bins, KEY).withColumn(
        "bin", F.explode(F.expr("sequence(start div bin_width, (end - 1) div bin_width)"))
    )
    wrong = F.raise_error(F.concat(F.lit("vector index out of range: "), F.col(KEY))).cast("bigint")
    inside = (F.col("idx") >= 0) & (F.col("idx") < F.col("whole"))
    placed = vec.join(shared(bins), KEY).withColumn("bin", F.when(inside, F.expr("idx div bin_width")).otherwise(wrong))
    placed = placed.drop("bin_width", "whole")
    hit = placed.join(
        spread.select(KEY, "bin", "block_id", "size", "start", "end"), [KEY, "bin"]
    ).where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    r = F.expr("cast(CASE WHEN size > 0 THEN (idx - start) % abs(size) + 1 ELSE idx - start + 1 END AS int)")
    c = F.expr("cast(CASE WHEN size > 0 THEN (idx - start) DIV abs(size) + 1 ELSE idx - start + 1 END AS int)")
    extra = [x for x in vec.columns if x != KEY]
    return hit.select(KEY, *extra, "block_id", F.least(r, c).alias("row"), F.greatest(r, c).alias("col"))


def vectorise(df: DataFrame, n: Column) -> DataFrame:
    """Linear 0-based index of 1-based (row, col) in an n × n block, column by column."""
    idx = (F.col("row") - 1).cast("bigint") + (F.col("col") - 1).cast("bigint") * n
    return df.withColumn("idx", idx)


# ------------------------------------------------------------------------------ writing


def render_corpus(corpus: Corpus) -> DataFrame:
    """The corpus as lines ``(instance, section, mat_id, block_id, row, col, line)``.

    Sections 0–3 are the header, 4 the entries; sorting by these columns gives the file.
    """
    def line(df, section, text, mat=F.lit(0), blk=F.lit(0), r=F.lit(0), c=F.lit(0)):
        return df.select(
            KEY, F.lit(section).alias("section"), mat.alias("mat_id"), blk.alias("block_id"),
            r.alias("row"), c.alias("col"), text.alias("line"),
        )

    def joined(df, order, value):
        listed = F.array_sort(F.collect_list(F.struct(order, value)))
        return df.groupBy(KEY).agg(
            F.array_join(F.transform(listed, lambda x: x[value].cast("string")), " ").alias("text")
        )

    b_line = corpus.problems.select(KEY).join(joined(corpus.rhs, "mat_id", "b"), KEY, "left")
    body = corpus.entries.where(F.col("value") != 0)
    text = F.concat_ws(" ", *[F.col(x).cast("string") for x in ("mat_id", "block_id", "row", "col", "value")])
    parts = [
        line(corpus.problems, 0, F.col("m").cast("string")),
        line(corpus.problems, 1, F.col("n_blocks").cast("string")),
        line(joined(corpus.blocks, "block_id", "size"), 2, F.col("text")),
        line(b_line, 3, F.coalesce("text", F.lit(""))),
        line(body, 4, text, F.col("mat_id"), F.col("block_id"), F.col("row"), F.col("col")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_corpus(corpus: Corpus, path: str, partitions: int | None = None) -> None:
    """Write one folder ``instance=X`` per instance, its part files in order.

    Rows are range-partitioned by their place in the files, so a huge instance becomes
    several parts rather than one task; concatenated by name the parts are the file.
    """
    order = [KEY, "section", "mat_id", "block_id", "row", "col"]
    lines = render_corpus(corpus)
    spread = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)
    ready = spread.sortWithinPartitions(*order).select(KEY, F.col("line").alias("value"))
    folder = _plain_folder(path)
    if folder is None:
        ready.write.mode("overwrite").partitionBy(KEY).text(path)
        return
    ready.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(path)
    ready.mapInArrow(_write_parts(folder), "lines long").agg(F.sum("lines")).collect()


def _plain_folder(path: str) -> str | None:
    """The folder in the file tree that all executors share, if ``path`` names one, else None (another file system)."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith(("/", "file:/")) else None


def _write_parts(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's ``(instance, value)`` rows, sorted by instance, as ``instance=X/part-<task>``; gives the number of lines.

    In a file tree the table writer spends most of its time on the permissions, checksum and renames of each small
    file. A part is renamed when it is whole, so a task that is tried again replaces its own parts only."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        last, out, lines = None, None, 0

        def done() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{os.path.dirname(out.name)}/part-{number:06d}.txt")

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for first, stop in zip(edges, edges[1:]):
                name = _folder_name(names.dictionary[int(code[first])].as_py())
                if name != last:
                    done()
                    os.makedirs(f"{folder}/{name}", exist_ok=True)
                    last, out = name, open(f"{folder}/{name}/.part-{number:06d}-{uuid.uuid4().hex}", "w", encoding="utf-8", newline="")
                values = batch.column(1).slice(first, stop - first).to_pylist()
                out.write("\n".join(v or "" for v in values) + "\n")
                lines += len(values)
        done()
        yield pa.RecordBatch.from_arrays([pa.array([lines], pa.int64())], ["lines"])

    return run


def _folder_name(value: str | None) -> str:
    """``instance=X`` as a partitioned table names it."""
    escaped = re.sub(r"""["#%'*/:=?\\\x7f{\[\]^\x01-\x1f]""", lambda m: f"%{ord(m.group()):02X}", value or "__HIVE_DEFAULT_PARTITION__")
    return f"{KEY}={escaped}"


# ------------------------------------------------------------------------------ choosing


def select_instances(
    listing: DataFrame, roots: Sequence[str], mode: str, names: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Instance files to work on, from a listing ``(root, name, path)``.

    ``all`` takes every supported file, and every root must have some; ``enabled`` takes
    the configured names, each from the first root that has it, and fails on a missing one.
    """
    if mode == "all":
        found = listing.where(is_supported(F.col("path")))
        have = {r["root"] for r in found.select("root").distinct().collect()}
        empty = [r for r in roots if r not in have]
        if empty:
            raise DataError(f"roots without instances: {empty}")
        return found.orderBy("path")
    if mode != "enabled":
        raise DataError(f"unknown instance mode {mode!r}")
    spark = listing.sparkSession
    wanted = names if isinstance(names, DataFrame) else spark.createDataFrame([(n,) for n in names or []], "name string")
    require_rows(wanted, "the list of enabled instances")
    rank = F.create_map(*[x for i, r in enumerate(roots) for x in (F.lit(r), F.lit(i))])
    first = listing.withColumn("rank", F.element_at(rank, F.col("root"))).groupBy("name").agg(
        F.min_by("path", "rank").alias("path"), F.min_by("root", "rank").alias("root")
    )
    missing = wanted.join(first, "name", "left_anti").take(5)
    if missing:
        raise DataError(f"instances not found: {[r['name'] for r in missing]}")
    return wanted.join(first, "name")
