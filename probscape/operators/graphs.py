"""Weighted graphs and the problems made of them.

``graphs(graph, n[, m, k])`` and ``edges(graph, i, j, w)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probscape.common import DataError
from probscape.functions.features import Corpus
from probscape.sources.corpus import number_lines, path_below, scan_text
from probscape.sources.text import tokens

# Families that can be converted, largest n converted by default, the weight
# above which a frequency pair is fixed, the divisor of Gaussian torus weights.
CONVERTERS = ("BISECT", "FAP", "TORUS")
MAX_N = 5000
FIXED_ABOVE = 900
TORUS_G_SCALE = 100000.0


def parse_graphs(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph text ``(instance, seq, line)`` → graphs, edges, and the data rows as tokens.

    Line 0 is the header ``n m [k]``, every other line ``i j w …``; indices are folded to i ≤ j.
    """
    split = lines.select(F.col("instance").alias("graph"), "seq", F.explode(F.array(tokens(F.col("line")))).alias("t")).where(F.size("t") > 0)
    t = F.col("t")
    heads = split.where("seq = 0").select(
        "graph", *[F.get(t, i).cast("int").alias(c) for i, c in enumerate(("n", "m", "k"))]
    )
    data = split.where("seq > 0")
    i, j = (F.get(t, x).cast("double").cast("int") for x in (0, 1))
    edges = data.where(F.size("t") >= 3).select(
        "graph", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), F.get(t, 2).cast("double").alias("w")
    )
    return heads, edges, data.select("graph", F.col("t").alias("tokens"))


def read_graphs(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Graphs and edges of ``.dat`` files, named by their path below the folder; contradictions to a header fail."""
    raw = scan_text(spark, paths).where(F.lower("file_path").endswith(".dat"))
    heads, edges, data = parse_graphs(number_lines(raw, path_below(paths)))
    if strict:
        validate_graph(heads, data, strict=True)
    return heads, edges


def validate_graph(headers: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """Compare headers ``(graph, m)`` with data rows ``(graph, tokens)``: m rows of ≥ 3 tokens."""
    seen = rows.groupBy("graph").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size("tokens")).alias("least_tokens")
    )
    out = headers.join(seen, "graph", "left").select(
        "graph", F.col("m").cast("bigint").alias("expected"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("least_tokens", F.lit(0)).alias("least_tokens"),
    ).withColumn("valid", (F.col("n_rows") == F.col("expected")) & (F.col("least_tokens") >= 3))
    if strict:
        bad = out.where(~F.col("valid")).take(5)
        if bad:
            raise DataError(f"graphs that contradict their header: {[r['graph'] for r in bad]}")
    return out


def graph_weight_matrix(edges: DataFrame) -> DataFrame:
    """Symmetric weights ``(graph, i, j, w)``: repeated edges summed, loops counted twice.

    Edges are summed in folded form, so each is shuffled once; the mirror image is made after.
    """
    folded = edges.groupBy("graph", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("w").alias("w"))
    here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("w").alias("w"))
    there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w"))
    loop = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), (2 * F.col("w")).alias("w"))
    cells = F.when(F.col("i") == F.col("j"), F.array(loop)).otherwise(F.array(here, there))
    return folded.select("graph", F.explode(cells).alias("c")).select("graph", "c.*")


def degrees(weights: DataFrame) -> DataFrame:
    return weights.groupBy("graph", F.col("j").alias("i")).agg(F.sum("w").alias("degree"))


def _objective(graphs: DataFrame, edges: DataFrame, diag, off) -> DataFrame:
    """Entries of diag(degree)·diag + W·off, zeros dropped, both triangles folded onto the upper."""
    w = graph_weight_matrix(edges)
    cells = w.select("graph", "i", "j", F.lit(0.0).alias("d"), "w").unionByName(
        degrees(w).select("graph", "i", F.col("i").alias("j"), F.col("degree").alias("d"), F.lit(0.0).alias("w"))
    )
    summed = cells.groupBy("graph", "i", "j").agg(F.sum("d").alias("d"), F.sum("w").alias("w"))
    valued = summed.join(graphs, "graph").select("graph", "i", "j", (diag * F.col("d") + off * F.col("w")).alias("value"))
    return valued.where("value <> 0")


def _entries(df: DataFrame, mat, block) -> DataFrame:
    return df.select(
        F.col("graph").alias("instance"), mat.cast("int").alias("mat_id"), block.cast("int").alias("block_id"),
        F.least("i", "j").cast("int").alias("row"), F.greatest("i", "j").cast("int").alias("col"), "value",
    )


def _each(graphs: DataFrame, name: str = "i") -> DataFrame:
    return graphs.withColumn(name, F.explode(F.sequence(F.lit(1), F.col("n"))))


#: Positions of matrices, about, that one task makes.
TASK_CELLS = 500_000


def cell_parts(graphs: DataFrame) -> int:
    """Tasks for all n² positions of the graphs."""
    n = F.col("n").cast("double")
    total = graphs.agg(F.sum(n * n)).first()[0] or 0.0
    return max(graphs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_CELLS))


def _cells(columns: DataFrame, parts: int) -> DataFrame:
    """All n² positions from ``columns(graph, n, j)``, which are dealt to a given number of tasks before the rows are made:
    planned by the size of the columns alone, they would meet in a few."""
    return columns.repartition(parts, "graph", "j").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))


def _fap_columns(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns ``(graph, n, k, j, equal, before, n_free)``: the rows without a slack (the diagonal and pairs with a heavy
    edge), the slacks of earlier columns, and those of the graph."""
    heads = graphs.select("graph", "n", "k")
    fixed = edges.where(F.col("w") > FIXED_ABOVE).join(heads, "graph").where("least(i, j) >= 1 AND greatest(i, j) <= n")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    equal = fixed.select("graph", "n", "k", F.inline(both)).unionByName(_each(heads).withColumn("j", F.col("i")))
    columns = equal.groupBy("graph", "n", "k", "j").agg(F.collect_set("i").alias("equal"))
    here = (F.col("n") - F.size("equal")).cast("bigint")
    whole = Window.partitionBy("graph")
    earlier = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    return columns.withColumns({"before": F.coalesce(F.sum(here).over(earlier), F.lit(0)), "n_free": F.sum(here).over(whole)})


def graph_to_problem(graphs: DataFrame, edges: DataFrame, kind: str, max_n: int | None = None, weight_scale: float = 1.0) -> Corpus:
    """Problems of one family; a given ``max_n`` leaves larger graphs out (``plan_conversion`` reports them).

    BISECT  C = ¼(D − W); unit diagonal, all entries sum to 0.
    TORUS   C = ½(D − W); unit diagonal.
    FAP     C = (D + (k − 1)W)/2k; every position ≥ −1/(k − 1) by a slack, equal for pairs
            heavier than 900, and a unit diagonal.
    """
    if kind not in CONVERTERS:
        raise DataError(f"no conversion for family {kind!r}")
    if max_n is not None:
        graphs = graphs.where(F.col("n") <= max_n)
        edges = edges.join(graphs.select("graph"), "graph", "left_semi")
    if weight_scale != 1.0:
        edges = edges.withColumn("w", F.col("w") / weight_scale)
    n, one = F.col("n"), F.lit(1.0)
    parts = 1 if kind == "TORUS" else cell_parts(graphs)
    diagonal = _each(graphs).select("graph", "i", F.col("i").alias("j"), one.alias("value"))
    if kind != "FAP":
        share = 0.25 if kind == "BISECT" else 0.5
        c = _entries(_objective(graphs, edges, F.lit(share), F.lit(-share)), F.lit(0), F.lit(1))
        pieces = [c, _entries(diagonal, F.col("i"), F.lit(1))]
        rhs = _each(graphs).select(F.col("graph").alias("instance"), F.col("i").alias("mat_id"), one.alias("b"))
        m = n
        if kind == "BISECT":
            pieces.append(_entries(_cells(_each(graphs, "j"), parts).withColumn("value", one), F.col("n") + 1, F.lit(1)))
            rhs = rhs.unionByName(graphs.select(F.col("graph").alias("instance"), (n + 1).alias("mat_id"), F.lit(0.0).alias("b")))
            m = n + 1
        problems = graphs.select(F.col("graph").alias("instance"), m.cast("int").alias("m"), F.lit(1).alias("n_blocks"))
        blocks = graphs.select(F.col("graph").alias("instance"), F.lit(1).alias("block_id"), n.cast("int").alias("size"))
        return Corpus(problems, blocks, rhs, reduce(DataFrame.unionByName, pieces))

    k = F.when(F.col("k") > 1, F.col("k")).otherwise(F.raise_error(F.lit("FAP needs k > 1")).cast("int"))
    position = (F.col("i") - 1).cast("bigint") + (F.col("j") - 1).cast("bigint") * n
    columns = _fap_columns(graphs, edges)
    block = F.when(F.col("n_free") > 0, 2).otherwise(1)
    free = F.array_except(F.sequence(F.lit(1), n), F.col("equal"))
    slack = columns.repartition(parts, "graph", "j").select("graph", "n", "j", "before", F.posexplode(free).alias("place", "i"))
    slack = slack.withColumn("t", F.col("before") + F.col("place") + 1)
    sized = graphs.join(columns.where("j = 1").select("graph", "n_free"), "graph", "left").withColumn("n_free", F.coalesce("n_free", F.lit(0)))
    sdp_block = sized.select("graph", block.alias("block"))

    c = _objective(graphs, edges, 1.0 / (2.0 * k), (k - 1) / (2.0 * k)).join(sdp_block, "graph")
    every = _cells(columns.select("graph", "n", "j", block.alias("block")), parts).withColumn("value", one)
    slack_rows = slack.select("graph", position.alias("p"), F.col("t").alias("i"), F.col("t").alias("j"), F.lit(-1.0).alias("value"))
    entries = (
        _entries(c, F.lit(0), F.col("block"))
        .unionByName(_entries(every, position + 1, F.col("block")))
        .unionByName(_entries(slack_rows, F.col("p") + 1, F.lit(1)))
    )
    b = F.when(F.col("i") == F.col("j"), 1.0).otherwise(-1.0 / (k - 1))
    rhs = _cells(_each(graphs, "j"), parts).select(F.col("graph").alias("instance"), (position + 1).cast("int").alias("mat_id"), b.alias("b"))
    problems = sized.select(
        F.col("graph").alias("instance"), (n * n).cast("int").alias("m"), F.when(F.col("n_free") > 0, 2).otherwise(1).alias("n_blocks")
    )
    sizes = F.when(F.col("n_free") > 0, F.array(-F.col("n_free").cast("int"), n.cast("int"))).otherwise(F.array(n.cast("int")))
    blocks = sized.select(F.col("graph").alias("instance"), F.posexplode(sizes).alias("pos", "size")).select(
        "instance", (F.col("pos") + 1).alias("block_id"), "size"
    )
    return Corpus(problems, blocks, rhs, entries)


# ----------------------------------------------------------------------------- planning


def plan_conversion(
    files: DataFrame, existing: DataFrame, max_n: int = MAX_N, overwrite: bool = False,
    allow_huge: bool = False, convert_existing_raw: bool = False,
) -> DataFrame:
    """What a conversion run does with every file: ``(source, target, status, detail)``.

    ``files`` is ``(path, is_instance, is_sdp, n)``, ``existing`` the paths of targets that
    are there already.  Files of no concern are left out.
    """
    stem = F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", "")
    ext = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    family = F.upper(F.split("path", "/")[0])
    base = files.withColumns({"ext": ext, "family": family, "target": F.when(ext == ".mat", F.col("path")).otherwise(F.concat(stem, F.lit(".mat")))})
    ready = F.col("is_instance") & F.coalesce("is_sdp", F.lit(False)) & (F.col("ext") == ".mat")
    raw = (F.col("ext") == ".dat") & F.col("family").isin(*CONVERTERS)
    official = base.where(ready).select(F.concat(stem, F.lit(".mat")).alias("target"), F.lit(True).alias("has_official")).distinct()
    there = existing.select(F.col("path").alias("target"), F.lit(True).alias("is_there")).distinct()
    planned = base.where(ready | raw).withColumn("ready", ready).join(official, "target", "left").join(there, "target", "left")
    has_official, is_there = F.coalesce("has_official", F.lit(False)), F.coalesce("is_there", F.lit(False))

    def action(status, detail):
        return F.struct(F.lit(status).alias("status"), (detail if not isinstance(detail, str) else F.lit(detail)).alias("detail"))

    # States and details of the conversion
    huge = F.concat(
        F.lit("n="), F.col("n").cast("string"), F.lit(f" exceeds --max-convert-n={max_n}; use --allow-huge to force")
    )
    done = F.concat(F.col("family"), F.lit(" .dat converted to SDP SeDuMi .mat"))
    what = (
        F.when(F.col("ready") & is_there & F.lit(not overwrite), action("exists", "SDP .mat already present"))
        .when(F.col("ready"), action("copied", "already SDP"))
        .when(has_official & F.lit(not convert_existing_raw), action("skipped", "official same-name SDP .mat exists and will be copied"))
        .when(is_there & F.lit(not overwrite and not convert_existing_raw), action("skipped", "target SDP .mat already exists"))
        .when((F.col("n") > max_n) & F.lit(not allow_huge), action("skipped-huge", huge))
        .otherwise(action("converted", done))
    )
    return planned.select(F.col("path").alias("source"), "target", what.alias("a")).select("source", "target", "a.*")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
