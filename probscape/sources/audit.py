"""Audit of a file collection: which files are problem instances, and of what kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probscape.common import cut, shared
from probscape.sources.corpus import number_lines, scan_text
from probscape.sources.text import fortran_decimal, fortran_integer, is_relevant, tokens

# Family -> (official description, conversion note).
FAMILIES = {
    "ANTENNA": ("Antenna array design problems", "SeDuMi cone model; not necessarily SDP unless K.s is present."),
    "BISECT": ("Min bisection problems from circuit partitioning", "Raw .dat graph files can be converted with genbisect.m/vec.m when available."),
    "COPOS": ("Checking a sufficient condition for copositivity of a matrix", "Distributed as SeDuMi SDP instances."),
    "FAP": ("Min k-uncut problems from frequency assignment", "Raw .dat graph files can be converted with genfap.m when available; fap36 has no .mat listed upstream."),
    "FILTER": ("Mixed SDP/SOCP problems from PAM filter design", "Mixed cone SeDuMi models; SDP status depends on K.s."),
    "HAMMING": ("Theta function instances of Hamming graphs", "Distributed as SDP instances; generate_hamming.m can create more."),
    "HINF": ("LMI problems", "LMI models are SDP instances."),
    "NQL": ("Quadratic plastic-collapse problems: plain strain models", "Quadratic cone SeDuMi models; converting to SDP would be a reformulation/lifting."),
    "QSSP": ("Quadratic plastic-collapse problems: supported plate models", "Quadratic cone SeDuMi models; converting to SDP would be a reformulation/lifting."),
    "SCHED": ("Quadratic relaxations of scheduling problems", "Quadratic cone SeDuMi models; scaled files are reformulations with c_mult."),
    "TORUS": ("Max-cut problems from the Ising model of spin glasses", "Raw .dat graph files can be converted with gentorus.m when available."),
    "TRUSS": ("Truss topology design problems", "Distributed as SeDuMi SDP instances."),
}

# The comment marks.
COMMENTS = ('"', "*", "#", "%")


def extension(path):
    """Lower-case suffix of the file name with its dot; none for a leading dot only."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"[^.](\.[^.]*)$", 1))


def attach_family(files: DataFrame) -> DataFrame:
    """Family = first folder of ``path``; description and note from the family dictionary."""
    parts = F.split("path", "/")
    family = F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise(F.lit(""))
    known = F.create_map(*[x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.try_element_at(known, F.upper("family"))
    return files.withColumn("family", family).withColumns({
        "official_description": F.coalesce(F.get(found, 0), F.lit("")),
        "conversion_note": F.coalesce(F.get(found, 1), F.lit("")),
    })


def _relevant(lines: DataFrame, limit: int | None) -> DataFrame:
    """Lines that are no comments, of each file or of its first ``limit`` lines."""
    found = lines.where(is_relevant(F.col("line"), COMMENTS))
    return found if limit is None else found.where(F.col("line_no") < limit)


def _leading(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every file, numbered from 1; the limit applies before the shuffle."""
    order = Window.partitionBy("path").orderBy("line_no")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def _verdict(kind: str, reason: str, instance: bool = False, sdp: bool = False):
    return F.struct(
        F.lit(instance).alias("is_instance"), F.lit(sdp).alias("is_sdp"),
        F.lit(kind).alias("kind"), F.lit(reason).alias("reason"),
    )


def classify_graph_text(lines: DataFrame, first_lines: int | None = None, checked_rows: int | None = None) -> DataFrame:
    """Raw graph rule: an integer header ``n m [k]`` and in-range rows ``i j value``.

    Judges whole files; ``first_lines`` and ``checked_rows`` limit what is looked at. ``lines`` is
    ``(path, line_no, line)``. Header and ranges are plain aggregates, so a file spreads over tasks.
    """
    found = _relevant(lines, first_lines).select("path", "line_no", "line")
    # where headers stand is known first; then one pass reads each line's numbers and adds them up in its task
    heads = shared(cut(found.groupBy("path").agg(F.min("line_no").alias("head_no"))))
    found = found.join(heads, "path").withColumn("is_head", F.col("line_no") == F.col("head_no"))
    numbers = found.where(F.col("is_head") | F.col("line").rlike(r"^\s*[-+.0-9]"))
    t = numbers.select("path", "line_no", "is_head", F.explode(F.array(tokens(F.col("line")))).alias("t"))
    cells = F.struct(
        F.size("t").alias("size"), fortran_integer(F.get("t", 0)).alias("i"), fortran_integer(F.get("t", 1)).alias("j"),
        F.when(~F.col("is_head"), fortran_decimal(F.get("t", 2)).isNotNull()).alias("v"),
        F.when(F.col("is_head"), fortran_integer(F.get("t", 2)).isNotNull()).alias("k"),
    )
    rows = t.select("path", "line_no", "is_head", F.inline(F.array(cells)))
    pair = F.col("i").isNotNull() & F.col("j").isNotNull()
    rows = rows.withColumn("is_row", F.coalesce(~F.col("is_head") & pair & F.col("v"), F.lit(False)))
    if checked_rows is not None:
        rows = rows.where("is_head").unionByName(_leading(rows.where("is_row"), checked_rows).drop("r"))
    numeric = pair & ((F.col("size") == 2) | ((F.col("size") == 3) & F.col("k")))
    head = rows.groupBy("path").agg(
        F.count_if("is_row").alias("seen"), F.min(F.when(F.col("is_row"), F.least("i", "j"))).alias("lo"),
        F.max(F.when(F.col("is_row"), F.greatest("i", "j"))).alias("hi"), F.max(F.when(F.col("is_head"), numeric)).alias("numeric"),
        F.max(F.when(F.col("is_head"), F.col("i"))).alias("n"), F.max(F.when(F.col("is_head"), F.col("j"))).alias("m"),
    )
    # Kinds and reasons
    verdict = (
        F.when(~F.col("numeric"), _verdict("text", "header is not DIMACS numeric data"))
        .when((F.col("n") <= 0) | (F.col("m") < 0), _verdict("text", "invalid DIMACS dimensions"))
        .when((F.col("lo") < 1) | (F.col("hi") > F.col("n")),
              _verdict("text", "entry index outside header dimensions"))
        .when((F.col("m") > 0) & (F.col("seen") == 0), _verdict("text", "no valid DIMACS data rows found"))
        .otherwise(_verdict("raw-dimacs-data", "numeric DIMACS data file; not a solver-ready SDP formulation", True))
    )
    return head.select("path", verdict.alias("v"))


def classify_problem_text(lines: DataFrame, first_lines: int | None = None) -> DataFrame:
    """Sparse problem rule: single-token m and n_blocks, non-zero block sizes, m values of b."""
    heads = _leading(_relevant(lines, first_lines), 4).groupBy("path").agg(
        F.max("r").alias("rows"),
        *[F.max(F.when(F.col("r") == i, F.col("line"))).alias(f"l{i}") for i in (1, 2, 3, 4)],
    ).select("path", "rows", *[tokens(F.col(f"l{i}")).alias(f"t{i}") for i in (1, 2, 3, 4)])
    one = {i: F.when(F.size(f"t{i}") == 1, fortran_integer(F.get(f"t{i}", 0))) for i in (1, 2)}
    sizes = F.transform("t3", fortran_integer)
    b_ok = F.forall(F.transform("t4", fortran_decimal), lambda x: x.isNotNull())
    parsed = heads.select(
        "path", "rows", one[1].alias("m"), one[2].alias("nb"), sizes.alias("sizes"),
        (F.size("t4")).alias("nb_b"), b_ok.alias("b_ok"),
    )
    header_ok = F.coalesce((F.col("m") > 0) & (F.col("nb") > 0), F.lit(False))
    blocks_ok = (F.size("sizes") == F.col("nb")) & F.forall("sizes", lambda x: x.isNotNull() & (x != 0))
    has_sdp = F.exists("sizes", lambda x: x > 0)
    # Kinds and reasons
    verdict = (
        F.when(F.col("rows") < 4, _verdict("text", "too few numeric lines for SDPA"))
        .when(~header_ok, _verdict("text", "missing SDPA m/block header"))
        .when(~F.coalesce(blocks_ok, F.lit(False)), _verdict("text", "invalid SDPA block structure"))
        .when((F.col("nb_b") != F.col("m")) | ~F.col("b_ok"), _verdict("text", "invalid SDPA objective vector"))
        .when(has_sdp, _verdict("sdpa-text", "has semidefinite blocks", True, True))
        .otherwise(_verdict("sdpa-text", "has only linear diagonal blocks", True))
    )
    return parsed.select("path", verdict.alias("v"))


def classify_containers(variables: DataFrame, cones: DataFrame) -> DataFrame:
    """Container rule: the variables of a known solver's problem, and whether it has semidefinite cones.

    ``variables`` is ``(path, variable)`` and ``cones`` ``(path, s, ...)``, as read from the containers' heads.
    """
    names = variables.groupBy("path").agg(F.collect_set("variable").alias("names"))
    sizes = cones.groupBy("path").agg(F.max(F.coalesce(F.exists("s", lambda x: x != 0), F.lit(False))).alias("has_s"))

    def has(*wanted: str):
        return F.size(F.array_intersect("names", F.array(*map(F.lit, wanted)))) == len(wanted)

    first = has("K", "b", "c") & (has("A") | has("At"))
    second = has("blk", "At", "C", "b")
    # Kinds and reasons
    verdict = (
        F.when(second, _verdict("sdpt3-mat", "contains SDPT3 variables blk/At/C/b", True, True))
        .when(~first, _verdict("matlab-mat", "missing known SDP solver variables"))
        .when(F.coalesce("has_s", F.lit(False)), _verdict("sedumi-mat", "contains SeDuMi K.s semidefinite cone", True, True))
        .otherwise(_verdict("sedumi-mat", "SeDuMi instance without K.s cone", True))
    )
    return names.join(sizes, "path", "left").select("path", verdict.alias("v"))


def classify_files(
    files: DataFrame, lines: DataFrame, graph_lines: int | None = None, text_lines: int | None = None, checked_rows: int | None = None,
    containers: DataFrame | None = None,
) -> DataFrame:
    """Audit records of ``files(path, size_bytes)`` from their ``lines(path, line_no, line)``.

    Whole files are judged unless a limit is given. ``containers`` has the verdicts of binary containers
    (``classify_containers``); without one a container is reported as not inspected.
    """
    ext = extension(F.col("path"))
    routed = files.withColumn("extension", ext).withColumn(
        "route",
        F.when(F.col("extension") == ".m", "script")
        .when(F.col("extension") == ".mat", "container")
        .when(F.lower("path").endswith(".dat-s") | F.col("extension").isin(".sdpa", ".sdp"), "problem")
        .when(F.col("extension") == ".dat", "graph")
        .otherwise("other"),
    )
    # a file's route picks its lines before any of them is tokenised
    for_graph = lines.where(extension(F.col("path")) == ".dat")
    for_text = lines.where(F.lower("path").endswith(".dat-s") | extension(F.col("path")).isin(".sdpa", ".sdp"))
    verdicts = classify_graph_text(for_graph, graph_lines, checked_rows).unionByName(classify_problem_text(for_text, text_lines))
    if containers is not None:
        verdicts = verdicts.unionByName(containers.where(extension(F.col("path")) == ".mat").select("path", "v"))
    # Kinds and reasons
    fallback = (
        F.when(F.col("route") == "script", _verdict("matlab-script", "source/generator script"))
        .when(F.col("route") == "container", _verdict("matlab-mat", "container not inspected"))
        .when(F.col("route") == "problem", _verdict("text", "too few numeric lines for SDPA"))
        .when(F.col("route") == "graph", _verdict("empty", "empty or comment-only file"))
        .otherwise(
            F.struct(
                F.lit(False).alias("is_instance"), F.lit(False).alias("is_sdp"), F.lit("unknown").alias("kind"),
                F.concat(F.lit("unsupported extension '"), F.regexp_extract("path", r"[^./](\.[^./]*)$", 1), F.lit("'")).alias("reason"),
            )
        )
    )
    v = F.coalesce(F.col("v"), fallback)
    out = routed.join(verdicts, "path", "left").withColumn("v", v)
    return attach_family(out).select(
        "path", "family", "official_description", "extension", "size_bytes",
        F.col("v.is_instance").alias("is_instance"),
        F.when(F.col("v.is_instance"), F.col("v.is_sdp")).alias("is_sdp"),
        F.col("v.kind").alias("kind"), F.col("v.reason").alias("reason"), "conversion_note",
    )


def audit_folder(spark: SparkSession, root: str) -> DataFrame:
    """Audit every file below ``root``; paths are relative to it."""
    base = root.rstrip("/") + "/"

    def below(path):
        return F.url_decode(F.substring_index(path, base, -1))

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(below(F.col("path")).alias("path"), F.col("length").alias("size_bytes"))
    )
    raw = scan_text(spark, root).where(F.lower("file_path").rlike(r"\.(dat|dat-s|sdpa|sdp)$"))
    lines = number_lines(raw, below(F.col("file_path"))).select(
        F.col("instance").alias("path"), F.col("seq").alias("line_no"), "line"
    )
    return classify_files(files, lines)


def audit_summary(audit: DataFrame) -> DataFrame:
    inst, sdp = F.col("is_instance"), F.coalesce(F.col("is_sdp"), F.lit(False))
    return audit.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(inst).alias("instances"),
        F.count_if(inst & sdp).alias("sdp_instances"),
        F.count_if(inst & ~sdp).alias("non_sdp_instances"),
        F.count_if(~inst).alias("not_instances"),
    )
