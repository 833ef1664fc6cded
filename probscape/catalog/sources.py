"""Corpus text, stage tables, listings and the audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from probscape import adapters as ad
from probscape.catalog import features as cf
from probscape.catalog.base import query
from probscape.common import table
from probscape.functions.features import build_features, Corpus
from probscape.sources import audit, containers as ct, corpus as cp, tables
from probscape.sources.text import is_relevant, parse_block_sizes

E_FILES = (ad.FILES,)
_ENTRY_SUMS = """SELECT instance, mat_id, m, n_blocks, count(*) AS n, sum(value) AS total,
  sum(least(row, col) * 1000 + greatest(row, col))::BIGINT AS places
FROM {src} JOIN problems USING (instance) GROUP BY ALL"""


def _entry_sums(c: Corpus):
    return c.entries.join(c.problems, "instance").groupBy("instance", "mat_id", "m", "n_blocks").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
        F.sum(F.col("row") * 1000 + F.col("col")).alias("places"),
    )


@query(
    "s1_discover_instances",
    "SELECT path, size_bytes FROM files WHERE lower(path) LIKE '%.dat-s' OR lower(path) LIKE '%.mat'", E_FILES,
)
def s1(spark, sf_dir):
    return cp.supported_instances(ad.files(spark, sf_dir)).select("path", "size_bytes")


# Body rows every instance gets besides its entries; only the last is valid.
_NOISE = ["1 1 1 1", "a 1 1 1 2.0", "0 1 1 1 0.0", "99 1 1 1 5.0", "1 99 1 1 5", "1 0 1 1 5", "-1 1 1 1 5",
          "1.5 1 1 1 5", "1 1 1 1 2x", "* 1 1 1 1", '" 1 1 1 1', "   ", "  1 1  3 2 7.5 extra"]


@query(
    "s2_read_problem_corpus",
    _ENTRY_SUMS.format(
        src="(SELECT * FROM entries UNION ALL SELECT instance, 1, 1, 2, 3, 7.5 FROM problems) AS e"
    ),
    (ad.CORPUS,), "total",
)
def s2(spark, sf_dir):
    c = ad.corpus(spark, sf_dir)
    text = cp.render_corpus(c).select("instance", F.col("section").cast("bigint").alias("seq"), "line")
    noise = c.problems.select(
        "instance", F.lit(5).cast("bigint").alias("seq"), F.explode(F.array(*map(F.lit, _NOISE))).alias("line")
    )
    return _entry_sums(cp.parse_lines(text.unionByName(noise.where(is_relevant(F.col("line"))))))


@query(
    "s3_parse_block_sizes",
    """SELECT s_suppkey AS id, pos, CASE pos WHEN 0 THEN (s_suppkey + 1)::INT WHEN 1 THEN -(s_suppkey % 7 + 1)::INT ELSE 3 END AS size
       FROM supplier, (VALUES (0), (1), (2)) AS v(pos)""",
)
def s3(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "concat(' {', cast(s_suppkey + 1 AS string), ', -', cast(s_suppkey % 7 + 1 AS string), '} ( +3 ),') AS line",
    )
    return lines.select("id", F.posexplode(parse_block_sizes(F.col("line"))).alias("pos", "size"))


_VEC = """
offs AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY instance ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
         FROM (SELECT *, (CASE WHEN size > 0 THEN size * size ELSE -size END)::BIGINT AS w FROM blocks)),
tot AS (SELECT instance, sum(w)::BIGINT AS total FROM offs GROUP BY instance),
vec AS (SELECT 'inst' || l_suppkey AS instance, (l_orderkey * 7 + l_partkey) % total AS idx
        FROM lineitem JOIN tot ON tot.instance = 'inst' || l_suppkey)
"""


@query(
    "s5_vec_to_block",
    """SELECT instance, idx, block_id, least(r, c)::INT AS row, greatest(r, c)::INT AS col, count(*) AS n FROM (
         SELECT instance, idx, block_id, CASE WHEN size > 0 THEN (idx - a) % size ELSE idx - a END + 1 AS r,
                CASE WHEN size > 0 THEN (idx - a) // size ELSE idx - a END + 1 AS c
         FROM vec JOIN offs USING (instance) WHERE idx >= a AND idx < a + w) GROUP BY ALL""",
    (ad.CORPUS, _VEC),
)
def s5(spark, sf_dir):
    blocks = ad.corpus(spark, sf_dir).blocks
    totals = cp.block_offsets(blocks).groupBy("instance").agg(F.max("end").alias("total"))
    vec = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("concat('inst', cast(l_suppkey AS string)) AS instance", "l_orderkey * 7 + l_partkey AS x")
        .join(totals, "instance")
        .selectExpr("instance", "x % total AS idx")
    )
    return cp.vec_to_block(vec, blocks).groupBy("instance", "idx", "block_id", "row", "col").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s2_read_containers",
    """SELECT 'inst' || l_suppkey AS instance, (l_linenumber - 1)::INT AS mat_id, CASE WHEN l_partkey % 40 < 24 THEN 1 ELSE 2 END::INT AS block_id,
              CASE WHEN l_partkey % 40 < 24 THEN l_partkey % 40 + 1 ELSE least((l_partkey % 40 - 24) % 4, (l_partkey % 40 - 24) // 4) + 1 END::INT AS row,
              CASE WHEN l_partkey % 40 < 24 THEN l_partkey % 40 + 1 ELSE greatest((l_partkey % 40 - 24) % 4, (l_partkey % 40 - 24) // 4) + 1 END::INT AS col,
              sum(l_quantity) AS value FROM lineitem GROUP BY ALL""",
    doubles="value",
)
def s2_containers(spark, sf_dir):
    """Written as packed binary containers, one an instance, and read again by ranges of columns."""
    vec = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('inst', cast(l_suppkey AS string)) AS instance", "cast(l_linenumber - 1 AS int) AS mat_id", "cast(l_partkey % 40 AS int) AS idx", "l_quantity AS q")
    folder = tables.shared_path(spark, "containers")
    ct.write_containers(vec.groupBy("instance", "mat_id", "idx").agg(F.sum("q").alias("value")), folder, 40, 6, {"l": [24.0], "s": [4.0]}).count()
    found = ct.read_containers(spark, folder).entries
    return found.groupBy("instance", "mat_id", "block_id", "row", "col").agg(F.sum("value").alias("value"))


@query(
    "s6_cone_blocks",
    """SELECT 'inst' || s AS instance, (row_number() OVER (PARTITION BY s ORDER BY o))::INT AS block_id, size::INT AS size FROM (
         SELECT s_suppkey AS s, unnest([1, 2, 3, 4, 5, 6, 7]) AS o,
           unnest([-(s_suppkey % 4), -(s_suppkey % 3 + s_suppkey % 2), -3, 0, -(s_suppkey % 5), 4 + s_suppkey % 6, 2]) AS size
         FROM supplier) WHERE size <> 0""",
)
def s6(spark, sf_dir):
    cones = table(spark, sf_dir, "supplier").selectExpr(
        "concat('inst', cast(s_suppkey AS string)) AS instance",
        "array(double(s_suppkey % 4)) AS f", "array(double(s_suppkey % 3), double(s_suppkey % 2)) AS l",
        "array(3D, 0D, double(s_suppkey % 5)) AS q", "cast(NULL AS array<double>) AS r",
        "array(double(4 + s_suppkey % 6), 2D) AS s",
    )
    return cp.cone_blocks(cones)


@query("s7_load_stage", *(lambda s: (s[0], cf.CTES, s[1]))(
    cf.feature_sql(["m", "n_total_matrix", "std_block_size"], cf._JOINS["size"])))
def s7(spark, sf_dir):
    path = tables.shared_path(spark, "features")
    wanted = ["feature_m", "feature_n_total_matrix", "feature_std_block_size"]
    tables.load_stage(spark, "build", path, lambda: build_features(ad.corpus(spark, sf_dir), wanted))
    return tables.load_stage(spark, "csv", path, lambda: None)


@query(
    "s8_write_table",
    f"SELECT instances, source, {', '.join(ad.FEATURES)}, {', '.join(ad.ALGOS)}, k FROM metadata",
    (ad.METADATA,), " ".join([*ad.FEATURES, *ad.ALGOS]),
)
def s8(spark, sf_dir):
    df, path = ad.metadata(spark, sf_dir), tables.shared_path(spark, "table")
    tables.write_table(df, path, "csv")
    tables.write_table(df, path, "csv")  # a second write replaces the first
    return tables.read_table(spark, path, "csv", df.schema)


@query("s9_export_corpus", _ENTRY_SUMS.format(src="entries"), (ad.CORPUS,), "total")
def s9(spark, sf_dir):
    """Written as text files and read back."""
    path = tables.shared_path(spark, "corpus")
    cp.export_corpus(ad.corpus(spark, sf_dir), path)
    return _entry_sums(cp.read_problem_corpus(spark, path))


_ROOTS = ["BISECT", "torus", "FAP", "other"]
_LISTING = """
listing AS (SELECT CASE split_part(url, '/', 4) WHEN 'de' THEN 'BISECT' WHEN 'en' THEN 'torus' WHEN 'es' THEN 'FAP' ELSE 'other' END AS root,
    'n' || (page_id // 5) || '.mat' AS name, page_id FROM pages),
ranked AS (SELECT *, CASE root WHEN 'BISECT' THEN 0 WHEN 'torus' THEN 1 WHEN 'FAP' THEN 2 ELSE 3 END AS rk,
    root || '/' || name AS path FROM listing)
"""


@query(
    "s10_select_instances",
    """SELECT DISTINCT name, arg_min(path, rk) OVER (PARTITION BY name) AS path, arg_min(root, rk) OVER (PARTITION BY name) AS root
       FROM ranked WHERE name IN (SELECT name FROM listing WHERE page_id % 2 = 0 AND page_id % 5 = 0)""",
    (_LISTING,),
)
def s10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(
        "CASE split(url, '/')[3] WHEN 'de' THEN 'BISECT' WHEN 'en' THEN 'torus' WHEN 'es' THEN 'FAP' ELSE 'other' END AS root",
        "concat('n', cast(page_id div 5 AS string), '.mat') AS name", "page_id",
    )
    listing = pages.selectExpr("root", "name", "concat(root, '/', name) AS path").distinct()
    names = pages.where("page_id % 2 = 0 AND page_id % 5 = 0").select("name").distinct()
    return cp.select_instances(listing, _ROOTS, "enabled", names).select("name", "path", "root")


@query(
    "s11_display_name",
    """SELECT page_id, CASE WHEN path LIKE 'BISECT/%' THEN substr(path, 8) ELSE split_part(path, '/', -1) END AS name FROM files""",
    E_FILES,
)
def s11(spark, sf_dir):
    files = ad.files(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/"), "path"))
    return files.select("page_id", cp.display_name(F.col("path"), "/data/BISECT").alias("name"))


# ------------------------------------------------------------------------------- audit


def _audit_inputs(spark, sf_dir):
    """Files and lines made of the corpus (.dat-s), the graphs (.dat) and the documents."""
    sup = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS s")
    text = sup.selectExpr(
        "concat('lib/inst', cast(s AS string), '.dat-s') AS path",
        "explode(array(struct(0L AS line_no, '# made from a supplier' AS line), struct(1L AS line_no, cast(2 + s % 2 AS string) AS line), "
        "struct(2L AS line_no, CASE WHEN s % 7 = 4 THEN '1 2' ELSE '2' END AS line), "
        "struct(3L AS line_no, CASE s % 7 WHEN 2 THEN '4 0' WHEN 3 THEN '-4 -3' WHEN 5 THEN '4' ELSE '5 -3' END AS line), "
        "struct(4L AS line_no, CASE WHEN s % 7 = 1 THEN '1.5' WHEN s % 2 = 1 THEN '1.0D0 2 -3e1' ELSE '1.0 2.5d-1' END AS line), "
        "struct(5L AS line_no, CASE WHEN s % 7 = 6 THEN '% end' ELSE '0 1 1 1 1.0' END AS line))) AS x",
    ).selectExpr("path", "x.line_no AS line_no", "x.line AS line")
    heads = sup.selectExpr(
        "concat('torus/g', cast(s AS string), '.dat') AS path", "0L AS line_no",
        "CASE s % 6 WHEN 3 THEN '20 5 1 1' WHEN 4 THEN '0 5' ELSE '20 5' END AS line",
    )
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('torus/g', cast(l_suppkey AS string), '.dat') AS path", "1L + l_orderkey % 500 AS line_no",
        "concat_ws(' ', cast(1 + l_orderkey % 20 + CASE WHEN l_suppkey % 6 = 1 AND l_orderkey % 500 > 250 THEN 100 ELSE 0 END AS string), "
        "cast(1 + l_partkey % 20 AS string), CASE WHEN l_suppkey % 6 = 2 THEN 'x' ELSE concat(cast(l_quantity AS string), 'D+00') END) AS line",
    )
    docs = table(spark, sf_dir, "documents").selectExpr(
        "concat('docs/d', cast(doc_id AS string), CASE doc_id % 4 WHEN 0 THEN '.dat' WHEN 1 THEN '.dat-s' WHEN 2 THEN '.txt' ELSE '.m' END) AS path",
        "text", "n_chars",
    )
    doc_lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )
    files = (
        sup.selectExpr("concat('lib/inst', cast(s AS string), '.dat-s') AS path", "s AS size_bytes")
        .unionByName(sup.selectExpr("concat('torus/g', cast(s AS string), '.dat') AS path", "s AS size_bytes"))
        .unionByName(docs.selectExpr("path", "n_chars AS size_bytes"))
        .unionByName(ad.files(spark, sf_dir).where("path LIKE '%.mat'").select("path", "size_bytes"))
    )
    return files, reduce(lambda a, b: a.unionByName(b), [text, heads, rows, doc_lines])


_DESCRIPTIONS = "(VALUES " + ", ".join(f"('{k}', '{d}', '{n}')" for k, (d, n) in audit.FAMILIES.items()) + ") AS fam(code, descr, note)"
_AUDIT = f"""
doc AS (SELECT 'docs/d' || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.dat' WHEN 1 THEN '.dat-s' WHEN 2 THEN '.txt' ELSE '.m' END) AS path,
    doc_id % 4 AS t, n_chars AS size_bytes, string_split(text, chr(10)) AS ls FROM documents),
doc2 AS (SELECT *, len(list_filter(ls, lambda x: regexp_replace(x, '[\\s]', '', 'g') <> '' AND NOT regexp_matches(x, '^\\s*["*#%]'))) AS rel200,
    len(list_filter(ls, lambda x: regexp_replace(x, '[\\s]', '', 'g') <> '' AND NOT regexp_matches(x, '^\\s*["*#%]'))) AS rel1000 FROM doc),
verdicts AS (
  SELECT 'lib/inst' || s_suppkey || '.dat-s' AS path, s_suppkey AS size_bytes,
    s_suppkey % 7 NOT IN (1, 2, 4, 5) AS ok, s_suppkey % 7 <> 3 AS sdp,
    CASE WHEN s_suppkey % 7 IN (1, 2, 4, 5) THEN 'text' ELSE 'sdpa-text' END AS kind,
    CASE s_suppkey % 7 WHEN 1 THEN 'invalid SDPA objective vector' WHEN 2 THEN 'invalid SDPA block structure'
      WHEN 3 THEN 'has only linear diagonal blocks' WHEN 4 THEN 'missing SDPA m/block header'
      WHEN 5 THEN 'invalid SDPA block structure' ELSE 'has semidefinite blocks' END AS reason FROM supplier
  UNION ALL
  SELECT 'torus/g' || s_suppkey || '.dat', s_suppkey, s_suppkey % 6 IN (0, 5), false,
    CASE WHEN s_suppkey % 6 IN (0, 5) THEN 'raw-dimacs-data' ELSE 'text' END,
    CASE s_suppkey % 6 WHEN 1 THEN 'entry index outside header dimensions' WHEN 2 THEN 'no valid DIMACS data rows found'
      WHEN 3 THEN 'header is not DIMACS numeric data' WHEN 4 THEN 'invalid DIMACS dimensions'
      ELSE 'numeric DIMACS data file; not a solver-ready SDP formulation' END FROM supplier
  UNION ALL
  SELECT path, size_bytes, false, false,
    CASE t WHEN 0 THEN (CASE WHEN rel200 = 0 THEN 'empty' ELSE 'text' END) WHEN 1 THEN 'text' WHEN 2 THEN 'unknown' ELSE 'matlab-script' END,
    CASE t WHEN 0 THEN (CASE WHEN rel200 = 0 THEN 'empty or comment-only file' ELSE 'header is not DIMACS numeric data' END)
      WHEN 1 THEN (CASE WHEN rel1000 < 4 THEN 'too few numeric lines for SDPA' ELSE 'missing SDPA m/block header' END)
      WHEN 2 THEN 'unsupported extension ''.txt''' ELSE 'source/generator script' END FROM doc2
  UNION ALL
  SELECT path, size_bytes, false, false, 'matlab-mat', 'container not inspected' FROM files WHERE path LIKE '%.mat'),
audit AS (SELECT path, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS family, coalesce(descr, '') AS official_description,
    '.' || split_part(path, '.', -1) AS extension, size_bytes::BIGINT AS size_bytes, ok AS is_instance,
    CASE WHEN ok THEN sdp END AS is_sdp, kind, reason, coalesce(note, '') AS conversion_note
  FROM verdicts LEFT JOIN {_DESCRIPTIONS} ON upper(CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END) = code)
"""


@query("p9_classify_files", "SELECT * FROM audit", (ad.FILES, _AUDIT))
def p9(spark, sf_dir):
    return audit.classify_files(*_audit_inputs(spark, sf_dir))


@query(
    "p10_attach_family",
    f"""SELECT path, family, coalesce(descr, '') AS official_description, coalesce(note, '') AS conversion_note
        FROM (SELECT path, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS family FROM files)
        LEFT JOIN {_DESCRIPTIONS} ON upper(family) = code""",
    E_FILES,
)
def p10(spark, sf_dir):
    return audit.attach_family(ad.files(spark, sf_dir)).select("path", "family", "official_description", "conversion_note")


@query(
    "a16_audit_summary",
    """SELECT count(*) AS files, count(*) FILTER (is_instance) AS instances, count(*) FILTER (is_instance AND is_sdp) AS sdp_instances,
         count(*) FILTER (is_instance AND NOT is_sdp) AS non_sdp_instances, count(*) FILTER (NOT is_instance) AS not_instances FROM audit""",
    (ad.FILES, _AUDIT),
)
def a16(spark, sf_dir):
    return audit.audit_summary(audit.classify_files(*_audit_inputs(spark, sf_dir)))
