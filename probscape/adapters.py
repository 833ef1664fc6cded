"""Views of the test tables in the shapes the library works on.

Each adapter has a SQL twin of the same name in upper case, used by the oracle queries.
They are narrow projections (or one map-side combined aggregate), so what a query costs is
the operator's own work.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probscape.common import table
from probscape.functions.features import Corpus

# ------------------------------------------------------------------ A: problem corpus

_N_BLOCKS = "1 + s % 5"
_M = "6 + s % 3"
_SIZE = (
    "CASE WHEN blk = 4 AND s % 4 = 0 THEN 1 "
    "WHEN blk = 5 OR (blk = 2 AND s % 2 = 0) THEN -(5 + (s * 7 + blk * 13) % 60) "
    "ELSE 5 + (s * 7 + blk * 13) % 60 END"
)
_RHS = "CASE WHEN s % 10 = 0 THEN 0.0D ELSE ((s * 31 + mat_id * 17) % 101 - 50) / 10.0D END"


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Instances are suppliers; the entries of an instance are its line items."""
    sup = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS s")
    name = "concat('inst', cast(s AS string)) AS instance"
    problems = sup.selectExpr(name, f"cast({_M} AS int) AS m", f"cast({_N_BLOCKS} AS int) AS n_blocks")
    blocks = (
        sup.selectExpr("s", f"explode(sequence(1, {_N_BLOCKS})) AS blk")
        .selectExpr(name, "cast(blk AS int) AS block_id", f"cast({_SIZE} AS int) AS size")
    )
    rhs = (
        sup.selectExpr("s", f"explode(sequence(1, {_M})) AS mat_id")
        .selectExpr(name, "cast(mat_id AS int) AS mat_id", f"{_RHS} AS b")
    )
    entries = (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "l_suppkey AS s",
            "cast(l_linenumber - 1 AS int) AS mat_id",
            "1 + l_partkey % (1 + l_suppkey % 5) AS blk",
            "l_orderkey AS o",
            "l_partkey div (1 + l_suppkey % 5) AS p",
            "CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS value",
        )
        .withColumn("size", F.expr(_SIZE))
        .selectExpr(
            name,
            "mat_id",
            "cast(blk AS int) AS block_id",
            "cast(1 + o % abs(size) AS int) AS row",
            "cast(1 + (CASE WHEN size > 0 THEN p ELSE o END) % abs(size) AS int) AS col",
            "value",
        )
    )
    return Corpus(problems, blocks, rhs, entries)


_SQL_SIZE = _SIZE
_SQL_RHS = _RHS.replace("0.0D", "0.0::DOUBLE").replace("10.0D", "10.0::DOUBLE")
CORPUS = f"""
problems AS (SELECT 'inst' || s_suppkey AS instance, (6 + s_suppkey % 3)::INT AS m,
                    (1 + s_suppkey % 5)::INT AS n_blocks, s_suppkey AS s FROM supplier),
blocks AS (SELECT instance, blk::INT AS block_id, ({_SQL_SIZE})::INT AS size
           FROM (SELECT instance, s, unnest(generate_series(1, n_blocks)) AS blk FROM problems)),
rhs AS (SELECT instance, mat_id::INT AS mat_id, ({_SQL_RHS})::DOUBLE AS b
        FROM (SELECT instance, s, unnest(generate_series(1, m)) AS mat_id FROM problems)),
entries AS (
  SELECT 'inst' || s AS instance, mat_id, blk::INT AS block_id,
         (1 + o % abs(size))::INT AS row,
         (1 + (CASE WHEN size > 0 THEN p ELSE o END) % abs(size))::INT AS col, value
  FROM (SELECT *, {_SQL_SIZE} AS size FROM (
    SELECT l_suppkey AS s, (l_linenumber - 1)::INT AS mat_id,
           1 + l_partkey % (1 + l_suppkey % 5) AS blk, l_orderkey AS o,
           l_partkey // (1 + l_suppkey % 5) AS p,
           CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS value
    FROM lineitem)))
"""

# ------------------------------------------------------------------ B: metadata

# Order priorities (they play the algorithms) and their column names.
PRIORITIES = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "plain",
    "5-LOW": "low",
}
ALGOS = [f"algo_{a}" for a in PRIORITIES.values()]
FEATURES = [
    "feature_mean_price", "feature_n_orders", "feature_open_share",
    "feature_price_range", "feature_price_sum",
]


def metadata(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Instances are customers; features and runtimes are aggregates of their orders.

    The last bits of a sum of doubles depend on the order of its summands. ``ordered`` adds a customer's orders by
    their key, for queries whose results show these bits; the running sums of a customer are a stream.
    """
    price = F.col("o_totalprice")

    def aggregates(over):
        return [
            over(F.avg(price)).alias("feature_mean_price"),
            over(F.count(F.lit(1))).cast("double").alias("feature_n_orders"),
            over(F.avg((F.col("o_orderstatus") == "O").cast("double"))).alias("feature_open_share"),
            (over(F.max(price)) - over(F.min(price))).alias("feature_price_range"),
            over(F.sum(price)).alias("feature_price_sum"),
            *[
                over(F.avg(F.when(F.col("o_orderpriority") == p, price))).alias(f"algo_{a}")
                for p, a in PRIORITIES.items()
            ],
        ]

    orders = table(spark, sf_dir, "orders")
    if ordered:
        so_far = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = orders.select("o_custkey", *aggregates(lambda c: c.over(so_far)))
        last = F.max_by(F.struct(*FEATURES, *ALGOS), "feature_n_orders").alias("last")
        orders = running.groupBy("o_custkey").agg(last).select("o_custkey", "last.*")
    else:
        orders = orders.groupBy("o_custkey").agg(*aggregates(lambda c: c))
    who = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS source")
    return orders.join(who, "o_custkey").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("instances"),
        "source", *FEATURES, *ALGOS, F.col("o_custkey").alias("k"),
    )


METADATA = """
metadata AS (
  SELECT 'c' || o_custkey AS instances, any_value(c_mktsegment) AS source,
         avg(o_totalprice) AS feature_mean_price, count(*)::DOUBLE AS feature_n_orders,
         avg(CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS feature_open_share,
         max(o_totalprice) - min(o_totalprice) AS feature_price_range,
         sum(o_totalprice) AS feature_price_sum,
""" + "".join(
    f"         avg(o_totalprice) FILTER (o_orderpriority = '{p}') AS algo_{a},\n"
    for p, a in PRIORITIES.items()
) + """         o_custkey AS k
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)
"""

# ------------------------------------------------------------------ C: points

#: Dimensions of a vector.
DIMS = 64
POINT_FEATURES = [f"f{i}" for i in range(DIMS)]
#: The 2 x 64 matrix that projects a vector, from a rule.
POINT_WEIGHTS = {f"f{i}": (round(0.6 * math.cos(1.3 * i + 0.4), 2), round(0.6 * math.sin(2.1 * i + 0.9), 2)) for i in range(DIMS)}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances are vectors: a feature for each dimension, and a 2-D position."""
    def along(k: int):
        weights = F.array(*[F.lit(w[k]) for w in POINT_WEIGHTS.values()])
        terms = F.zip_with("embedding", weights, lambda x, w: x.cast("double") * w)
        return F.round(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x), 6)

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("instance"),
        "label",
        *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(DIMS)],
        along(0).alias("z_1"), along(1).alias("z_2"),
    )


POINTS = "points AS (SELECT *, round({z1}, 6) AS z_1, round({z2}, 6) AS z_2 FROM (SELECT vec_id AS id, 'v' || vec_id AS instance, label, {dims} FROM embeddings))".format(
    z1=" + ".join(f"{w[0]}::DOUBLE * {f}" for f, w in POINT_WEIGHTS.items()),
    z2=" + ".join(f"{w[1]}::DOUBLE * {f}" for f, w in POINT_WEIGHTS.items()),
    dims=", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(DIMS)),
)

# ------------------------------------------------------------------ D: runs

SOLVERS = ["click", "error", "purchase", "signup", "view"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are events: instance = user, solver = event type, runtime = value."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("instance"),
        F.col("event_type").alias("solver"),
        F.col("value").alias("runtime"),
    )


RUNS = "runs AS (SELECT event_id, ts, 'u' || user_id AS instance, event_type AS solver, value AS runtime FROM events)"


# Fixed value: time limit, tolerance of a run in these views.
RUN_LIMIT, RUN_TOL = 60.0, 1e-2


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw result records: residuals and statuses derived from the event's value."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('u', cast(user_id AS string)) AS instance", "event_type AS solver",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 4000.0D END AS gap",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 97) / 9000.0D END AS pinfeas",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 89) / 9500.0D END AS dinfeas",
        "CASE WHEN event_id % 3 = 0 THEN value / 3500.0D END AS phi",
        "CASE event_id % 5 WHEN 0 THEN 'time_limit' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'Weird' "
        "WHEN 3 THEN 'OPTIMAL' ELSE NULL END AS status",
        "value AS runtime",
        "value * 3.0D - 40.0D AS pobj", "value * 2.9D - 39.0D AS dobj",
        "event_id % 50 AS user_k",
    )


RAW_RESULTS = """
raw AS (SELECT event_id, 'u' || user_id AS instance, event_type AS solver,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 4000.0::DOUBLE END AS gap,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 97) / 9000.0::DOUBLE END AS pinfeas,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 89) / 9500.0::DOUBLE END AS dinfeas,
  CASE WHEN event_id % 3 = 0 THEN value / 3500.0::DOUBLE END AS phi,
  CASE event_id % 5 WHEN 0 THEN 'time_limit' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'Weird'
       WHEN 3 THEN 'OPTIMAL' ELSE NULL END AS status,
  value AS runtime, value * 3.0::DOUBLE - 40.0::DOUBLE AS pobj,
  value * 2.9::DOUBLE - 39.0::DOUBLE AS dobj, event_id % 50 AS user_k FROM events)
"""

# ------------------------------------------------------------------ E: files

# File families, and the extensions by page number.
FAMILY_OF_LANG = {"de": "BISECT", "en": "TORUS", "es": "FAP", "fr": "OTHER"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing made of pages: ``path`` and ``size_bytes``."""
    return (
        table(spark, sf_dir, "pages")
        .withColumn("lang", F.split("url", "/").getItem(3))
        .selectExpr(
            "page_id",
            "concat(CASE lang WHEN 'de' THEN 'BISECT/' WHEN 'en' THEN 'torus/' WHEN 'es' THEN 'FAP/' "
            "ELSE '' END, 'file', cast(page_id div 3 AS string), "
            "CASE page_id % 6 WHEN 0 THEN '.dat' WHEN 1 THEN '.mat' WHEN 2 THEN '.DAT-S' "
            "WHEN 3 THEN '.m' WHEN 4 THEN '.dat' ELSE '.mat' END) AS path",
            "cast(length(html) AS bigint) AS size_bytes",
        )
    )


FILES = """
files AS (SELECT page_id,
  (CASE split_part(url, '/', 4) WHEN 'de' THEN 'BISECT/' WHEN 'en' THEN 'torus/' WHEN 'es' THEN 'FAP/'
        ELSE '' END) || 'file' || (page_id // 3) ||
  (CASE page_id % 6 WHEN 0 THEN '.dat' WHEN 1 THEN '.mat' WHEN 2 THEN '.DAT-S' WHEN 3 THEN '.m'
        WHEN 4 THEN '.dat' ELSE '.mat' END) AS path,
  length(html)::BIGINT AS size_bytes FROM pages)
"""

# ------------------------------------------------------------------ G: graphs


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One weighted graph per supplier, an edge per line item: ``(graphs, edges)``."""
    heads = table(spark, sf_dir, "supplier").selectExpr(
        "concat('g', cast(s_suppkey AS string)) AS graph",
        "cast(12 + s_suppkey % 9 AS int) AS n",
        "cast(2 + s_suppkey % 4 AS int) AS k",
    )
    edges = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('g', cast(l_suppkey AS string)) AS graph",
        "cast(1 + l_orderkey % (12 + l_suppkey % 9) AS int) AS i",
        "cast(1 + l_partkey % (12 + l_suppkey % 9) AS int) AS j",
        "CASE WHEN l_quantity > 49 THEN 1000.0D ELSE l_quantity END AS w",
    )
    return heads, edges


GRAPHS = """
graphs AS (SELECT 'g' || s_suppkey AS graph, (12 + s_suppkey % 9)::INT AS n,
                  (2 + s_suppkey % 4)::INT AS k FROM supplier),
edges AS (SELECT 'g' || l_suppkey AS graph, (1 + l_orderkey % (12 + l_suppkey % 9))::INT AS i,
                 (1 + l_partkey % (12 + l_suppkey % 9))::INT AS j,
                 CASE WHEN l_quantity > 49 THEN 1000.0::DOUBLE ELSE l_quantity END AS w FROM lineitem)
"""
