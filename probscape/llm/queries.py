"""The registered queries of this package, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probscape.llm import oracles
from probscape.llm.conversations import damaged, repairs
from probscape.llm.decontamination import contaminated
from probscape.llm.exact_dedup import exact_dedup
from probscape.llm.html_text import extract
from probscape.llm.line_dedup import fuzzy_lines
from probscape.llm.lm import score_documents
from probscape.llm.merkle import manifest
from probscape.llm.near_dedup import near_duplicates
from probscape.llm.packing import pack
from probscape.llm.personal_data import digest, personal_data
from probscape.llm.quality import quality_scores
from probscape.llm.tokens import token_counts
from probscape.llm.url_reputation import BOUND, TWO_NAMES, WORST, judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_points")


ORACLES["op1_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
"""


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    labels = table(spark, sf_dir, "labels").where(part != 2)
    scored = quality_scores(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", "predicted")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    return score_documents(table(spark, sf_dir, "documents"), part == 1)


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered).drop("source")


ORACLES["op11_merkle_manifest"] = oracles.MERKLE


#: Host, path and verdict; fixed values of the contract.
RULES = "('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


@query
def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {RULES} AS rules (host, path, verdict)"))


def _posterior(groups: str, parents: str, keys: str) -> str:
    """SQL of one step of shrinkage: ``groups`` with the mean and variance of their posterior."""
    return f"""
    (WITH g AS (SELECT * FROM {groups} JOIN (SELECT {keys}, m, v FROM {parents}) AS p USING ({keys})),
          r AS (SELECT coalesce(least(0.999, greatest(0.001, CASE WHEN sum((n - 1) * m * (1 - m)) = 0 THEN 0.999 ELSE
                       (sum((k - n * m) * (k - n * m) / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)) END)), 0.999) AS rho FROM g WHERE n > 0),
          w AS (SELECT g.*, (1 / rho) * m * (1 - m) / (m * (1 - m) + v * (1 / rho - 1)) - 1 AS s FROM g, r),
          q AS (SELECT * REPLACE (0 AS m, 0 AS v), s * m + k AS a, s * (1 - m) + n - k AS b FROM w)
     SELECT * EXCLUDE (m, v, s, a, b), a / (a + b) AS m, a * b / ((a + b) * (a + b) * (a + b + 1)) AS v FROM q)"""


ORACLES["op12_url_reputation"] = f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(split_part(split_part(
                  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '#', 1), '?', 1), '^([^/]*)(.*)$', ['h', 'p'], 's'), {{'h': '', 'p': ''}}) AS x FROM pages),
     page AS (SELECT page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path, row_number() OVER () AS id FROM u),
     rules (rhost, rpath, rverdict) AS (VALUES {RULES}),
     fit AS (SELECT id, arg_min(rhost || rpath, (-length(rhost || rpath), rhost || rpath)) AS rule, arg_min(rverdict, (-length(rhost || rpath), rhost || rpath)) AS rverdict
             FROM page JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id),
     ruled AS (SELECT page.*, rule, rverdict FROM page LEFT JOIN fit USING (id)),
     named AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(rule) AS n, count_if(rverdict IS NOT DISTINCT FROM 'block') AS k FROM ruled GROUP BY host),
     split AS (SELECT host, n, k, bare, string_split(bare, '.') AS s, regexp_matches(bare, '^[0-9.]+$') AS num FROM named),
     two AS (SELECT *, array_to_string(s[-2:], '.') AS two, array_to_string(s[-2:], '.') IN ({", ".join(repr(x) for x in TWO_NAMES)}) AS listed FROM split),
     hosts AS (SELECT host, n, k, CASE WHEN num THEN bare WHEN listed THEN array_to_string(s[-3:], '.') ELSE two END AS domain,
                      CASE WHEN num THEN '' WHEN listed THEN two ELSE s[-1] END AS suffix, 0 AS one FROM two),
     domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain),
     suffixes AS (SELECT suffix, 0 AS one, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
     every AS (SELECT 0 AS one, a / (a + b) AS m, a * b / ((a + b) * (a + b) * (a + b + 1)) AS v FROM (SELECT sum(k) + 0.5::DOUBLE AS a, sum(n) - sum(k) + 0.5::DOUBLE AS b FROM suffixes)),
     top AS {_posterior("suffixes", "every", "one")},
     middle AS {_posterior("domains", "top", "suffix")},
     leaf AS {_posterior("hosts", "middle", "suffix, domain")}
SELECT page_id, ruled.host, path, rule, coalesce(rverdict, CASE WHEN m - {BOUND} * sqrt(v) > {WORST} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN leaf ON ruled.host = leaf.host
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repairs(rows, copies)


ORACLES["op13_conversation_repair"] = oracles.CONVERSATIONS
