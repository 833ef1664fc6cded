"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes documents (``doc_id, text`` and any other columns, which it hands on as they are) and handles odd
rows in the same way: a null text counts as an empty one; a null ``doc_id`` is a row like any other, except that near
dedup, whose links are between ids, leaves it; rows that repeat an id are texts of their own, but go together in near dedup;
an empty table gives an empty one. Columns of other tables never meet those of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probscape.llm.common import Stages
from probscape.llm.decontamination import clean
from probscape.llm.exact_dedup import drop_copies
from probscape.llm.near_dedup import drop_near_copies
from probscape.llm.packing import pack
from probscape.llm.quality import keep_good
from probscape.llm.queries import table, tokenizer_path

#: Units of text that a packing task remembers: executors still hold the memory of the stages before.
REMEMBERED = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go; without labels of both kinds all stay. Empty texts are scored too."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; empty texts are one group. Rows equal in id and text stay together."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8); texts without words all stay."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences; an empty text is its end token."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), most=REMEMBERED)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: SQL expresses neither the classifier nor the near duplicates; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again by the next."""
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
