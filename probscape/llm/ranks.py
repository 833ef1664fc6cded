"""Places of rows within their groups, however large a group is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probscape.llm.common import Stages


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in sorted ranges of ``keys``; the ranges cut groups, and even rows that are equal, anywhere."""
    salt = df.withColumn("_salt", F.rand(11))
    return salt.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt")


def _numbered(at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at).dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            first = groups.dictionary[codes[0]].as_py()
            if first == last and count:
                place[: starts[1] if len(starts) > 1 else None] += count
            last, count = groups.dictionary[codes[-1]].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "_at"])

    return run


def ranked(stages: Stages, df: DataFrame, group: str, *keys: str) -> DataFrame:
    """``df`` with ``pos`` (from 0, within ``group`` in the order of ``keys``, nulls first) and ``n`` (the group's rows).

    Rows are numbered range by range; what lies before a range is one count for each group in it. Null is a
    group of its own. Equal rows are told apart arbitrarily.
    """
    lined = in_order(df, group, *keys)
    schema = T.StructType([*lined.schema.fields, T.StructField("_at", T.LongType())])
    lined = lined.mapInArrow(_numbered(df.columns.index(group)), schema)
    lined = stages.keep(lined.withColumn("_part", F.spark_partition_id()))
    counts = lined.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")
    counts = counts.select("_g", "_p", (F.sum("_n").over(whole.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    placed = lined.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.select(*df.columns, (F.col("_at") + F.col("_before")).alias("pos"), "n")
