"""Exact dedup with an extendible-hash index on shared files (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from probscape.llm.common import WHITE, Stages, by_id, text_rows, texts

#: Distinct texts that a bucket of the index should hold at most.
BUCKET_ROWS = 4_000
#: Doublings of the directory at most (2**16 entries, under 1 MB); fuller buckets grow by chaining.
MAX_DEPTH = 16
#: Bytes of text that a map task holds while it combines equal texts.
COMBINE_BYTES = 48 << 20

_KEYS = "doc_id long, key long, digest string, n_points long"
_COPIES = "key long, digest string, norm binary, best_points long, best_id long, n long"
_INDEX = "bucket int, key long, slot int, digest string, keep_id long, keep_points long, group_size long"
_END = 1 << 63


def normal(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _points(batch: pa.RecordBatch) -> list[int]:
    return pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_rows(batches):
        digests = [hashlib.sha256(normal(t)).digest() for t in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(_key, digests), pa.int64()),
             pa.array([d.hex() for d in digests]), pa.array(_points(batch), pa.int64())],
            ["doc_id", "key", "digest", "n_points"])


def _copies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a map task become one row before the shuffle, in bounded memory."""
    seen: dict[bytes, list] = {}
    held = 0

    def flush():
        digests = list(seen)
        rows = list(seen.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(map(_key, digests), pa.int64()), pa.array([d.hex() for d in digests]),
             pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
            ["key", "digest", "norm", "best_points", "best_id", "n"])

    for batch in text_rows(batches):
        for doc, text, points in zip(batch.column(0).to_pylist(), texts(batch), _points(batch)):
            norm = normal(text)
            row = seen.setdefault(hashlib.sha256(norm).digest(), [norm, points, doc, 0])
            row[3] += 1
            if row[3] == 1:
                held += len(norm) + 200
            elif _better(points, doc, row[1], row[2]):
                row[1:3] = points, doc
        if held > COMBINE_BYTES:
            yield flush()
            seen, held = {}, 0
    if seen:
        yield flush()


def _better(points: int, doc: int | None, than: int, than_doc: int | None) -> bool:
    """The longer original stays, then the smaller id; a null id comes last."""
    return (-points, _END if doc is None else doc) < (-than, _END if than_doc is None else than_doc)


def directory(counts: dict[int, int], depth: int, capacity: int = BUCKET_ROWS) -> np.ndarray:
    """The bucket of each ``depth``-bit key prefix.

    Starts with one bucket and an entry-less directory; the fullest bucket over ``capacity``
    is split by its next bit, the directory doubling whenever its local depth passes the global
    one. Entries that share a bucket are the ones that no split has told apart.
    """
    rows = np.zeros(1 << depth, np.int64)
    for prefix, n in counts.items():
        rows[prefix] += n
    below = np.concatenate(([0], np.cumsum(rows)))
    entries, global_depth = np.zeros(1, np.int64), 0
    todo, buckets = [(0, 0, 0)], 1  # bucket, its prefix, its local depth
    while todo:
        bucket, prefix, local = todo.pop()
        span = depth - local
        if local == depth or below[(prefix + 1) << span] - below[prefix << span] <= capacity:
            continue
        if local == global_depth:
            entries, global_depth = np.repeat(entries, 2), global_depth + 1
        step = global_depth - local - 1
        entries[((2 * prefix + 1) << step): ((2 * prefix + 2) << step)] = buckets
        todo += [(bucket, 2 * prefix, local + 1), (buckets, 2 * prefix + 1, local + 1)]
        buckets += 1
    return np.repeat(entries, 1 << (depth - global_depth))


def _owners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner task: rows come by bucket and key; a key's texts form a chain, compared by bytes."""
    key = None
    chain: list[list] = []
    out: list[list] = []
    names = [f.split()[0] for f in _INDEX.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def close():
        for slot, (bucket, digest, _, points, doc, n) in enumerate(chain):
            out.append([bucket, key, slot, digest, doc, points, n])

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for bucket, k, digest, norm, points, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                close()
                key, chain = k, []
            for link in chain:
                if link[2] == norm:
                    link[5] += n
                    if _better(points, doc, link[3], link[4]):
                        link[3:5] = points, doc
                    break
            else:
                if any(link[1] == digest for link in chain):
                    raise ValueError(f"two texts with the digest {digest}")
                chain.append([bucket, digest, norm, points, doc, n])
        if len(out) >= 10_000:
            yield made()
            out.clear()
    close()
    if out:
        yield made()


def build_index(stages: Stages, docs: DataFrame, capacity: int = BUCKET_ROWS) -> DataFrame:
    """Write the index: a row for each distinct normalised text, in files by bucket.

    Map tasks combine equal texts first, so a text that a third of all rows share reaches its
    owner once for each task. The directory comes from counts by key prefix (at most 2**16 rows).
    """
    spark = docs.sparkSession
    copies = by_id(docs).mapInArrow(_copies, _COPIES)
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    keys = stages.keep(by_id(docs).mapInArrow(_keys, _KEYS))
    counts = keys.groupBy("key").agg(F.lit(1)).groupBy(prefix.alias("p")).count()
    buckets = directory({r[0]: r[1] for r in counts.collect()}, MAX_DEPTH, capacity)
    table = spark.createDataFrame(list(enumerate(buckets.tolist())), "p int, bucket int")
    owned = copies.withColumn("p", prefix).join(F.broadcast(table), "p")
    owned = owned.select("bucket", "key", "digest", "norm", "best_points", "best_id", "n")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(buckets.max()) + 1)
    index = owned.repartitionById(owners, F.col("bucket")).sortWithinPartitions("bucket", "key").mapInArrow(_owners, _INDEX)
    index = stages.keep(index)
    index._keys = keys
    return index


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_points`` of every row of ``docs``.

    Texts are equal when their bytes are, white space (space and U+0009 to U+000D) left out. Of
    equal texts the one with the most code points stays, then the smallest ``doc_id``.

    Null and empty texts are one group of empty texts. A null ``doc_id`` ranks last and may stay
    (``keep_id`` null). Rows that repeat a ``doc_id`` count each; if that id stays, all its rows of the
    same length are kept. Other columns are not read; an empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "exact-dedup")
    index = build_index(stages, docs, capacity)
    groups = index.select(F.col("digest").alias("text_sha256"), "keep_id", "keep_points", "group_size")
    rows = index._keys.withColumnRenamed("digest", "text_sha256").join(groups, "text_sha256", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_points")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that a copy stands for; columns and texts as they were.

    A row stays by its id, normalised text and length, so that texts under one id are told apart; rows equal in all
    three stay together. Nulls as in ``exact_dedup``."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_points").alias("_n")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(F.translate(text, WHITE.decode(), ""), 256)
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (sha == F.col("_sha")) & (F.char_length(text) == F.col("_n"))
    return docs.join(kept, same, "left_semi")
