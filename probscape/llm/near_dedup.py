"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard (operator 3)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import Stages, bucket_members, by_id, doc_words, link_buckets, mix, text_rows, texts

#: Bands and coordinates a band: a pair with similarity 0.8 meets in some band but for 5 in a million.
BANDS, ROWS = 40, 6

_WORD = np.uint64(0xD6E8FEB86659FD93)
_SIGMA = np.uint64(0xA0761D6478BD642F)
_CELLS = 1 << 15  # array cells worked on at a time, to stay in the processor's cache


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run; none give none."""
    n = len(words)
    if not n:
        return words
    run = min(n, size)
    out = np.zeros(n - run + 1, np.uint64)
    for i in range(run):
        out = out * _WORD + words[i: i + len(out)]
    return np.unique(mix(out + np.uint64(run)))


def circulant_signature(elements: np.ndarray, size: int) -> np.ndarray:
    """All ``size`` coordinates from two permutations of the 2**32 cells.

    The first permutation scatters the elements over the cells; coordinate k is the smallest value
    of the second one, circularly shifted by k, over the scattered elements.
    """
    cells = (mix(elements ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, _CELLS // size)
    for i in range(0, len(cells), step):
        x = cells[None, i: i + step] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    parts = signature.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * _WORD + parts[:, i])
    return key.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands``: two 64-bit fingerprints stand for the whole set."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for block, words, bounds in doc_words(texts(batch)):
                for j, i in enumerate(block):
                    found = shingles(words[bounds[j]: bounds[j + 1]], size)
                    a, b = _print(found)
                    keys = band_keys(circulant_signature(found, bands * rows), bands, rows) if len(found) else np.zeros(0, np.int64)
                    out.append((ids[i], len(found), a, b, keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.int64()) for k in range(4)] + [_lists([r[4] for r in out])],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return by_id(docs).mapInArrow(made, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _print(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a whole set."""
    return tuple(int(mix(found ^ np.uint64(c)).sum().view(np.int64)) if len(found) else 0 for c in (1, 2))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, items``: the whole shingle sets as 64-bit numbers.

    ``wanted`` has ``doc_id, node, set_a, set_b``; of several texts under one id only those with the node's set count.
    """

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            prints = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            nodes, out, sets = batch.column(2).to_pylist(), [], []
            for block, words, bounds in doc_words(texts(batch)):
                for j, i in enumerate(block):
                    found = shingles(words[bounds[j]: bounds[j + 1]], size)
                    if _print(found) == prints[i]:
                        out.append(nodes[i])
                        sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), _lists(sets)], ["node", "items"])

    rows = by_id(docs).join(wanted, "doc_id").select("doc_id", "text", "node", "set_a", "set_b")
    return rows.mapInArrow(made, "node long, items array<long>")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    A document's set holds its distinct runs of ``size`` words (A-Z lower-cased; split at space and
    U+0009 to U+000D). Documents whose sets have ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest ``doc_id`` that links reach, and the document with that id is kept.

    Candidates are documents that share a band of the circulant signature. Equal sets collapse to one
    representative first. In each bucket every representative is compared with one centre, by whole
    sets; where a bucket still holds different components it gets other centres, and in the end an exact
    search by rare shingles joins components, so a large group of near copies costs one comparison for
    each member and bucket and no link between different texts is left out.

    Fewer than ``size`` words are one run. Null and empty texts, and those of white space only, have
    no set and link with nothing. Rows that repeat an id are returned each; each is a text of its own, which
    links by its own set. Rows with a null id link with nothing (``component_id`` null).
    Other columns are not read; an empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "near-duplicates")
    signed = stages.keep(signatures(docs, size, bands, rows))
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    groups = stages.keep(groups.withColumn("node", F.monotonically_increasing_id()))
    members, pairs = bucket_members(stages, groups.select("node", F.explode(F.array_distinct("bands")).alias("key")))
    wanted = groups.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "node", "set_a", "set_b")
    sets = stages.keep(_sets(docs, wanted, size).dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
        both = pairs.join(right, "b").join(left, "a")
        common = F.size(F.array_intersect("left", "right"))
        return stages.keep(both.select("a", "b", (100 * common >= percent * (F.size("left") + F.size("right") - common)).alias("same")))

    found = link_buckets(stages, members, pairs, sets, percent, verified)
    nodes = groups.join(found, "node", "left").select("set_a", "set_b", "n_shingles", "rep", F.coalesce("component", "node").alias("component"))
    roots = stages.keep(nodes.groupBy("component").agg(F.min("rep").alias("root")))
    roots = nodes.join(roots, "component").select("set_a", "set_b", "n_shingles", "root")
    out = signed.drop("bands").join(roots, ["set_a", "set_b", "n_shingles"], "left")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(known, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; columns and texts as they were.

    Rows with a null ``doc_id`` stay. Rows that share an id go together: if each of them is a copy of a document
    with another id."""
    gone = near_duplicates(docs, size, percent).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.max("kept").alias("_kept")).where("NOT _kept")
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
