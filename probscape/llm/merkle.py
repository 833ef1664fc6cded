"""Merkle dataset manifest: leaves, subroots by source, one root, and a witness for every row.

The tree of a source has sixteen children a node. Its rows get their places by sorted ranges, and every
aligned block of 16 ** HEIGHT of them is appended as a stream: a node that waits for its siblings is an open
subtree, which holds the rows below it; when the run of its siblings is complete, the witness of each subtree
is extended by the others, and the parent is appended one level up. The roots of blocks are further appends,
in blocks of their own, and so are the subroots of sources. On the way down, every block hands the witness
above it to its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import Stages
from probscape.llm.ranks import ranked

#: Children of a node.
ARITY = 16
#: Levels of a block: a task holds ARITY ** HEIGHT nodes at a time.
HEIGHT = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(name: str, text: bool):
    value = F.col(name) if text else F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: str = "text"):
    """The leaf of a row (hex): every field by its length and value, null as ``-``."""
    return F.sha2(F.concat(_field("doc_id", False), _field("source", True), _field("lang", True), _field("n_chars", False), _field(text, True)), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``source, doc_id, leaf, changed``: the leaf of every row, and the one after tampering (null without)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("lower", F.when(F.coalesce(tampered, F.lit(False)), F.translate("text", _UPPER, _LOWER)))
    touched = F.when(F.col("lower").isNotNull(), leaf_digest("lower"))
    return rows.select("source", "doc_id", F.unhex(leaf_digest()).alias("leaf"), F.unhex(touched).alias("changed"))


def digest(parts: Iterable[bytes]) -> bytes:
    """H: hex sha256 of digests put together as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Appender:
    """Appends nodes of one block in order; witnesses grow as siblings complete.

    ``witness[i]`` is what node ``i`` has so far: for each level (left siblings, right siblings). Nodes of
    one subtree share the entries of the levels above it.
    """

    def __init__(self, height: int):
        self.height = height
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height + 1)]
        self.witness: list[list[tuple[bytes, bytes]]] = []

    def append(self, node: bytes) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, node, at, at + 1)

    def _add(self, level: int, node: bytes, start: int, stop: int) -> None:
        run = self.open[level]
        run.append((node, start, stop))
        if len(run) == ARITY and level < self.height:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _, _ in run]
        for k, (_, start, stop) in enumerate(run):
            step = (b"".join(nodes[:k]), b"".join(nodes[k + 1:]))
            for i in range(start, stop):
                self.witness[i].append(step)
        self._add(level + 1, digest(nodes), run[0][1], run[-1][2])

    def close(self) -> bytes:
        """Complete the last, shorter runs of all levels; the block's root."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def grown(nodes: list[bytes], n: int, height: int) -> Appender:
    """A block with all its appends: it holds ``nodes``, of a tree with ``n`` nodes on this level."""
    levels, left = 0, n
    while left > 1 and levels < height:
        levels, left = levels + 1, -(-left // ARITY)
    block = Appender(levels)
    for node in nodes:
        block.append(node)
    return block


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Block by block: a row holds up to ``ARITY ** height`` nodes."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, row.to_pylist()[0]


def _hex(nodes: list[bytes]) -> list[bytes]:
    return [x.hex().encode() for x in nodes]


def _roots(height: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            root = bytes.fromhex(grown(_hex(row["nodes"]), row["n"], height).close().decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([root], pa.binary())], [*batch.schema.names, "root"])

    return run


def blocks(stages: Stages, level: DataFrame, height: int, *payload: str) -> DataFrame:
    """One row for each aligned block of ``ARITY ** height`` nodes (``tree, pos, n, node`` and ``payload``): ``tree, block, n``, its
    nodes in order, their payload in the same order, and its root."""
    member = F.struct("pos", "node", *payload)
    packed = level.groupBy("tree", F.expr(f"pos DIV {ARITY**height}").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("m"))
    packed = packed.select("tree", "block", "n", *(F.col(f"m.{c}").alias(a) for c, a in [("node", "nodes"), *((c, c) for c in payload)]))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields)
    return stages.keep(packed.mapInArrow(_roots(height), f"{types}, root binary"))


def forest(stages: Stages, level: DataFrame, height: int, *payload: str) -> list[DataFrame]:
    """The blocks of all levels, the lowest first; in the last one every tree has a single block."""
    size = ARITY**height
    built = [blocks(stages, level, height, *payload)]
    while built[-1].where(f"n > {size}").take(1):
        count = F.expr(f"(n + {size - 1}) DIV {size}").alias("n")
        above = built[-1].where(f"n > {size}").select("tree", F.col("block").alias("pos"), count, F.col("root").alias("node"))
        built.append(blocks(stages, above, height))
    return built


_PATH = "array<struct<l: binary, r: binary>>"


def _handed(height: int):
    """``tree, pos, above`` of the members of blocks."""
    kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _each(batches):
            block = grown(_hex(row["nodes"]), row["n"], height)
            block.close()
            first = row["block"] * ARITY**height
            for k in range(0, len(block.witness), 256):
                part = [[{"l": a, "r": b} for a, b in steps] + (row["above"] or []) for steps in block.witness[k: k + 256]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["tree"]] * len(part), batch.schema.field("tree").type), pa.array(range(first + k, first + k + len(part)), pa.int64()),
                    pa.array(part, kind)], ["tree", "pos", "above"])

    return run


def handed_down(stages: Stages, built: list[DataFrame], height: int, tops: DataFrame | None) -> DataFrame:
    """``tree, block, above`` of the lowest blocks: the witness above each; ``tops`` (``tree, above``) continues
    the witness above the trees' roots."""
    above = None
    for k in range(len(built) - 1, 0, -1):
        members = with_above(built[k], above, tops).mapInArrow(_handed(height), f"tree string, pos long, above {_PATH}")
        above = stages.keep(members.withColumnRenamed("pos", "block"))
    return with_above(built[0], above, tops)


def with_above(level: DataFrame, above: DataFrame | None, tops: DataFrame | None) -> DataFrame:
    """Blocks with the witness above them: from the level above for a tree of several blocks, else from ``tops``."""
    same = F.col("tree").eqNullSafe(F.col("_t"))
    out = level.withColumn("above", F.lit(None).cast(_PATH))
    if tops is not None:
        out = level.join(tops.select(F.col("tree").alias("_t"), "above"), same, "left").drop("_t")
    if above is not None:
        upper = above.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), F.col("above").alias("_up"))
        out = out.join(upper, same & (F.col("block") == F.col("_b")), "left").withColumn("above", F.coalesce("_up", "above")).drop("_t", "_b", "_up")
    return out


def folded(node: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that ``node`` and a witness give."""
    for left, right in path:
        node = digest((left, node, right))
    return node


def _rows(height: int):
    """The manifest's rows of one block after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row in _each(batches):
            nodes = _hex(row["nodes"])
            block = grown(nodes, row["n"], height)
            block.close()
            path = [(s["l"], s["r"]) for s in row["above"] or []]
            tail = b"".join(left + right for left, right in path)
            ups: dict[bytes, bytes] = {}
            proofs, roots = [], []
            for node, changed, steps in zip(nodes, row["changed"], block.witness, strict=True):
                proofs.append(digest([*(left + right for left, right in steps), tail]).decode())
                top = folded(node if changed is None else changed.hex().encode(), steps)
                if top not in ups:
                    ups[top] = folded(top, path)
                roots.append(ups[top].decode())
            subroot, root = row["subroot"].hex(), row["root"].hex()
            size = len(nodes)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["tree"]] * size, pa.string()), pa.array(row["doc_id"], pa.int64()), pa.array([x.decode() for x in nodes]),
                pa.array([subroot] * size), pa.array([root] * size), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])],
                ["source", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """``source, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``
    (``doc_id, source, lang, n_chars, text``; other columns are not read).

    ``tampered`` is a condition; the texts of such rows are folded with A-Z lower-cased. Null fields count as
    ``-``; a null source is a source; repeated ids of a source stand in the order of their leaves, equal rows
    side by side. An empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "merkle")
    lined = ranked(stages, leaves(docs, tampered), "source", "doc_id", "leaf", "changed")
    trees = forest(stages, lined.select(F.col("source").alias("tree"), "pos", "n", F.col("leaf").alias("node"), "doc_id", "changed"), height, "doc_id", "changed")
    single = [level.where(f"n <= {ARITY**height}").select("tree", "root") for level in trees]
    tops = reduce(DataFrame.unionAll, single)
    tops = stages.keep(tops.select(F.col("tree").alias("source"), F.col("root").alias("subroot")))
    sources = ranked(stages, tops.withColumn("all", F.lit("")), "all", "source")
    crown = forest(stages, sources.select(F.col("all").alias("tree"), "pos", "n", F.col("subroot").alias("node"), "source"), height, "source")
    root = crown[-1].where("block = 0").first()
    root = F.lit(bytes(root["root"]) if root else b"")
    lowest = handed_down(stages, crown, height, None)
    named = lowest.select("tree", F.posexplode("source").alias("k", "source"), "block").select(F.expr(f"block * {ARITY**height} + k").alias("pos"), F.col("source").alias("named"))
    paths = lowest.mapInArrow(_handed(height), f"tree string, pos long, above {_PATH}").join(named, "pos").select(F.col("named").alias("tree"), "above")
    tops = tops.select(F.col("source").alias("_s"), "subroot")
    below = handed_down(stages, trees, height, stages.keep(paths)).drop("root")
    whole = below.join(tops, F.col("tree").eqNullSafe(F.col("_s"))).select("tree", "block", "n", "nodes", "doc_id", "changed", "above", "subroot", root.alias("root"))
    return whole.mapInArrow(
        _rows(height), "source string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
