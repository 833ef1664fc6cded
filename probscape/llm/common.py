"""Helpers of the operators in this package: shared stages, whole-text access, word hashes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of all contracts, as bytes.
WHITE = b"\t\n\x0b\x0c\r "

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a session that runs in one process (``local[...]``) may do without the setting; it gets
    a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    app = sc.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


#: Spark's setting by which a query's shuffle files are deleted when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        """``tidy``: shuffle files go as soon as a stage is written, not when the driver collects its garbage."""
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(TIDY, before) if before else self.spark.conf.unset(TIDY)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stage that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts (column 1) hold at most about ``most`` bytes; whole rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= most:
            yield batch
            continue
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts (column 1) in UTF-8; null is empty."""
    return pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist()


def by_id(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others never clash or reach Python."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


# --- word hashes -----------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space)."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    np.logical_or(raw - np.uint8(9) <= 4, raw == 32, out=gap[1:-1])  # U+0009 to U+000D and space
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` as they stand, where they start and where they end.

    A polynomial hash with random byte values, taken from one running sum over the bytes.
    """
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = word_spans(data)
    size = 1 << max(16, int(len(data) - 1).bit_length())
    up, down = _powers(size)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def text_blocks(rows: list[bytes]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Many texts in blocks: their indexes, the texts (A-Z lower-cased) line by line, and their ends."""
    block: list[int] = []
    size = 0

    def done():
        return block, b"\n".join(rows[i] for i in block).lower(), np.cumsum([len(rows[i]) + 1 for i in block])

    for i, row in enumerate(rows):
        block.append(i)
        size += len(row) + 1
        if size >= 1 << 18:
            yield done()
            block, size = [], 0
    if block:
        yield done()


def doc_words(rows: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Word hashes (A-Z lower-cased) of many texts, in blocks: indexes of the texts, all their
    hashes, and the bounds of each text's hashes."""
    for block, data, ends in text_blocks(rows):
        hashes, start, _ = word_hashes(data)
        yield block, hashes, np.concatenate(([0], np.searchsorted(start, ends)))


# --- connected components --------------------------------------------------------------------


def components(stages: Stages, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node with a link; the component is its smallest node.

    Alternating large-star and small-star steps over a table of links (a distributed union-find):
    each hooks neighbours onto the smallest node near by, until every node hangs on its root.
    Minima are aggregated before the shuffle, so a hub of any degree is spread over the tasks.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stages.keep(links.where(F.col(a) != F.col(b)).select(big, small).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stages.keep(hooked.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        stages.drop(edges)
        edges = after
        if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").take(1):
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(roots)



#: Rounds of new centres before the components that still share buckets are joined by rare elements.
STAR_ROUNDS = 2


def bucket_members(stages: Stages, exploded: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """``key, node, centre`` of the buckets (rows ``node, key``) with several nodes, and the pairs
    ``a, b`` of centres and other members. The centre is the bucket's smallest node.

    ``once`` shuffles the rows once for both steps, where disk is scarcer than time; otherwise counts
    are combined before their shuffle and Spark can split a bucket that is large.
    """
    exploded = exploded.repartition("key") if once else exploded
    shared = exploded.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = stages.keep(exploded.join(shared.select("key", "centre"), "key"))
    pairs = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    return members, stages.keep(pairs.distinct())


#: Parts of the items that a rare search in slices takes one after another.
SLICES = 4
#: Items before one in a node's order that say whether a pair has met at one of them already: there both have more left.
RARER = 4


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int, once: bool = False, stages: Stages | None = None) -> DataFrame:
    """Pairs ``a, b`` of different components that may reach ``percent`` of similarity; exact.

    ``nodes`` has ``node, component`` and ``sets`` has ``node, items``. With its elements in one order, the
    rarest first, a set shares an element of its first (100 - percent) in 100 with every set that is
    similar enough; at the first one shared, both have enough elements left. Elements of one component only come before all
    others: no pair looked for shares them, so the others alone are ordered, from the end. Copies of a common passage
    with words of their own begin with those, and never meet. ``once`` as in ``bucket_members``.

    ``items`` may be hashes of any width, one for each different element: elements with one hash only add pairs.
    With ``stages`` a slice of all items at a time is shuffled and what components share of it is written, so that the
    shuffle of all elements never is on disk as a whole.
    """
    if stages:
        return _rare_pairs_by_slices(nodes, sets, percent, stages)
    every = nodes.join(sets, "node").select("node", "component", F.explode("items").alias("item"))
    every = every.repartition("item") if once else every
    ends = (f(c).alias(f"{name}_{c}") for c in ("node", "component") for f, name in ((F.min, "least"), (F.max, "most")))
    often = every.groupBy("item").agg(F.count("*").alias("often"), *ends)
    often = often.where("least_node < most_node AND least_component < most_component").select("item", "often")
    order = Window.partitionBy("node").orderBy(F.desc("often"), F.desc("item"))
    placed = every.join(often, "item").withColumn("left", F.row_number().over(order)).drop("often")
    first = placed.join(sets.select("node", F.size("items").alias("n")), "node").where(f"left >= ({percent} * n + 99) DIV 100")
    return _met(first, percent)


def _met(first: DataFrame, percent: int, also: str = "true", *more: str) -> DataFrame:
    """Pairs of ``first`` (``item, node, component, n, left`` and ``more``) that share an item and may be similar enough."""
    one, two = (first.select("item", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "left", *more))) for x in "ab")
    met = one.join(two, "item").where(
        f"node_a < node_b AND component_a != component_b AND {percent} * greatest(n_a, n_b) <= 100 * least(n_a, n_b) "
        f"AND ({100 + percent}) * least(left_a, left_b) >= {percent} * (n_a + n_b) AND {also}")
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _rare_pairs_by_slices(nodes: DataFrame, sets: DataFrame, percent: int, stages: Stages) -> DataFrame:
    every = stages.keep(nodes.join(sets, "node").select("node", "component", F.size("items").alias("n"), "items"))
    alike = Window.partitionBy("item")
    shared = []
    for k in range(SLICES):
        rows = every.select("node", "component", F.explode("items").alias("item")).where(F.pmod("item", F.lit(SLICES)) == k).repartition("item")
        rows = rows.select("node", "item", F.count("*").over(alike).alias("often"), *(f("component").over(alike).alias(f.__name__) for f in (F.min, F.max)))
        shared.append(stages.keep(rows.where("min < max").select("node", "item", "often")))
    sizes = stages.keep(every.drop("items"))
    stages.drop(every)
    order = Window.partitionBy("node").orderBy(F.desc("often"), F.desc("item"))
    rarer = F.array(*(F.lead("item", k).over(order) for k in range(1, RARER + 1)))
    placed = functools.reduce(DataFrame.unionAll, shared).select("node", "item", F.row_number().over(order).alias("left"), rarer.alias("rarer"))
    first = stages.keep(placed.join(sizes, "node").where(f"left >= ({percent} * n + 99) DIV 100"))
    for part in (*shared, sizes):
        stages.drop(part)
    return _met(first, percent, "NOT coalesce(arrays_overlap(rarer_a, rarer_b), false)", "rarer")


def link_buckets(
    stages: Stages, members: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, verified: Callable[[DataFrame], DataFrame], once: bool = False
) -> DataFrame:
    """``node, component`` of all nodes that links join; a link is a verified pair.

    ``verified`` takes pairs ``a, b`` and returns ``a, b, same``. First every member is compared with
    its bucket's centre. Where a bucket still holds several components, its members are compared
    with a centre drawn anew, ``STAR_ROUNDS`` times; the nodes of buckets that hold several even then
    are searched by ``rare_pairs``. Pairs within a component need no comparison, so a bucket of many
    copies costs one for each.
    """
    tested = verified(pairs)
    found = stages.keep(components(stages, tested.where("same").select("a", "b")))
    for turn in range(1, STAR_ROUNDS + 2):
        known = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
        rest = stages.keep(known.join(mixed, "key"))
        if turn <= STAR_ROUNDS:
            drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("c"), F.col("component").alias("k")))
            picks = rest.groupBy("key").agg(drawn.alias("pick"))
            more = rest.join(picks, "key").where("component != pick.k").select(F.least("pick.c", "node").alias("a"), F.greatest("pick.c", "node").alias("b"))
        else:
            more = rare_pairs(rest.select("node", "component").distinct(), sets, percent, once, stages if once else None)
        more = stages.keep(more.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        if not more.take(1):
            continue
        fresh = verified(more)
        tested = tested.unionAll(fresh)
        if fresh.where("same").take(1):
            found = stages.keep(components(stages, tested.where("same").select("a", "b")))
    return found
