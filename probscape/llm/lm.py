"""Document log-likelihood by a gated recurrent language model (operator 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.llm import gru
from probscape.llm.common import Stages, mix, text_blocks, text_rows, texts, word_hashes

#: Words whose counts go to every task (16 bytes each); the others' counts come by a join.
KNOWN = 1 << 18
#: Tokens of the runs that training documents are cut into, one behind the other; rounds, each over other runs.
RUN = 1024
ROUNDS = 3
RATES = (0.02, 0.01, 0.005)
#: Tokens of a round that train one copy of the model. The copies follow from the data, not from the cluster.
COPY_TOKENS = 4_000_000
#: Models that one task averages at a time.
FAN = 16
#: Words that a task counts before it hands its counts on.
COUNT_ROWS = 1 << 21

#: The token at the end of every document.
END = np.uint64(0x5EED5EED5EED5EED)
_LOG10 = np.log(10.0)


#: Tail classes by last byte, the byte before it and whether a word has bytes beyond ASCII.
_TAIL = (mix(np.arange(1 << 17, dtype=np.uint64)) % np.uint64(gru.TAILS)).astype(np.int32)


def tokens(rows: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: their indexes, hashes and tail classes of all their tokens, and bounds.

    A word's tail class follows from its last two bytes and from whether it is pure ASCII, so it
    tells something of language and form without any table.
    """
    for block, data, ends in text_blocks(rows):
        hashes, start, end = word_hashes(data)
        raw = np.frombuffer(data, np.uint8)
        wide = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(raw >= 128, out=wide[1:])
        last = raw[end - 1].astype(np.int32) if len(end) else np.zeros(0, np.int32)
        second = np.where(end - start > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.int32) if len(end) else last
        tail = _TAIL[last * 512 + second * 2 + (wide[end] > wide[start])]
        cuts = np.searchsorted(start, ends)
        # the end token is put in behind the words of each text
        hashes = np.insert(hashes, cuts, END)
        tail = np.insert(tail, cuts, 0)
        yield block, hashes, tail, np.concatenate(([0], cuts + np.arange(1, len(cuts) + 1)))


def _tally(hashes: np.ndarray, tail: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their tail classes and how often they occur (or the sums of ``c``)."""
    order = np.argsort(hashes)
    found = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    times = np.diff(first, append=len(found)) if c is None else np.add.reduceat(c[order], first)
    return found[first], tail[order[first]], times.astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by word of a task's training texts, combined before the shuffle."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        return _tally(*(np.concatenate(x) for x in zip(*held)))

    def made(parts):
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[0].view(np.int64)), pa.array(parts[1].astype(np.int32)), pa.array(parts[2])], ["word", "tail", "c"])

    for batch in text_rows(batches):
        for _, hashes, tail, _ in tokens(texts(batch)):
            held.append(_tally(hashes, tail))
        if sum(len(x[0]) for x in held) > COUNT_ROWS:
            parts = merged()
            held = [parts]
            if len(parts[0]) > COUNT_ROWS // 2:
                yield made(parts)
                held = []
    if held:
        yield made(merged())


class _Vocabulary:
    """Known words, sorted by hash, with their counts and the ids of the most frequent ones."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        rank = np.lexsort((words, -counts))
        ids = np.full(len(words), -1, np.int32)
        ids[rank[: gru.HEAD]] = np.arange(min(gru.HEAD, len(words)))
        order = np.argsort(words)
        self.words, self.counts, self.ids = words[order], counts[order], ids[order]
        # where the words of each leading bits begin; about one word in four leading bits, so few begin together
        self.shift = np.uint64(64 - max(1, len(words).bit_length() + 2))
        heads = (self.words >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(heads, np.arange((1 << int(64 - int(self.shift))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begin).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions among the known words; -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = self.begin[hashes >> self.shift]
        out = np.where(self.words[np.minimum(at, len(self.words) - 1)] == hashes, at, -1)
        rest = np.flatnonzero(out < 0)
        for k in range(1, self.most):
            later = np.minimum(at[rest] + k, len(self.words) - 1)
            hit = self.words[later] == hashes[rest]
            out[rest[hit]] = later[hit]
            rest = rest[~hit & (later < self.begin[(hashes[rest] >> self.shift) + np.uint64(1)] - 1)]
            if not len(rest):
                break
        return out

    def model_ids(self, at: np.ndarray, tail: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.ids[at], -1) if len(self.ids) else np.full(len(at), -1)
        return np.where(own >= 0, own, gru.HEAD + tail).astype(np.int32)


def _runs(vocabulary, size: int):
    """Each text in consecutive runs of ``size`` tokens, the last one shorter. A run has a place of its
    own, so that a long text, or a source of them, spreads over rounds and tasks."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in text_rows(batches):
            docs = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out, places = [], []
            for block, hashes, tail, bounds in tokens(texts(batch)):
                ids = v.model_ids(v.find(hashes), tail).astype(np.int16)
                for j, i in enumerate(block):
                    a, b = bounds[j], bounds[j + 1]
                    begins = range(a, b, size)
                    out += [ids[k: min(b, k + size)].tobytes() for k in begins]
                    places.append(mix(mix(docs[i: i + 1] + hashes[a:b].sum()) + np.arange(len(begins), dtype=np.uint64)))
            place = np.concatenate(places)
            turn = (place % np.uint64(ROUNDS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(turn), pa.array(place.view(np.int64))], ["ids", "turn", "place"])

    return made


_MODEL = "g int, w binary, n long"


def _model(g: int, flat: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([flat.astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "w", "n"])


def _trainer(weights, rate: float):
    """A task trains its own copy of the model on its runs."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[bytes] = []
        for batch in batches:
            if batch.num_rows:
                g = batch.column(0)[0].as_py()
                rows += batch.column(1).to_pylist()
        if not rows:
            return
        rows.sort(key=lambda x: (len(x), x))
        w, n = gru.train(weights.value, [np.frombuffer(x, np.int16) for x in rows], rate)
        yield _model(g, gru.pack(w), n)

    return made


def _mean(models: Iterable[tuple[bytes, int]]) -> tuple[np.ndarray, int]:
    total, count = None, 0
    for w, n in models:
        x = np.frombuffer(w, "<f4").astype(np.float64) * n
        total, count = x if total is None else total + x, count + n
    return total / count, count


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]  # at most FAN models of fixed size
    if rows:
        yield _model(rows[0][0] // FAN, *_mean((w, n) for _, w, n in rows))


def train_model(stages: Stages, runs: DataFrame, weights: gru.Weights, tokens: int) -> gru.Weights:
    """Rounds of local training and averaging, weighted by tokens; models are averaged in a tree.

    Runs are dealt to copies by the hash of their place, a copy sorts its own, and averages are taken in the copies'
    order: the model follows from the texts and their ids.
    """
    sc = stages.spark.sparkContext
    copies = max(1, -(-tokens // (ROUNDS * COPY_TOKENS)))
    for turn in range(ROUNDS):
        sent = sc.broadcast(weights)
        own = runs.where(F.col("turn") == turn).select(F.pmod(F.shiftright("place", 8), F.lit(copies)).cast("int").alias("g"), "ids")
        models = stages.keep(own.repartitionById(copies, F.col("g")).mapInArrow(_trainer(sent, RATES[turn]), _MODEL))
        left = copies
        while left > FAN:
            left = -(-left // FAN)
            nearby = models.repartitionById(left, F.expr(f"g DIV {FAN}").cast("int")).sortWithinPartitions("g")
            models = stages.keep(nearby.mapInArrow(_average, _MODEL))
        rows = models.orderBy("g").collect()  # at most FAN models of fixed size
        if rows:
            weights = gru.unpack(_mean((r["w"], r["n"]) for r in rows)[0], weights)
    return weights


def _scorer(vocabulary, weights, mass, log_n: float):
    """Model and base scores of each text; words with unknown counts are left to the join."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, masses = vocabulary.value, weights.value, mass.value
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        logs, log_masses = np.log10(v.counts + 0.5), np.log10(masses)
        for batch in text_rows(batches, 16 << 20):
            ids, held, size = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.num_rows
            n, known, base, extra = (np.zeros(size, t) for t in (np.int64, np.int64, float, float))
            docs: list = [None] * size
            rest: list = [None] * size
            for block, hashes, tail, bounds in tokens(texts(batch)):
                at = v.find(hashes)
                model = v.model_ids(at, tail)
                seen = at >= 0
                log_c = np.where(seen, logs[at], 0.0) if len(logs) else np.zeros(len(at))
                own = np.repeat(np.arange(len(block)), np.diff(bounds))
                within = np.where(model >= gru.HEAD, log_c - log_masses[np.maximum(model - gru.HEAD, 0)], 0.0)
                for out, value in ((n, np.ones(len(at))), (known, seen), (base, log_c - log_n), (extra, within)):
                    out[block] = np.bincount(own, value, len(block))
                for j, i in enumerate(block):
                    part = slice(bounds[j], bounds[j + 1])
                    docs[i] = model[part]
                    rest[i] = np.unique(hashes[part][~seen[part]], return_counts=True)
            score = gru.score_documents(w, docs) / _LOG10 + extra
            columns = [ids, held, n, known, base, score, [r[0].view(np.int64) for r in rest], [r[1].astype(np.int32) for r in rest]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return made


def _frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The words with at least a certain count, at most ``most`` (``KNOWN``) of them.

    The count comes from a histogram with 32 classes to each doubling, so no task sorts words.
    """
    most = KNOWN if most is None else most
    level = F.floor(F.log2("c") * 32).cast("int")
    total, least = 0, None
    for k, n in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = k
    if least is None and total:  # the commonest class alone has too many: those with the smallest hashes
        return counts.where(level == k).orderBy("word").limit(most)
    return counts.where(level >= (1 << 30 if least is None else least))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The model learns from the rows where ``held_out`` is false (or null): counts of all their words, and
    for the recurrent net all their tokens, in runs of ``RUN``, each once. Tokens are words (A-Z lower-cased) and one end
    token. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens; ``score``
    is the model's log10 probability of the whole text.

    The net reads every token, and predicts a class of words and, in the classes of the most frequent
    words, the word. A word of any other class has the share (c + 0.5) of its class, in which words
    never met are one type with count 0.

    Null and empty texts are an end token. Repeated rows and null ids are scored like any other row;
    other columns are not read. Without training rows the model is uniform over its classes; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    stages = Stages(spark, "language-model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learnt = rows.where("NOT held_out")

    counts = learnt.mapInArrow(_count, "word long, tail int, c long").groupBy("word").agg(F.sum("c").alias("c"), F.min("tail").alias("tail"))
    counts = stages.keep(counts)
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(totals[0]), int(totals[1])
    top = _frequent(counts).toArrow()
    words, c, tail = (top[x].to_numpy() for x in ("word", "c", "tail"))
    vocabulary = _Vocabulary(words.view(np.uint64), c)
    head_mass = np.zeros(gru.HEAD)
    head_mass[: min(gru.HEAD, len(c))] = np.sort(c)[::-1][: gru.HEAD]
    mass = np.full(gru.TAILS, 0.5)  # the words never met
    for k, m in counts.groupBy("tail").agg(F.sum(F.col("c") + 0.5)).collect():
        mass[k] += m
    frequent = np.lexsort((words.view(np.uint64), -c))[: gru.HEAD]
    np.subtract.at(mass, tail[frequent], c[frequent] + 0.5)
    weights = gru.start_weights(head_mass, mass)

    known = sc.broadcast(vocabulary)
    runs = learnt.select("doc_id", "text").mapInArrow(_runs(known, RUN), "ids binary, turn int, place long")
    runs = stages.keep(runs)
    weights = train_model(stages, runs, weights, n)
    stages.drop(runs)

    log_n = float(np.log10(n + 0.5 * (v + 1)))
    scored = rows.mapInArrow(
        _scorer(known, sc.broadcast(weights), sc.broadcast(mass), log_n),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>")
    scored = stages.keep(scored.withColumn("row", F.monotonically_increasing_id()))

    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "word", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * log_c).alias("log_c"))
    out = scored.drop("words", "times").join(rest, "row", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"), (F.col("score") + log_c).alias("score"))
