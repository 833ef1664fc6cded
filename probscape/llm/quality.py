"""Quality scores by Bradley-Terry ranking of preference pairs (operator 6)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.common import cut
from probscape.functions.order_stats import select_ranks
from probscape.llm.common import by_id, doc_words, text_rows, texts, word_spans

#: Rows of the rarer label that meet in a bucket, about, and rows of the other label in a part of one.
BUCKET_ROWS, PART_ROWS = 32, 4096
#: Labelled rows of a task, about.
TASK_ROWS = 50_000
#: The score at which a document counts as good.
PASS = 0.7
#: Words in a window whose worst value stands for local junk.
WINDOW = 24

_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, _PIPE, _STOP = range(7)
_KINDS = np.zeros((7, 256), np.int32)
_KINDS[_UPPER, 65:91] = 1
_KINDS[_LETTER, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[_DIGIT, 48:58] = 1
_KINDS[_SYMBOL, list(b"#$%&*+/<=>@[\\]^_`{}~")] = 1
_KINDS[_MARK, list(b"!?")] = 1
_KINDS[_PIPE, list(b"|")] = 1
_KINDS[_STOP, list(b".,;:")] = 1

SHARES = 16
FEATURES = 2 * SHARES + 1


def _worst(flags: np.ndarray) -> float:
    """The largest share of flagged words in a window."""
    if len(flags) <= WINDOW:
        return float(flags.mean())
    run = np.concatenate(([0.0], np.cumsum(flags)))
    return float((run[WINDOW:] - run[:-WINDOW]).max() / WINDOW)


def features(text: bytes, words: np.ndarray) -> np.ndarray:
    """Shares that tell prose from junk, their logarithms, and the length; zeros for a text without words."""
    out = np.zeros(FEATURES)
    n = len(words)
    if not n:
        return out
    data = np.frombuffer(text, np.uint8)
    start, end = word_spans(text)
    run = np.zeros((7, len(data) + 1), np.int32)
    np.cumsum(_KINDS[:, data], axis=1, out=run[:, 1:])
    each = run[:, end] - run[:, start]
    total = np.maximum(each.sum(axis=1), 0)
    size = (end - start).sum()
    letters = max(1, int(total[_LETTER]))
    _, counts = np.unique(words, return_counts=True)
    pairs = np.unique(words[1:] * np.uint64(3) + words[:-1]) if n > 1 else words
    same = words[1:] == words[:-1]
    capital = (each[_UPPER] > 1) & (2 * each[_UPPER] > each[_LETTER])
    symbol, pipe = each[_SYMBOL] > 0, each[_PIPE] > 0
    shares = [
        total[_UPPER] / letters, total[_DIGIT] / size, total[_SYMBOL] / size, total[_MARK] / size, total[_PIPE] / size, total[_STOP] / size,
        1 - len(counts) / n, counts.max() / n, 1 - len(pairs) / max(1, n - 1), same.mean() if n > 1 else 0.0,
        _worst(capital), _worst(symbol), _worst(pipe), _worst(np.concatenate((same, [False]))),
        min(1.0, size / n / 40), min(1.0, text.count(b"\n") / n),
    ]
    out[:SHARES] = shares
    out[SHARES: 2 * SHARES] = np.log(out[:SHARES] + 0.01)
    out[-1] = np.log1p(n)
    return out


def feature_rows(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES))
    for block, words, bounds in doc_words(rows):
        for j, i in enumerate(block):
            out[i] = features(rows[i], words[bounds[j]: bounds[j + 1]])
    return out


@dataclass
class Ranking:
    """A linear Bradley-Terry score with the value of its threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    rows: int = 0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold's quantile lies at ``PASS``."""
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) - self.threshold + np.log(PASS / (1 - PASS)), -40, 40)))


def pair_sums(good: np.ndarray, poor: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, slope and curvature, summed over all pairs of a good and a poor row."""
    loss, slope, bend = 0.0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
    low = poor @ weights
    step = max(1, (1 << 18) // max(1, len(poor)))
    for at in range(0, len(good) if len(poor) else 0, step):
        some = good[at: at + step]
        gap = np.clip((some @ weights)[:, None] - low, -40, 40)
        lose = 1 / (1 + np.exp(gap))
        loss += float(np.logaddexp(0, -gap).sum())
        slope += lose.sum(axis=0) @ poor - lose.sum(axis=1) @ some
        weigh = lose * (1 - lose)
        cross = some.T @ (weigh @ poor)
        bend += (some * weigh.sum(axis=1)[:, None]).T @ some + (poor * weigh.sum(axis=0)[:, None]).T @ poor - cross - cross.T
    return loss, slope, bend


def _descend(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], pairs: int, ridge: float) -> np.ndarray:
    """Weights of the least mean loss with a ridge, by Newton steps that are halved where the loss would rise."""
    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, bend = sums(w)
        return loss / pairs + ridge / 2 * w @ w, slope / pairs + ridge * w, bend / pairs + ridge * np.eye(FEATURES)

    weights = np.zeros(FEATURES)
    loss, slope, bend = at(weights)
    for _ in range(30):
        step, size = np.linalg.solve(bend, slope), 1.0
        new = at(weights - step)
        while new[0] > loss and size > 1e-6:
            size /= 2
            new = at(weights - size * step)
        weights, (loss, slope, bend) = weights - size * step, new
        if np.abs(size * step).max() < 1e-6:
            break
    return weights


def fit_ranking(rows: np.ndarray, label: np.ndarray, pairs: int = 200_000, ridge: float = 1e-3) -> Ranking:
    """The ranking of a table in memory, from pairs drawn at random; ``train`` fits on tables of any size.

    The chance that a row is preferred to another is the logistic function of the difference of scores. The threshold
    is the score's quantile at the share of poor documents. Without both labels every score is ``PASS`` or above.
    """
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES)
    scale = rows.std(axis=0) + 1e-6 if len(rows) else np.ones(FEATURES)
    if not len(good) or not len(poor):
        return Ranking(mean, scale, np.zeros(FEATURES), 0.0, len(rows))
    draw = np.random.default_rng(11)
    norm = (rows - mean) / scale
    gap, zero = norm[draw.choice(good, pairs)] - norm[draw.choice(poor, pairs)], np.zeros((1, FEATURES))
    weights = _descend(lambda w: pair_sums(gap, zero, w), pairs, ridge)
    order = np.sort(norm @ weights)
    threshold = (order[len(poor) - 1] + order[min(len(order) - 1, len(poor))]) / 2
    return Ranking(mean, scale, weights, float(threshold), len(rows))


_LIST = pa.list_(pa.float64())


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, f`` of every row, read from its text once."""
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            found = feature_rows(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * FEATURES, found.ravel())], ["doc_id", "f"])

    return cut(by_id(docs).select("doc_id", "text").mapInArrow(made, "doc_id long, f array<double>"))


def train(docs: DataFrame, labels: DataFrame, table: DataFrame | None = None, ridge: float = 1e-3) -> Ranking:
    """Fits on every labelled document; ``table`` has the features of ``docs`` if they are known.

    Rows are dealt to buckets of about ``BUCKET_ROWS`` of the rarer label by the hash of their id, and in a bucket every
    good row meets every poor one; the more frequent label is cut into parts, so that a bucket is no task's burden. A
    Newton step is one pass that adds up the loss, slope and curvature of all these pairs."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("label"))
    rows = (feature_table(docs) if table is None else table).join(known, "doc_id")

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(FEATURES), np.zeros(FEATURES)
        for batch in batches:
            own = _matrix(batch.column(0))
            if len(own):
                n, mean, square = _merged((n, mean, square), (len(own), own.mean(axis=0), np.square(own - own.mean(axis=0)).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()], _LIST), pa.array([square.tolist()], _LIST)], ["n", "mean", "square"])

    rows = cut(rows.select("doc_id", "label", "f"))
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, mean, square = 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for r in rows.select("f").mapInArrow(moments, "n long, mean array<double>, square array<double>").collect():
        total, mean, square = _merged((total, mean, square), (r["n"], np.array(r["mean"]), np.array(r["square"])))
    scale = np.sqrt(square / total) + 1e-6 if total else np.ones(FEATURES)
    n_good, n_poor = count.get(1, 0), count.get(0, 0)
    if not n_good or not n_poor:
        return Ranking(mean, scale, np.zeros(FEATURES), 0.0, total)
    rare = 1 if n_good < n_poor else 0
    buckets = -(-min(n_good, n_poor) // BUCKET_ROWS)
    parts = -(-max(n_good, n_poor) // (buckets * PART_ROWS))
    hashed = F.xxhash64("doc_id")
    all_parts, own_part = F.sequence(F.lit(0), F.lit(parts - 1)), F.array(F.pmod(F.xxhash64("f"), F.lit(parts)).cast("int"))
    dealt = rows.where("label IN (0, 1)").select(
        "doc_id", "label", "f", F.pmod(hashed, F.lit(buckets)).alias("bucket"), F.explode(F.when(F.col("label") == rare, all_parts).otherwise(own_part)).alias("part"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    dealt = cut(dealt.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part", "doc_id", "label").select(
        F.struct("bucket", "part").cast("string").alias("place"), "label", "f"))

    def sums(weights: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, place, held = [0, 0.0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))], None, []

            def done() -> None:
                if held:
                    norm, label = (np.concatenate([h[0] for h in held]) - mean) / scale, np.concatenate([h[1] for h in held])
                    good, poor = norm[label == 1], norm[label == 0]
                    out[0] += len(good) * len(poor)
                    for i, x in enumerate(pair_sums(good, poor, weights), 1):
                        out[i] = out[i] + x
                    held.clear()

            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.column(0).dictionary_encode()
                code = names.indices.to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
                f, label = _matrix(batch.column(2)), batch.column(1).to_numpy()
                for first, stop in zip(edges, edges[1:]):
                    name = names.dictionary[int(code[first])].as_py()
                    if name != place:
                        done()
                        place = name
                    held.append((f[first:stop], label[first:stop]))
            done()
            yield pa.RecordBatch.from_arrays(
                [pa.array([out[0]]), pa.array([out[1]]), pa.array([out[2].tolist()], _LIST), pa.array([out[3].ravel().tolist()], _LIST)],
                ["pairs", "loss", "slope", "bend"])

        found = dealt.mapInArrow(run, "pairs long, loss double, slope array<double>, bend array<double>").collect()
        return (sum(r["pairs"] for r in found), sum(r["loss"] for r in found), sum(np.array(r["slope"]) for r in found),
                sum(np.array(r["bend"]) for r in found).reshape(FEATURES, FEATURES))

    pairs = sums(np.zeros(FEATURES))[0]
    if not pairs:
        return Ranking(mean, scale, np.zeros(FEATURES), 0.0, total)
    weights = _descend(lambda w: sums(w)[1:], pairs, ridge)
    model = Ranking(mean, scale, weights, 0.0, total)
    scores = cut(rows.select(F.lit("score").alias("key"), table_column(model, "logits", F.col("f")).alias("value")))
    ranks = sorted({n_poor, min(total, n_poor + 1)})
    at = select_ranks(scores, {"score": ranks})
    model.threshold = (at["score", ranks[0]] + at["score", ranks[-1]]) / 2
    return model


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, means and squared deviations of two sets together."""
    n = a[0] + b[0]
    if not n:
        return a
    off = b[1] - a[1]
    return n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n


def table_column(model: Ranking, what: str, f: Column) -> Column:
    """``logits`` or ``scores`` of a column of features."""
    @F.arrow_udf("double")
    def value(column: pa.Array) -> pa.Array:
        return pa.array(getattr(model, what)(_matrix(column)))

    return value(f)


def score_column(model: Ranking, text: Column) -> Column:
    """The score of a text column, in an Arrow function."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column, column], ["a", "b"])
        parts = [model.scores(feature_rows(texts(part))) for part in text_rows([batch])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, model: Ranking | None = None) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``; ``model`` is trained unless it is given.

    Only the text enters a score. Null and empty texts get the score of a text without words. Labels
    that are null, or of unknown or null ids, are left out of the fit; of repeated labels the poorer
    counts. Rows that repeat an id are scored each. Other columns are not read; an empty table gives an
    empty result, and no labels (or one kind only) give scores that all pass.
    """
    if model is None:
        table = feature_table(docs)
        rows = table.select("doc_id", table_column(train(docs, labels, table), "scores", F.col("f")).alias("score"))
    else:
        rows = by_id(docs).select("doc_id", score_column(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= PASS).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score below ``PASS``; columns and texts as they were."""
    return docs.where(score_column(train(docs, labels), F.col("text")) >= PASS)
