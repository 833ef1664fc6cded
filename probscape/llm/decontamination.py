"""Benchmark decontamination by pigeonhole edit matching (operator 9)."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import by_id, text_rows, texts

#: Edits allowed for each character of an item; items shorter than this are looked for as they stand, between word bounds.
EDIT_SHARE = 0.1
FUZZY_CHARS = 30
#: Bytes of items searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 16 << 20


def plain(text: bytes | str) -> str:
    """A-Z lower-cased, runs of white space made one space, none at the ends."""
    raw = text.encode() if isinstance(text, str) else text
    return " ".join(raw.lower().decode().split())


def split(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length: that many edits leave one of them whole."""
    cuts = [round(i * len(item) / (errors + 1)) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def edit_distance(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """The least number of edits between ``item`` and a part of ``text``, and where that part ends.

    Myers' bit-parallel columns: one bit for each character of the item, in one big integer.
    """
    masks = masks or bit_masks(item)
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(d | up))
        minus = up & d
        if score < best:
            best, at = score, i
    return best, at


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def ancestors(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the ranges of pieces around it, from two or three pieces up to all of them.

    A range of j pieces may hold j - 1 edits. Halving a range leaves its halves two edits fewer in
    sum, so if a range is within its budget, one of its halves is: a hit has to climb all the way.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    todo = [(0, pieces)]
    while todo:
        a, b = todo.pop()
        for i in range(a, b):
            out[i].insert(0, (a, b))
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


@functools.lru_cache(maxsize=4)
def _machine(items: tuple[tuple[int, str], ...], share: float):
    """The pieces of all items in one automaton; a worker builds it once."""
    where: dict[str, list[tuple]] = {}
    for k, (_, item) in enumerate(items):
        short = len(item) < FUZZY_CHARS
        parts = split(item, 0 if short else int(share * len(item)))
        cuts = [a for a, _ in parts] + [len(item)]
        nodes: dict[tuple[int, int], tuple] = {}
        for i, ranges in enumerate(ancestors(len(parts))):
            for a, b in ranges:
                if (a, b) not in nodes:
                    part = item[cuts[a]: cuts[b]]
                    nodes[a, b] = part, b - a - 1, cuts[a], bit_masks(part)
            where.setdefault(parts[i][1], []).append((k, cuts[i], [nodes[r] for r in ranges], short))
    machine = ahocorasick.Automaton()
    for piece, at in where.items():
        machine.add_word(piece, (len(piece), at))
    if where:
        machine.make_automaton()
    return items, machine, bool(where)


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Neither side of a passage goes on with a letter or digit."""
    return not (start and text[start - 1].isalnum()) and not text[end: end + 1].isalnum()


def find(text: str, machine) -> list[tuple[int, int]]:
    """``item, edits`` of every item within its budget somewhere in ``text`` (both plain)."""
    items, pieces, any_piece = machine
    if not any_piece or not text:
        return []
    best: dict[int, int] = {}
    sure: dict[int, int] = {}  # the last start at which an item was found
    for end, (size, at) in pieces.iter(text):
        for k, offset, nodes, short in at:
            start = end + 1 - size - offset
            if short:
                if _stands_alone(text, start, end + 1):
                    best[k] = 0
                continue
            errors = nodes[-1][1]
            if k in sure and abs(start - sure[k]) <= errors // 2 and best[k] <= errors // 4:
                continue
            for part, budget, begin, masks in nodes:
                low = start + begin
                edits = edit_distance(part, text[max(0, low - budget): max(0, low + len(part) + budget)], masks)[0] if budget else 0
                if edits > budget:
                    break
            else:
                best[k] = min(edits, best.get(k, edits))
                sure[k] = start
    return [(items[k][0], edits) for k, edits in best.items()]


def _blocks(benchmark: DataFrame, most: int) -> list[tuple[tuple[int, str], ...]]:
    """The items as plain texts, in blocks of at most about ``most`` bytes; equal ones share an id."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        item = plain(text)
        if not item:
            continue
        if size > most:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, item))
        size += 4 * len(item)
    return [tuple(b) for b in blocks if b]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``doc_id, item_id, edits``: each document and item of which it holds a copy.

    A copy is a passage within ``share`` edits a character of the item, after A-Z are lower-cased and
    white space is evened out. With k edits allowed, an item is cut into k + 1 pieces; every exact hit
    of a piece in the whole text is verified with Myers' bit-parallel distance around it.

    The benchmark is a stated query set: each block of its items goes to all tasks, and more than
    ``pass_bytes`` of items take further passes. Items with fewer than 30 characters are looked for without edits,
    between word bounds. ``edits`` is that of the first place found well within the budget; a later one may need
    fewer. Items with null ids, or null or blank texts, are not looked for. Null and empty documents match nothing; repeated rows are reported once
    each; other columns are not read; empty tables give an empty result.
    """
    rows = by_id(docs)
    schema = "doc_id long, item_id long, edits int"

    def matched(items):
        def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(items, share)
            for batch in text_rows(batches):
                out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), texts(batch)) for hit in find(plain(text), machine)]
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())],
                                                     ["doc_id", "item_id", "edits"])
        return made

    parts = [rows.mapInArrow(matched(block), schema) for block in _blocks(benchmark, pass_bytes)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns and texts as they were."""
    def leaks(items):
        @F.arrow_udf("boolean")
        def found(column: pa.Array) -> pa.Array:
            batch, machine = pa.RecordBatch.from_arrays([column, column], ["a", "b"]), _machine(items, share)
            return pa.array([bool(find(plain(t), machine)) for t in texts(batch)], pa.bool_())

        return found(F.col("text").cast("string"))

    for block in _blocks(benchmark, PASS_BYTES):
        docs = docs.where(~leaks(block))
    return docs
