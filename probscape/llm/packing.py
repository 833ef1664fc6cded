"""Packing token sequences by minimum bin slack (operator 8)."""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import Stages, by_id, text_rows, texts
from probscape.llm.tokens import _stem, tokenizer

#: Units that a worker remembers (about 160 bytes each), and their longest length in bytes.
MEMORY_UNITS = 1_500_000
UNIT_BYTES = 48
#: Units that go through the library at a time.
BATCH_UNITS = 2_000
#: Buckets in which pieces of one length are numbered, so that no length is numbered in one task.
SHARES = 64

#: White space (of any alphabet) before a space or a line feed: there a unit can't simply end.
_RUN = re.compile(rb"(?:[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[ \n]")
_UNIT = re.compile(rb"(?:(?:[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)*+)"
                   rb"(?:(?!(?:[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)).)*+", re.S)


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> dict[bytes, bytes]:
    return {}


#: What hints at white space other than single spaces and line feeds.
_ODD = (b"  ", b"\n ", b" \n", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f",
        b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def units(text: bytes) -> list[bytes]:
    """The text in units, each with the white space before it; a byte-level tokenizer whose words
    take their space along never joins what stands on both sides of such a boundary.

    A unit stands for its text behind a space; it begins with a line feed, or with a space that isn't
    part of it, if it stands for itself.
    """
    if any(odd in text for odd in _ODD) and _RUN.search(text):
        return [b" " + u for u in _UNIT.findall(text) if u]
    out = text.replace(b"\n", b" \n").split(b" ")
    out[0] = b" " + out[0]
    return out


def _spelled(unit: bytes) -> bytes:
    return unit[1:] if unit[:1] == b" " else unit if unit[:1] == b"\n" else b" " + unit


@functools.lru_cache(maxsize=1)
def _bytes_of(size: int) -> list[bytes]:
    return [i.to_bytes(4, "little") for i in range(size)]


def _encode(path: str, many: list[bytes]) -> list[bytes]:
    library, found = tokenizer(path), []
    spell = _bytes_of(library.get_vocab_size()).__getitem__
    for i in range(0, len(many), BATCH_UNITS):
        batch = [u.decode() for u in many[i: i + BATCH_UNITS]]
        found += [b"".join(map(spell, x.ids)) for x in library.encode_batch_fast(batch, add_special_tokens=False)]
    return found


def _gaps(found: list) -> Iterator[int]:
    """Positions of None."""
    at = -1
    try:
        while True:
            at = found.index(None, at + 1)
            yield at
    except ValueError:
        return


def encode(rows: list[bytes], path: str, most: int = MEMORY_UNITS) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit numbers; units met again are looked up.

    Beyond ``most`` units the half met first, which holds the common ones, is kept; the others are encoded again."""
    memory = _memory(path)
    for i in range(0, len(rows), 300):
        split = [units(row) for row in rows[i: i + 300]]
        found = [list(map(memory.get, us)) for us in split]
        gaps = [list(_gaps(ids)) for ids in found]
        parts = {}
        for us, at in zip(split, gaps):
            for j in at:
                if us[j] not in parts:
                    parts[us[j]] = _stem(us[j])
        # a unit with a closing mark is its stem's ids and the mark's
        todo = [u for u in {stem for stem, _ in parts.values()} if u not in memory]
        fresh = dict(zip(todo, _encode(path, [_spelled(u) for u in todo])))
        marks = dict(zip((b",", b"."), _encode(path, [b",", b"."])))
        for u, (stem, tail) in parts.items():
            if tail:
                fresh[u] = (fresh[stem] if stem in fresh else memory[stem]) + marks[tail]
        for us, ids, at in zip(split, found, gaps):
            for j in at:
                ids[j] = fresh[us[j]] if us[j] in fresh else memory[us[j]]
            yield b"".join(ids)
        memory.update((u, x) for u, x in fresh.items() if len(u) <= UNIT_BYTES)
        if len(memory) > most:
            first = list(itertools.islice(memory.items(), most // 2))
            memory.clear()
            memory.update(first)


def _cut(path: str, end: int, window: int, most: int):
    """Whole windows of each document, and what is left of it."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in text_rows(batches):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts(batch), path, most)):
                ids += end.to_bytes(4, "little")
                n = len(ids) // 4
                out += [(doc, i // window, i, min(window, n - i), zlib.crc32(ids[4 * i: 4 * (i + window)]), n) for i in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return made


# --- minimum bin slack -----------------------------------------------------------------------


def fill(counts: np.ndarray, window: int) -> np.ndarray:
    """How many pieces of each length fill a window closest to its end.

    ``counts[n]`` pieces of length n are left. The longest one left is put in, then subset sums over
    bounded counts are kept as one bitset for each length (a count goes in as 1, 2, 4, ... and a
    rest); going back through the bitsets gives the counts of the best sum.
    """
    take = np.zeros(len(counts), np.int64)
    first = int(np.flatnonzero(counts)[-1])
    take[first] = 1
    room = window - first
    limit = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    sums = 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        have = min(int(counts[length]) - (length == first), room // length)
        group = 1
        while have > 0:
            group = min(group, have)
            steps.append((length, group, sums))
            sums |= (sums << (length * group)) & limit
            have -= group
            group *= 2
        if sums >> room & 1:
            break
    left = sums.bit_length() - 1
    for length, group, before in reversed(steps):
        if not before >> left & 1:
            take[length] += group
            left -= length * group
    return take


def plan(counts: np.ndarray, window: int) -> list[tuple[int, np.ndarray]]:
    """Windows as (how often, pieces of each length); a filling is repeated while its pieces last,
    so the plan has a few fillings for each length, however many pieces there are."""
    left = counts.copy()
    out = []
    while left.any():
        take = fill(left, window)
        used = take > 0
        times = int((left[used] // take[used]).min())
        left -= times * take
        out.append((times, take))
    return out


def _layout(fillings: list[tuple[int, np.ndarray]], window: int):
    """For each length: ranks at which a filling begins, pieces in one window, the filling's first
    sequence and its first offset."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(window + 1, np.int64)
    sequence = 0
    for times, take in fillings:
        offset = 0
        for length in np.flatnonzero(take)[::-1]:
            table.setdefault(int(length), []).append((int(ranks[length]), int(take[length]), sequence, offset))
            offset += int(length * take[length])
            ranks[length] += times * take[length]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def _place(layout: dict[int, np.ndarray]):
    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = layout[int(n)]
                own = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - own[:, 0]
                sequence[at] = own[:, 2] + inside // own[:, 1]
                offset[at] = own[:, 3] + inside % own[:, 1] * n
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], _OUT)

    return placed


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, end: int = 1, window: int = 2048, most: int = MEMORY_UNITS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    A document is its ids by the byte-level tokenizer at ``path`` and the id ``end``. Whole windows
    are cut off and are sequences of their own; what is left of each document (one piece, shorter than
    a window) is packed by minimum bin slack: a plan is made from the counts of the piece lengths (at
    most ``window`` numbers), and each piece finds its place from its rank among those of its length.

    A task remembers the ids of at most ``most`` units of text; fewer take less memory and more time.

    Null and empty texts are the id ``end`` alone. Repeated rows and null ids are documents like any
    other. Other columns are not read; an empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "packing")
    kinds = "doc_id long, part long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = by_id(docs).mapInArrow(_cut(path, end, window, most), kinds)
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(SHARES)).cast("int"))
    pieces = stages.keep(pieces)

    sizes = pieces.groupBy("length", "share").count()
    sizes = sizes.select("length", "share", "count", F.expr("sum(count) OVER (PARTITION BY length ORDER BY share) - count").alias("before"))
    totals = pieces.groupBy("length").count().collect()  # a row for each length at most
    counts = np.zeros(window + 1, np.int64)
    for length, n in totals:
        counts[length] = n
    fillings = plan(counts, window)
    layout = _layout(fillings, window)

    order = "row_number() OVER (PARTITION BY length, share ORDER BY doc_id, start, ids_crc32, doc_tokens) - 1"
    ranked = pieces.select("*", F.expr(order).alias("within"))
    ranked = ranked.join(F.broadcast(sizes.select("length", "share", "before")), ["length", "share"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(_place(layout), ", ".join(f"{c} long" for c in _OUT))
