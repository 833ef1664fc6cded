"""Token counts by batch encoding (operator 2)."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import by_id, text_rows, texts

#: Bytes of text in a batch, bytes of a long text's piece, units that a worker remembers.
BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
MEMORY_UNITS = 800_000
#: Lengths of the longest units that are remembered.
UNIT_BYTES = 64


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> dict[bytes, int]:
    return {}


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """A long text in pieces that end before white space, where no token reaches across."""
    start = 0
    while len(text) - start > most:
        cut = max(text.rfind(b" ", start + 1, start + most), text.rfind(b"\n", start + 1, start + most))
        if cut <= start:
            found = [x for x in (text.find(b" ", start + most), text.find(b"\n", start + most)) if x > 0]
            if not found:
                break
            cut = min(found)
        yield text[start:cut]
        start = cut
    yield text[start:]


def _stem(unit: bytes) -> tuple[bytes, bytes]:
    """Splits off a closing comma or full stop after an ASCII letter: a token never spans both."""
    if len(unit) > 1 and unit[-1:] in (b",", b".") and unit[-2:-1].isalpha():
        return unit[:-1], unit[-1:]
    return unit, b""


def _learn(units: list[bytes], memory: dict[bytes, int], encode) -> None:
    """Encodes units not met so far in one batch. Pure ASCII units count as their lower case does,
    unless they may hold a special string."""
    parts = {}
    for unit in units:
        stem, tail = _stem(unit)
        if stem.isascii() and b"<|" not in stem:
            stem = stem.lower()
        parts[unit] = stem, tail
    new = list({p for pair in parts.values() for p in pair if p and p not in memory})
    for unit, n in zip(new, encode(new)):
        memory[unit] = n
    for unit, (stem, tail) in parts.items():
        memory[unit] = memory[stem] + (memory[tail] if tail else 0)


def count_tokens(rows: list[bytes], path: str) -> list[int]:
    """Tokens of each text, by a tokenizer that drops white space before it encodes.

    Such a tokenizer's count is the sum over the units between ASCII white space. Units go through
    the library in batches; those met again are looked up.
    """
    library, memory = tokenizer(path), _memory(path)

    def encode(units: list[bytes]) -> list[int]:
        found = []
        for i in range(0, len(units), 20_000):
            batch = [u.decode() for u in units[i: i + 20_000]]
            found += [len(x) for x in library.encode_batch_fast(batch, add_special_tokens=False)]
        return found

    counts = []
    for i in range(0, len(rows), 500):
        split = [[u for piece in pieces(row) for u in piece.split()] for row in rows[i: i + 500]]
        new = {u for units in split for u in units}
        new.difference_update(memory)
        long = [u for u in new if len(u) > UNIT_BYTES]
        new.difference_update(long)
        _learn(list(new), memory, encode)
        extra = dict(zip(long, encode(long)))
        for units in split:
            if extra:
                counts.append(sum(memory[u] if u in memory else extra[u] for u in units))
            else:
                counts.append(sum(map(memory.__getitem__, units)))
        if len(memory) > MEMORY_UNITS:
            memory.clear()
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``path`` names a tokenizer whose pre-tokenizer drops white space. Special strings inside texts
    are handled as is the library's default; none are added; nothing is truncated.

    Null and empty texts have 0 bytes and tokens. Repeated rows and null ids are counted like any
    other; other columns are not read; an empty table gives an empty result.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches, BATCH_BYTES):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = pa.array(count_tokens(texts(batch), path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = by_id(docs).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
