"""Conversation structure repair: weighted CYK parsing over spans of a conversation's rows.

The grammar is in Chomsky normal form and generates ``(s?(ua)+)?`` together with every part of such a string:

    e = nothing   p = s   u = u(au)*   a = a(ua)*   x = (ua)+   y = (au)+   pu = p u   px = p x

A span's cell holds, for every symbol, the cheapest edits (cost, audit) that turn its rows into a string of that
symbol; of equal costs the least audit. Both add up under concatenation: audits of one span and cost never begin
one another, because they have as many letters other than ``I`` and their ``I`` cost something. Cells are closed
under insertion at both ends, so one split of a span is enough, and longer spans are put together from shorter
ones: 1, 2, 4, ... rows, then the pieces of a conversation that lie in several ranges.

Rows are dealt to tasks in sorted ranges which may cut a conversation anywhere; what a range says about the
conversations it cuts is a cell and some counts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import Stages

#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
#: Pieces of a conversation that are put together at a time.
FAN = 16

E, P, U, A, X, Y, PU, PX = range(8)
_BINARY = [
    (E, E, E), *((n, n, E) for n in range(1, 8)), *((n, E, n) for n in range(1, 8)),
    (X, U, A), (X, X, X), (Y, A, U), (Y, Y, Y), (U, U, Y), (U, X, U), (A, A, X), (A, Y, A),
    (PU, P, U), (PU, PX, U), (PU, PU, Y), (PX, P, X), (PX, PU, A), (PX, PX, X)]

Cell = tuple


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * 8
    for n, i, k in _BINARY:
        a, b = left[i], right[k]
        if a is None or b is None:
            continue
        cost, best = a[0] + b[0], out[n]
        if best is None or cost < best[0]:
            out[n] = (cost, a[1] + b[1])
        elif cost == best[0]:
            audit = a[1] + b[1]
            if audit < best[1]:
                out[n] = (cost, audit)
    return tuple(out)


def _cell(**symbols) -> Cell:
    return tuple(symbols.get(name) for name in ("e", "p", "u", "a", "x", "y", "pu", "px"))


#: No rows: nothing, or insertions.
GAP = _cell(e=(0, ""), u=(INSERT, "I"), a=(INSERT, "I"), x=(2 * INSERT, "II"), y=(2 * INSERT, "II"))


def _leaf(code: str) -> Cell:
    """The closed cell of a row: ``d`` must go; else its initial (``o``: any other), upper case if truncated."""
    symbols = {"e": (DELETE, "D")}
    if code != "d":
        stays = TRUNCATED if code.isupper() else 0
        symbols |= {"u": (REROLE + stays, "R"), "a": (REROLE + stays, "R")}
        kept = {"s": "p", "u": "u", "a": "a"}.get(code.lower())
        if kept:
            symbols[kept] = (stays, "K")
    return join(join(GAP, _cell(**symbols)), GAP)


@functools.lru_cache(maxsize=1 << 16)
def _short(codes: str) -> Cell:
    if len(codes) == 1:
        return _leaf(codes)
    half = 1 << (len(codes) - 1).bit_length() - 1
    return join(_short(codes[:half]), _short(codes[half:]))


def parse(codes: str) -> Cell:
    """The cell of rows given by their codes, bottom-up by span length."""
    spans = [_short(codes[k: k + 8]) for k in range(0, len(codes), 8)]
    while len(spans) > 1:
        spans = [join(*spans[k: k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0] if spans else GAP


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(c for c in (cell[E], cell[X], cell[PX]) if c is not None)


class Replay:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.expected, self.written = audit, 0, "user", 0

    def _out(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if not (self.written == 0 and edit == "K" and role[:1] == "s"):
            self.expected = "assistant" if self.expected == "user" else "user"
        self.written += 1
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield self._out("I", self.expected, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(edit, role if edit == "K" else self.expected, text)


class Digest:
    """sha256 of repaired rows, joined by newlines."""

    def __init__(self):
        self.hash, self.glue = hashlib.sha256(), b""

    def add(self, rows: Iterable[tuple[str, str, str]]) -> None:
        for _, role, text in rows:
            self.hash.update(self.glue + f"{role}:{text}".encode())
            self.glue = b"\n"


LEGAL = ("su", "ua", "au")


class Piece:
    """What a sorted run of a conversation's rows says: counts, its ends and the codes of its rows."""

    def __init__(self, conv, keep: bool):
        self.conv, self.rows = conv, [] if keep else None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.count = 0
        self.first_turn = self.last_turn = None
        self.first = self.last = None
        self.codes: list[str] = []

    def add(self, turn, role: str, text: str, copies: int, repeated: bool) -> None:
        solid = text.rstrip(WHITE)
        initial = role[:1]
        if not solid:
            self.blank += copies
            code = "d"
        elif repeated:
            self.duplicate += copies
            code = "d"
        else:
            self.duplicate += copies - 1
            code = initial if initial in ("s", "u", "a") else "o"
            if solid[-1] not in ".!?":
                self.truncated += 1
                code = code.upper()
        self.codes.append(code + "d" * (copies - 1))
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        if initial + initial not in LEGAL:
            self.illegal += copies - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        self.count += copies
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.rows is not None:
            self.rows.append((role, text, copies))


_KEPT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = _KEPT + ", part long, costs array<long>, audits array<string>, turns long, first_turn long, last_turn long, first string, last string"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
    ("repaired_sha256", pa.string()), ("part", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    *((c, pa.int64()) for c in ("turns", "first_turn", "last_turn")), ("first", pa.string()), ("last", pa.string())])


def _open(piece: Piece, part: int) -> tuple:
    cell = parse("".join(piece.codes))
    return (
        piece.conv, None, piece.blank, piece.duplicate, piece.truncated, piece.illegal, None, None, None, part, [c and c[0] for c in cell],
        [c and c[1] for c in cell], piece.turns, piece.first_turn, piece.last_turn, piece.first, piece.last)


def _gaps(turns: int, low: int | None, high: int | None) -> int:
    return high - low + 1 - turns if turns else 0


def _whole(piece: Piece) -> tuple:
    cost, audit = cheapest(parse("".join(piece.codes)))
    replay, digest = Replay(audit), Digest()
    for role, text, copies in piece.rows:
        for _ in range(copies):
            digest.add(replay.row(role, text))
    digest.add(replay.inserted())
    gaps = _gaps(piece.turns, piece.first_turn, piece.last_turn)
    return (piece.conv, gaps, piece.blank, piece.duplicate, piece.truncated, piece.illegal, cost, audit, digest.hash.hexdigest(), *[None] * 8)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to whole conversations; the first and the last one of a range, which may go on
    elsewhere, to pieces."""
    part, piece, out, size = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for conv, turn, role, text, copies, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    out.append(_open(piece, part) if piece.rows is None else _whole(piece))
                    size += piece.count
                piece = Piece(conv, piece is not None)
            if copies:
                piece.add(turn, role, text, copies, repeated)
        if size >= 1 << 14:
            yield _batch(out, _ARROW)
            out, size = [], 0
    if piece is not None:
        out.append(_open(piece, part))
    if out:
        yield _batch(out, _ARROW)


def _merged(pieces: list[dict]) -> dict:
    """Neighbouring pieces of one conversation as one."""
    out = dict(pieces[0])
    cells = [tuple(c if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)) for p in pieces]
    while len(cells) > 1:
        cells = [join(*cells[k: k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    for p in pieces[1:]:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            out[name] += p[name]
        if out["last"] is not None and p["first"] is not None:
            out["illegal"] += out["last"] + p["first"] not in LEGAL
        out["turns"] += p["turns"] - (p["turns"] > 0 and out["last_turn"] == p["first_turn"])
        for name in ("first_turn", "first"):
            out[name] = p[name] if out[name] is None else out[name]
        for name in ("last_turn", "last"):
            out[name] = out[name] if p[name] is None else p[name]
    return out | {"costs": [c and c[0] for c in cells[0]], "audits": [c and c[1] for c in cells[0]]}


def _put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            pieces = sorted(row["pieces"], key=lambda p: p["part"])
            whole = _merged(pieces) | {"part": row["part"]}
            yield _batch([tuple(whole[f.name] for f in _ARROW)], _ARROW)


def _closed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.to_pylist():
            cost, audit = cheapest(tuple(c if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)))
            p |= {"cost": cost, "audit": audit, "gaps": _gaps(p["turns"], p["first_turn"], p["last_turn"])}
            yield _batch([tuple(p[f.name] for f in _ARROW)], _ARROW)


def distinct_rows(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, copies``: equal rows as one with a count. ``copies`` says how often a row stands
    (0: not at all, but its conversation is known)."""
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    return plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeated``: role and text occur in an earlier turn of the conversation (null turns first)."""
    name = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    marked = rows.withColumn("_print", F.when(F.col("copies") > 0, name))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    often = marked.where("copies > 0").groupBy("conv_id", "_print").agg(first.alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    often = often.select(F.col("conv_id").alias("_conv"), F.col("_print").alias("_same"), "_first")
    joined = marked.join(often, (F.col("_print") == F.col("_same")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    later = F.col("turn").isNotNull() & (~F.col("_first.known") | (F.col("turn") > F.col("_first.turn")))
    return joined.select("conv_id", "turn", "role", "text", "copies", F.coalesce(later, F.lit(False)).alias("repeated"))


def _replayed(digest: bool):
    """Rows behind their conversation's head (its audit): digests or repaired rows, as a stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay, sha, place, out, size = None, None, None, 0, [], 0
        kept = pa.schema(list(_ARROW)[:9])
        rows_of = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        schema = kept if digest else rows_of

        def take(found):
            nonlocal place, size
            for edit, role, text in found:
                out.append((head["conv_id"], place, edit, role, text))
                place, size = place + 1, size + len(text)

        def end():
            if digest:
                sha.add(replay.inserted())
                out.append((*(head[f.name] for f in list(kept)[:8]), sha.hash.hexdigest()))
            else:
                take(replay.inserted())

        for batch in batches:
            for r in batch.to_pylist():
                if r["is_row"] == 0:
                    if head is not None:
                        end()
                    head, replay, sha, place = r, Replay(r["audit"]), Digest(), 0
                    continue
                for _ in range(r["copies"]):
                    found = replay.row(r["role"], r["text"])
                    if digest:
                        sha.add(found)
                    else:
                        take(found)
            if len(out) >= 1 << 12 or size >= 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
        if head is not None:
            end()
        if out:
            yield _batch(out, schema)

    return run


def _streamed(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Heads and rows of conversations, in order; a conversation passes through one task row by row."""
    top = heads.select(*_ARROW.names[:8], F.lit(0).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                       F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text", "copies")
    both = top.unionByName(body, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "text")


def repairs(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows`` has ``conv_id, turn, role, text`` (other columns are not read); ``copies`` says how often each row
    stands, 0 for one that is gone while its conversation is to be reported. Null role and text are one space, a
    null conv_id is a conversation, null turns come first. Rows of one turn stand in the order of role and text,
    so that repeated rows are neighbours. A row without a role has no initial and is not kept. An audit is one
    string, so a conversation may have as many rows as a string has characters. An empty table gives no rows.
    """
    stages = Stages(rows.sparkSession, "conversations")
    single = distinct_rows(rows, copies)
    order = ("conv_id", "turn", "role", "text")
    lined = with_repeats(single).repartitionByRange(*order).sortWithinPartitions(*order)
    told = stages.keep(lined.mapInArrow(_pieces, _PIECE))
    pieces = told.where("costs IS NOT NULL")
    while pieces.groupBy("conv_id").count().where("count > 1").take(1):
        groups = pieces.groupBy("conv_id", F.expr(f"part DIV {FAN}").alias("part"))
        packed = groups.agg(F.collect_list(F.struct(*[f for f in _ARROW.names])).alias("pieces"))
        pieces = stages.keep(packed.mapInArrow(_put_together, _PIECE))
    heads = stages.keep(pieces.mapInArrow(_closed, _PIECE))
    cut = heads.select(F.col("conv_id").alias("_conv"))
    theirs = single.join(F.broadcast(cut), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    rest = _streamed(heads, theirs).mapInArrow(_replayed(True), _KEPT)
    return told.where("costs IS NULL").select(*_ARROW.names[:9]).unionByName(rest)


def repaired_rows(rows: DataFrame, found: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows of every conversation after the edits of ``repairs``."""
    return _streamed(found, distinct_rows(rows, copies)).mapInArrow(_replayed(False), "conv_id long, place long, edit string, role string, text string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the damage that their ``conv_id:turn`` draws, and how often each stands."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    torn = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), torn.alias("text"), "kind")
    return rows, F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1))
