"""Problems in binary containers (level 5 ``.mat`` files), read by ranges of a matrix's columns.

The heads of all variables are read first: names, shapes and places, without their values.  A sparse matrix is
then cut into ranges of columns, and ranges are dealt to tasks, so that neither a file nor a matrix has to fit one.
A packed variable is unpacked as a stream up to the range; nothing of it is held but the range's chunk.
"""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from probscape.common import DataError, cut
from probscape.functions.features import KEY, Corpus
from probscape.sources.corpus import cone_blocks, vec_to_block

#: Entries of a range, about, and entries that are handed on at a time.
RANGE_ENTRIES, CHUNK = 4_000_000, 1 << 18
#: Ranges that a task reads, about, and splits of the file listing whose heads go to one task.
TASK_RANGES, TASK_SPLITS = 1024, 8
_PIECE = 1 << 20

# Fixed values of the format: numeric types, the types of elements, and the classes of matrices.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _PACKED = 14, 15
_CELL, _STRUCT, _OBJECT, _CHAR, _SPARSE = 1, 2, 3, 4, 5
_NUMERIC = range(6, 16)
_LOGICAL = 0x0200


class _Plain:
    """Bytes of a file from a place on; streams of one file keep places of their own."""

    def __init__(self, file, start: int):
        self.file, self.at = file, start

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        out = self.file.read(n)
        if len(out) < n:
            raise DataError("the container ends within a variable")
        self.at += n
        return out

    def skip(self, n: int) -> None:
        self.at += n


class _Packed:
    """The same from a packed element; skipped bytes are unpacked piece by piece and dropped."""

    def __init__(self, file, start: int):
        self.file, self.at, self.left, self.held = file, start, zlib.decompressobj(), b""

    def _more(self) -> bytes:
        self.file.seek(self.at)
        out = self.file.read(_PIECE)
        self.at += len(out)
        return out

    def read(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.held:
                source = self.left.unconsumed_tail or self._more()
                if not source:
                    raise DataError("the container ends within a packed variable")
                self.held = self.left.decompress(source, _PIECE)
                continue
            parts.append(self.held[:need])
            self.held = self.held[need:]
            need -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.read(min(n, _PIECE)))


def _tag(stream, order: str) -> tuple[int, int, bytes | None]:
    """Type and size of the next element, and its bytes if they are within the tag."""
    raw = stream.read(8)
    kind, size = struct.unpack(order + "II", raw)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, raw[4: 4 + (kind >> 16)]
    return kind, size, None


def _pad(size: int) -> int:
    return -size % 8


def _values(stream, order: str) -> np.ndarray:
    """All numbers of the next (small) element."""
    kind, size, inline = _tag(stream, order)
    raw = stream.read(size) if inline is None else inline
    if inline is None:
        stream.skip(_pad(size))
    if kind not in _NUMBERS:
        raise DataError(f"an element of type {kind} holds no numbers")
    return np.frombuffer(raw, np.dtype(_NUMBERS[kind]).newbyteorder(order))


def _chunks(stream, order: str, skip: int, start: int, stop: int) -> Iterator[np.ndarray]:
    """Numbers ``start`` to ``stop`` of the element behind ``skip`` others, in chunks."""
    for _ in range(skip):
        _, size, inline = _tag(stream, order)
        if inline is None:
            stream.skip(size + _pad(size))
    kind, size, inline = _tag(stream, order)
    kind = np.dtype(_NUMBERS[kind]).newbyteorder(order)
    if inline is not None:
        stream = _Plain(io.BytesIO(inline), 0)
    stream.skip(start * kind.itemsize)
    for at in range(start, stop, CHUNK):
        n = min(CHUNK, stop - at)
        yield np.frombuffer(stream.read(n * kind.itemsize), kind)


@dataclass(frozen=True)
class Head:
    name: str
    kind: int
    rows: int
    cols: int
    entries: int


def _head(stream, order: str) -> Head:
    """A matrix's head; the stream stands at its values then."""
    flags = _values(stream, order)
    dims = _values(stream, order).astype(np.int64)
    name = _values(stream, order).astype("u1").tobytes().decode()
    kind = int(flags[0]) & 0xFF
    rows, cols = int(dims[0]), int(np.prod(dims[1:]))
    return Head(name, kind, rows, cols, int(flags[1]) if kind == _SPARSE else rows * cols)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    where = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def _open(path: str):
    system, name = _place(path)
    return system.open_input_file(name)


def _order(file) -> str:
    start = file.read(128)
    if len(start) < 128 or start[126:128] not in (b"IM", b"MI"):
        raise DataError("not a container of level 5")
    return "<" if start[126:128] == b"IM" else ">"


def heads(file) -> Iterator[tuple[Head, int, bool]]:
    """Every variable's head, where its element begins, and whether it is packed; values are not read."""
    order, at = _order(file), 128
    whole = file.size()
    while at + 8 <= whole:
        file.seek(at)
        kind, size = struct.unpack(order + "II", file.read(8))
        packed = kind == _PACKED
        if kind in (_MATRIX, _PACKED):
            yield _head(_stream(file, at, packed, order), order), at, packed
        at += 8 + size


def _stream(file, at: int, packed: bool, order: str):
    stream = (_Packed if packed else _Plain)(file, at + 8)
    if packed and _tag(stream, order)[0] != _MATRIX:
        raise DataError("a packed element holds no matrix")
    return stream


def entries(file, at: int, packed: bool, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """0-based rows, columns and values of the non-zeros in columns ``first`` to ``last`` (exclusive)."""
    file.seek(0)
    order = _order(file)

    def stream():
        out = _stream(file, at, packed, order)
        return out, _head(out, order)

    own, head = stream()
    if head.kind == _SPARSE:
        ends = np.concatenate(list(_chunks(own, order, 1, first, last + 1))).astype(np.int64)
        start, stop = int(ends[0]), int(ends[-1])
        # rows and values lie apart: two streams, chunk by chunk
        at_ = start
        for rows, values in zip(_chunks(stream()[0], order, 0, start, stop), _chunks(stream()[0], order, 2, start, stop), strict=True):
            cols = first + np.searchsorted(ends, np.arange(at_, at_ + len(rows)), side="right") - 1
            at_ += len(rows)
            some = values != 0
            yield rows[some].astype(np.int64), cols[some], values[some].astype(float)
    elif head.kind in _NUMERIC:
        at_ = first * head.rows
        for part in _chunks(own, order, 0, at_, last * head.rows):
            some = np.flatnonzero(part)
            place = at_ + some
            yield place % head.rows, place // head.rows, part[some].astype(float)
            at_ += len(part)
    else:
        raise DataError(f"variable {head.name!r} holds no numbers")


def fields(file, at: int, packed: bool) -> dict[str, list[float]]:
    """The numeric fields of a structure, such as the sizes of cones."""
    file.seek(0)
    order = _order(file)
    stream = _stream(file, at, packed, order)
    if _head(stream, order).kind != _STRUCT:
        return {}
    width = int(_values(stream, order)[0])
    raw = _values(stream, order).astype("u1").tobytes()
    out = {}
    for k in range(0, len(raw), width):
        name = raw[k: k + width].split(b"\0")[0].decode()
        kind, size, _ = _tag(stream, order)
        inner = _Plain(io.BytesIO(stream.read(size)), 0)
        if kind == _MATRIX and size:
            head = _head(inner, order)
            if head.kind in _NUMERIC and head.entries:
                out[name] = _values(inner, order).astype(float).tolist()
    return out


# ------------------------------------------------------------------------------ tables

_HEADS = "path string, variable string, kind int, rows long, cols long, entries long, at long, packed boolean"


def container_variables(spark: SparkSession, folder: str) -> DataFrame:
    """``path, variable, kind, rows, cols, entries, at, packed`` of every variable of the containers below ``folder``.

    Files are listed by Spark and their heads read in tasks; no values are."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mat").load(folder).select("path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    found += [(path, h.name, h.kind, h.rows, h.cols, h.entries, at, packed) for h, at, packed in heads(file)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SCHEMA)], schema=_SCHEMA)

    return listed.mapInArrow(read, _HEADS)


_SCHEMA = pa.schema([
    ("path", pa.string()), ("variable", pa.string()), ("kind", pa.int32()), ("rows", pa.int64()), ("cols", pa.int64()), ("entries", pa.int64()),
    ("at", pa.int64()), ("packed", pa.bool_())])


def container_entries(variables: DataFrame, range_entries: int = RANGE_ENTRIES, carry: Sequence[str] = ("path", "variable")) -> DataFrame:
    """``path, variable, row, col, value`` (0-based) of the non-zeros of numeric variables, by ranges of columns.

    A range has about ``range_entries`` entries if they are spread evenly, and at least one column; a range
    is read in chunks, however many it has. Ranges are dealt to tasks by their number and entries, not by the bytes of
    their list; those of a file's small variables go to one task, which opens the file once. ``carry`` names the
    columns of ``variables`` that every entry gets."""
    parts = F.least(F.greatest(F.lit(1), F.ceil(F.col("entries") / range_entries)), F.greatest(F.lit(1), F.col("cols")))
    ranges = variables.where(F.col("kind").isin(_SPARSE, *_NUMERIC) & (F.col("cols") > 0)).withColumn("parts", parts.cast("long"))
    size = ranges.agg(F.sum("parts").alias("ranges"), F.sum("entries").alias("entries")).first()
    ranges = ranges.withColumn("k", F.explode(F.expr("sequence(0, parts - 1)"))).selectExpr(
        "struct(" + ", ".join(f"`{c}`" for c in carry) + ") AS own", "path", "at", "packed", "k", "cols * k DIV parts AS first", "cols * (k + 1) DIV parts AS last")
    spread = ranges.repartition(_tasks(variables.sparkSession, (size["ranges"] or 0) / TASK_RANGES, (size["entries"] or 0) / range_entries), "path", "k")
    spread = spread.sortWithinPartitions("path", "at", "first")
    schema = variables.select(*carry).schema.add("row", "long").add("col", "long").add("value", "double")
    kinds = to_arrow_schema(schema)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, path, file = [], 0, None, None

        def out() -> pa.RecordBatch:
            return pa.Table.from_batches(held, kinds).combine_chunks().to_batches()[0]

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != path:
                        if file is not None:
                            file.close()
                        path, file = r["path"], _open(r["path"])
                    for rows, cols, values in entries(file, r["at"], r["packed"], r["first"], r["last"]):
                        if not len(rows):
                            continue
                        same = [pa.repeat(pa.scalar(r["own"][c], kinds.field(c).type), len(rows)) for c in carry]
                        held.append(pa.RecordBatch.from_arrays([*same, pa.array(rows), pa.array(cols), pa.array(values)], schema=kinds))
                        count += len(rows)
                        if count >= CHUNK:
                            yield out()
                            held, count = [], 0
        finally:
            if file is not None:
                file.close()
        if held:
            yield out()

    return spread.mapInArrow(read, schema)


def _tasks(spark: SparkSession, *wanted: float) -> int:
    return max(spark.sparkContext.defaultParallelism, *map(math.ceil, wanted))


def container_cones(variables: DataFrame, name: str = "K") -> DataFrame:
    """``path, f, l, q, r, s``: the cone sizes of every container."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), *((c, pa.list_(pa.float64())) for c in "flqrs")])
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                with _open(r["path"]) as file:
                    found = fields(file, r["at"], r["packed"])
                made.append({"path": r["path"], **{c: found.get(c) for c in "flqrs"}})
            yield pa.RecordBatch.from_pylist(made, schema=kinds)

    own = variables.where((F.col("variable") == name) & (F.col("kind") == _STRUCT)).select("path", "at", "packed")
    return own.mapInArrow(read, "path string, " + ", ".join(f"{c} array<double>" for c in "flqrs"))


def read_containers(spark: SparkSession, folder: str, instance=None) -> Corpus:
    """The corpus of all containers: cones ``K``, right-hand side ``b``, objective ``c`` and constraints ``At`` (or ``A``).

    ``instance`` is an expression over ``path`` (the file's bare name without its suffix unless given).  Constraint
    matrices may lie either way; the right-hand side tells which.  A container without ``K`` or ``b`` is an error."""
    name = F.regexp_extract("path", r"([^/]*)\.mat$", 1) if instance is None else instance
    # heads are read once, whatever reads them later; a file has a few, so many files' heads fit a task
    made = container_variables(spark, folder).withColumn(KEY, name)
    variables = cut(made.repartition(_tasks(spark, made.rdd.getNumPartitions() / TASK_SPLITS), "path"))
    per = variables.groupBy("path", KEY).agg(
        F.max(F.when(F.col("variable") == "b", F.col("rows") * F.col("cols"))).alias("m"), F.max((F.col("variable") == "K").cast("int")).alias("cones"),
        F.max((F.col("variable") == "At").cast("int")).alias("turned"))
    missing = F.raise_error(F.concat(F.lit("container without K or b: "), F.col("path"))).cast("bigint")
    per = per.select("path", KEY, F.when(F.col("m").isNull() | (F.col("cones") == 0), missing).otherwise(F.col("m")).alias("m"), "turned")
    blocks = cut(cone_blocks(container_cones(variables).join(per.select("path", KEY), "path")))
    # what an entry means follows from its variable, so it is known before any is read
    by_row = (F.col("variable") == "A") & (F.col("rows") == F.col("m"))
    wanted = variables.where("variable IN ('A', 'At', 'b', 'c', 'C')").drop(KEY).join(per, "path").withColumn("by_row", by_row)
    read = container_entries(wanted.where("NOT (variable = 'A' AND turned = 1)"), carry=(KEY, "variable", "by_row"))
    rhs = read.where("variable = 'b'").select(KEY, (F.greatest("row", "col") + 1).cast("int").alias("mat_id"), F.col("value").alias("b"))
    every = per.select(KEY, F.explode(F.expr("sequence(1, cast(m AS int))")).alias("mat_id"))
    rhs = every.join(rhs, [KEY, "mat_id"], "left").select(KEY, "mat_id", F.coalesce("b", F.lit(0.0)).alias("b"))
    objective = F.col("variable").isin("c", "C")
    mat = F.when(objective, F.lit(0)).when(F.col("by_row"), F.col("row") + 1).otherwise(F.col("col") + 1).cast("int")
    idx = F.when(objective, F.greatest("row", "col")).when(F.col("by_row"), F.col("col")).otherwise(F.col("row"))
    vec = read.where("variable <> 'b'").select(KEY, mat.alias("mat_id"), idx.alias("idx"), "value")
    problems = per.join(blocks.groupBy(KEY).agg(F.count(F.lit(1)).cast("int").alias("n_blocks")), KEY).select(KEY, F.col("m").cast("int").alias("m"), "n_blocks")
    placed = vec_to_block(vec, blocks).select(KEY, "mat_id", "block_id", "row", "col", "value")
    return Corpus(problems, blocks, rhs, placed)


# ------------------------------------------------------------------------------ writing


def _element(kind: int, raw: bytes) -> bytes:
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * _pad(len(raw))


def _matrix(name: str, value) -> bytes:
    """A variable: an array, a mapping (structure), or ``(rows, row numbers, column ends, values)`` of a sparse matrix."""
    def start(kind: int, rows: int, cols: int, extra: int = 0) -> bytes:
        return _element(6, struct.pack("<II", kind, extra)) + _element(5, struct.pack("<ii", rows, cols)) + _element(1, name.encode())

    if isinstance(value, Mapping):
        names = b"".join(k.encode().ljust(32, b"\0") for k in value)
        body = start(_STRUCT, 1, 1) + _element(5, struct.pack("<i", 32)) + _element(1, names) + b"".join(_matrix("", v) for v in value.values())
    elif isinstance(value, tuple):
        rows, row, ends, values = value
        body = start(_SPARSE, rows, len(ends) - 1, len(values)) + b"".join(
            _element(k, np.asarray(v, d).tobytes()) for k, v, d in ((5, row, "<i4"), (5, ends, "<i4"), (9, values, "<f8")))
    else:
        full = np.atleast_2d(np.asarray(value, "<f8"))
        body = start(6, *full.shape) + _element(9, full.tobytes(order="F"))
    return _element(_MATRIX, body)


def container_bytes(variables: Mapping, packed: bool = False) -> bytes:
    """A container with the given variables."""
    parts = [_matrix(k, v) for k, v in variables.items()]
    if packed:
        parts = [struct.pack("<II", _PACKED, len(z)) + z for z in map(zlib.compress, parts)]
    return b"container".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(parts)


def write_containers(vec: DataFrame, folder: str, height: int, rhs: int, cones: Mapping[str, list[float]], packed: bool = True) -> DataFrame:
    """Write ``<folder>/<instance>.mat`` from ``(instance, mat_id, idx, value)``, all with the same cones: ``path`` of every file.

    A file is one task's work, so an instance has to fit one; matrix 0 is the objective, ``b`` is 1, 2, ... ``rhs``."""
    base = folder.rstrip("/")

    def data(mat: np.ndarray, idx: np.ndarray, value: np.ndarray) -> bytes:
        own, goal = mat > 0, mat == 0
        ends = np.concatenate(([0], np.cumsum(np.bincount(mat[own] - 1, minlength=rhs))))
        c = np.zeros(height)
        c[idx[goal]] = value[goal]
        return container_bytes({"K": cones, "b": np.arange(1.0, rhs + 1), "c": c, "At": (height, idx[own], ends, value[own])}, packed)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _place(base)
        system.create_dir(where, recursive=True)

        def write(name: str, parts: list[list[np.ndarray]]) -> str:
            with system.open_output_stream(f"{where}/{name}.mat") as out:
                out.write(data(*(np.concatenate(x) for x in zip(*parts))))
            return f"{base}/{name}.mat"

        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            paths = []
            for first, stop in zip(edges, edges[1:]):
                name = names.dictionary[int(code[first])].as_py()
                if held and name != last:
                    paths.append(write(last, held))
                    held = []
                last = name
                held.append([c[first:stop] for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write(last, held)], pa.string())], ["path"])

    rows = vec.where("mat_id >= 0").select(F.coalesce(KEY, F.lit("None")).alias(KEY), F.col("mat_id").cast("long").alias("mat_id"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    return rows.repartition(KEY).sortWithinPartitions(KEY, "mat_id", "idx").mapInArrow(written, "path string")
