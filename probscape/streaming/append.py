"""Continuous append-if-absent into a metadata table, with keyed state.

Each key has an entry in the state store once a row of it was taken, so that a batch costs its own rows and the
states of their keys, however much came before.  Known keys of a base table are the initial state.  The table is a
folder of versions: each micro-batch writes the rows it adds under its own ``batch`` number.  Rerunning a batch
after a failure starts from the state before it and overwrites exactly that folder, so the sink is idempotent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from probscape.common import DataError

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWins(StatefulProcessor):
    """Emits the first row of a key (by ``order``, nulls first) and remembers the key.

    With ``event_time`` a key is forgotten ``forget_ms`` after the event time of its row, when the watermark passes.
    """

    def __init__(self, order: Sequence[str], event_time: str | None = None, forget_ms: int = 0):
        self.order, self.event_time, self.forget_ms = list(order), event_time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")

    def _rank(self, row: Row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=self._rank)
        self.seen.update((True,))
        if self.event_time is not None and first[self.event_time] is not None:
            self.handle.registerTimer(int(first[self.event_time].timestamp() * 1000) + self.forget_ms)
        yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_rows(
    stream: DataFrame, key: str, first_by: Sequence[str], base: DataFrame | None = None, event_time: str | None = None,
    lateness: str | None = None, forget_ms: int = 0,
) -> DataFrame:
    """The stream's rows whose key is new: of a batch the first by ``first_by``, of later batches none.

    ``base`` gives keys that are known from the start; its rows are read when the query first starts, not again.
    With ``event_time`` and ``lateness`` rows behind the watermark are dropped, and a key is forgotten ``forget_ms``
    after its row's event time, so that the state is bounded by the keys of that span.  Null is a key.
    """
    if (event_time is None) != (lateness is None):
        raise DataError("an event time needs a lateness, and the other way round")
    if event_time is not None:
        stream = stream.withWatermark(event_time, lateness)
    known = base.select(key).distinct().groupBy(key) if base is not None else None
    return stream.groupBy(key).transformWithState(
        statefulProcessor=FirstWins(first_by, event_time, forget_ms), outputStructType=stream.schema, outputMode="append",
        timeMode="None" if event_time is None else "EventTime", initialState=known)


def stream_append(
    stream: DataFrame, path: str, checkpoint: str, key: str, first_by: Sequence[str], base: DataFrame | None = None,
    trigger: dict | None = None, event_time: str | None = None, lateness: str | None = None, forget_ms: int = 0,
):
    """Start the stream of ``first_rows`` into the folder ``path``.

    Keyed state needs the RocksDB state store, which is set for the session unless another provider is.
    ``base`` must not change before the first batch is done.
    """
    spark = stream.sparkSession
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKS)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    fresh = first_rows(stream, key, first_by, base, event_time, lateness, forget_ms)
    writer = fresh.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    added = spark.read.parquet(path).drop("batch")
    return added if base is None else base.unionByName(added, allowMissingColumns=True)
