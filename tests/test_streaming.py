"""The continuous append over several batches: state, replays, late rows."""

import datetime as dt
import shutil

from probscape.streaming.append import read_appended, stream_append

SCHEMA = "key string, t long, v long, at timestamp, note string"


def start(spark, tmp_path, base=None, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream_append(stream, str(tmp_path / "out"), str(tmp_path / "chk"), "key", ["t", "v"], base, **how)


def put(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "parts" / name))
    (tmp_path / "in").mkdir(exist_ok=True)
    for f in (tmp_path / "parts" / name).glob("*.parquet"):
        shutil.copy(f, tmp_path / "in" / f"{name}.parquet")


def rows_of(spark, tmp_path):
    return sorted((r["key"] or "", r["t"], r["v"], r["note"]) for r in read_appended(spark, str(tmp_path / "out")).collect())


def test_batches_share_state_and_replays_change_nothing(spark, tmp_path):
    big = 1 << 60
    put(spark, tmp_path, "1", [("a", 5, 1, None, "x"), ("a", 5, 0, None, None), ("b", 9, big + 1, None, "y"), (None, 1, 1, None, "null"), ("base", 0, 0, None, "")])
    put(spark, tmp_path, "2", [("a", 1, 7, None, "later batch"), ("c", 2, 2, None, "c"), ("c", None, 3, None, "nulls first"), (None, 0, 0, None, "")])
    base = spark.createDataFrame([("base", 1), ("base", 2), ("d", 3)], "key string, v long")
    q = start(spark, tmp_path, base)
    q.awaitTermination()
    want = [("", 1, 1, "null"), ("a", 5, 0, None), ("b", 9, big + 1, "y"), ("c", None, 3, "nulls first")]
    assert rows_of(spark, tmp_path) == want
    put(spark, tmp_path, "3", [("d", 1, 1, None, "known"), ("e", 1, 1, None, "new"), ("a", 0, 0, None, "known")])
    q = start(spark, tmp_path, base)
    q.awaitTermination()
    want.append(("e", 1, 1, "new"))
    assert rows_of(spark, tmp_path) == sorted(want)
    # a batch reads its own rows; the state it touches is that of their keys
    state = q.lastProgress["stateOperators"][0]
    assert sum(p["numInputRows"] for p in q.recentProgress) == 3 and state["numRowsUpdated"] <= 3
    # the last batch once more, as after a failure between the write and its commit
    number = max(int(p.name) for p in (tmp_path / "chk" / "commits").glob("[0-9]*"))
    (tmp_path / "chk" / "commits" / str(number)).unlink()
    (tmp_path / "chk" / "commits" / f".{number}.crc").unlink(missing_ok=True)
    q = start(spark, tmp_path, base)
    q.awaitTermination()
    assert rows_of(spark, tmp_path) == sorted(want)


def test_late_rows_and_forgotten_keys(spark, tmp_path):
    def at(minute):
        return dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=minute)

    put(spark, tmp_path, "1", [("a", 0, 0, at(0), "first"), ("z", 0, 0, at(60), "moves the watermark")])
    put(spark, tmp_path, "2", [("y", 0, 0, at(61), "lets the watermark act")])
    put(spark, tmp_path, "3", [("late", 0, 0, at(5), "behind the watermark"), ("a", 1, 1, at(70), "its key was forgotten"), ("z", 1, 1, at(70), "still known")])
    q = start(spark, tmp_path, event_time="at", lateness="10 minutes", forget_ms=60_000)
    q.awaitTermination()
    assert [(k, v) for k, _, v, _ in rows_of(spark, tmp_path)] == [("a", 0), ("a", 1), ("y", 0), ("z", 0)]
