"""Metadata tables: upserts, their error rules, runs, streaming."""

import pytest
from pyspark.sql import functions as F

from probscape.common import DataError, nan_to_null
from probscape.functions import diagnostics as dg
from probscape.operators import metadata as md
from probscape.operators import runs as rn


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(
        [("a", "S", 1.0, 2.0), ("b", "S", 3.0, None)], "instances string, source string, feature_x double, algo_p double"
    )


def test_empty_patch_changes_nothing(spark, base):
    patch = base.select("instances", "feature_x").limit(0)
    assert rows(md.merge_patch(base, patch, ("feature_",))) == rows(base)


def test_patch_takes_nulls_and_adds_columns(spark, base):
    patch = spark.createDataFrame([("b", None, 7.0)], "Instances string, feature_x double, feature_new double")
    assert rows(md.merge_patch(base, patch, ("feature_",))) == [("a", "S", 1.0, 2.0, None), ("b", "S", None, None, 7.0)]


@pytest.mark.parametrize("rows_, cols", [
    ([("z", 1.0)], "instances string, feature_x double"),
    ([("a", 1.0), ("a", 2.0)], "instances string, feature_x double"),
    ([("a", 1.0)], "instances string, other double"),
    ([(1.0,)], "feature_x double"),
])
def test_bad_patches(spark, base, rows_, cols):
    with pytest.raises(DataError):
        md.merge_patch(base, spark.createDataFrame(rows_, cols), ("feature_",))


def test_append(spark, base):
    new = spark.createDataFrame([("c", 5.0)], "INSTANCES string, feature_x double")
    assert ("c", None, 5.0, None) in rows(md.append_instances(base, new))
    with pytest.raises(DataError):
        md.append_instances(base, spark.createDataFrame([("a", 5.0)], "instances string, feature_x double"))
    with pytest.raises(DataError):
        md.append_instances(base, spark.createDataFrame([("c", 5.0), ("c", 6.0)], "instances string, feature_x double"))


def test_first_row_wins(spark, base):
    more = spark.createDataFrame([("a", 9.0, 1), ("c", 5.0, 2), ("c", 6.0, 1)], "instances string, feature_x double, t int")
    out = md.append_if_absent(base, more, first_by=["t"])
    assert rows(out) == rows(base) + [("c", None, 6.0, None)]


def test_join_needs_unique_keys_and_rows(spark):
    f = spark.createDataFrame([("a", 1.0)], "Instance string, feature_x double")
    r = spark.createDataFrame([("a", 1.0)], "Instance string, algo_p double")
    s = spark.createDataFrame([("a", "S")], "Instance string, Source string")
    assert md.build_metadata(f, r, s).columns == ["Instances", "Source", "feature_x", "algo_p"]
    with pytest.raises(Exception, match="duplicate keys"):
        md.build_metadata(f.union(f), r, s).collect()
    with pytest.raises(DataError):
        md.build_metadata(f, r.withColumn("Instance", F.lit("z")), s)
    with pytest.raises(DataError):
        md.build_metadata(f, r.limit(0), s)


def test_backfill_is_per_table(spark, base):
    empty = spark.createDataFrame([], "instances string, algo_q string")
    first = spark.createDataFrame([("a", " 1 ")], "instances string, algo_q string")
    second = spark.createDataFrame([("b", "2")], "instances string, algo_q string")
    got = md.backfill_column(base.select("instances"), "algo_q", [empty, first, second])
    assert rows(got) == [("a", "1"), ("b", "")]


def test_sources(spark):
    df = spark.createDataFrame([("/r/genetic generated/point target/x",), ("/q/y",)], "p string")
    assert [r[0] for r in df.select(md.classify_source(F.col("p"), strict=False)).collect()] == [
        "Genetically Generated from Point Target", "Unknown"]
    with pytest.raises(Exception, match="cannot tell the source"):
        df.select(md.classify_source(F.col("p"), "/r")).collect()


def test_key_clash(spark):
    with pytest.raises(DataError):
        md.normalize_keys(spark.createDataFrame([(1, 2)], "Row int, Instances int"))
    with pytest.raises(DataError):
        md.drop_null_coords(spark.createDataFrame([(None, 1.0)], "z_1 double, z_2 double"))
    with pytest.raises(DataError):
        md.validate_metadata(["instances", "feature_x"])


def test_residuals_with_a_missing_part(spark):
    raw = spark.createDataFrame(
        [(1e-6, None, 1e-7, None, "time_limit"), (1e-6, 1e-7, 1e-7, None, "TIME_LIMIT"), (None, None, None, 1e-9, None)],
        "gap double, pinfeas double, dinfeas double, phi double, status string",
    )
    assert [r["status"] for r in rn.normalize_run(raw, "sdpt3").collect()] == ["TIME_LIMIT", "OPTIMAL", "FAILED"]
    assert [r["status"] for r in rn.normalize_run(raw, "sedumi").collect()] == ["TIME_LIMIT", "OPTIMAL", "OPTIMAL"]
    with pytest.raises(DataError):
        rn.normalize_run(raw, "other")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "instances string, feature_x double")
    out = dg.feature_diagnostics(nan_to_null(df)).first()
    assert (out["missing"], out["distinct_values"], out["constant"], out["all_missing"]) == (1, 1, True, False)


def test_stream_in_several_batches(spark, tmp_path):
    from probscape.streaming.append import read_appended, stream_append

    src = tmp_path / "in"
    for n, part in enumerate([[("a", 2, 1.0), ("a", 1, 2.0)], [("a", 0, 3.0), ("b", 5, 4.0)], [("k", 1, 9.0), ("b", 1, 5.0)]]):
        spark.createDataFrame(part, "key string, t int, v double").coalesce(1).write.parquet(str(src / f"p{n}"))
    base = spark.createDataFrame([("k",)], "key string")
    stream = spark.readStream.schema("key string, t int, v double").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = stream_append(stream, str(tmp_path / "out"), str(tmp_path / "chk"), "key", ["t"], base)
    q.awaitTermination()
    got = {r["key"]: r["v"] for r in read_appended(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b"} and got["a"] in (2.0, 3.0)
    assert read_appended(spark, str(tmp_path / "out")).count() == 2
