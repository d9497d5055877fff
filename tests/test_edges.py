"""Edge cases: nulls in concatenation and arithmetic, zero denominators,
all-null rows, twin-row imputation, empty frames, CSV round trip."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import features as fx
from lodestar.operators import relational as rel
from lodestar.session import scratch_path
from lodestar.sources import tables as tb


def test_null_propagating_concat(spark):
    df = spark.createDataFrame([("Male", "PhD"), (None, "PhD"), ("Female", None)], "g string, e string")
    got = [r.ge for r in df.select(fx.null_concat(F.col("g"), F.col("e")).alias("ge")).collect()]
    assert got == ["Male_PhD", None, None]


def test_zero_denominators_are_null(spark):
    df = spark.createDataFrame([(22.0, 0.0), (0.0, 0.0), (30.0, 3.0)], "age double, exp double")
    feats = fx.engineered(F.col("age"), F.col("exp"), F.lit(1))
    rows = df.select(feats["ratio_experiencia"].alias("r"), feats["ratio_velocidad_carrera"].alias("v")).collect()
    assert rows[0].v is None            # age - 22 == 0
    assert rows[1].r is None            # age == 0
    assert rows[2].r == pytest.approx(0.1)


def test_log_feature_zero_and_null(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1.5,)], "x double")
    got = [r.l for r in df.select(fx.log_experience(F.col("x")).alias("l")).collect()]
    assert got[0] == 0.0 and got[1] is None and got[2] == pytest.approx(0.9162907318741551)


def test_literal_map_miss_is_null(spark):
    df = spark.createDataFrame([("PhD",), ("High School",), (None,)], "e string")
    got = [r.n for r in df.select(fx.literal_map(fx.EDUCATION_ORDINAL, F.col("e")).alias("n")).collect()]
    assert got == [3, None, None]


def test_all_null_and_any_null_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "b", 1.0)], "id int, s string, v double")
    assert df.na.drop("all", subset=["s", "v"]).count() == 2
    assert df.where(rel.any_null(["s", "v"])).count() == 2


def test_patches_fill_and_override(spark):
    df = spark.createDataFrame([(1, None, 350.0), (2, 30.0, 100.0)], "id int, age double, salary double")
    patches = spark.createDataFrame([(1, "age", 41.0), (1, "salary", 35000.0), (2, "age", 99.0)],
                                    "id int, column string, value double")
    filled = {r.id: r for r in rel.apply_patches(df, patches, "id").collect()}
    assert filled[1].age == 41.0 and filled[2].age == 30.0          # fill only nulls
    forced = {r.id: r for r in rel.apply_patches(df, patches, "id", override=True).collect()}
    assert forced[1].salary == 35000.0 and forced[2].age == 99.0


def test_empty_frame_is_rejected(spark):
    empty = spark.createDataFrame([], "id int")
    with pytest.raises(ValueError):
        tb.frame_to_table(empty, "lodestar_empty_should_fail")


def test_optional_csv_source_missing(spark):
    assert tb.read_csv_optional(spark, scratch_path(spark, "does-not-exist") + "/x.csv") is None


def test_csv_roundtrip_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, 'quote "x"', None)], "id int, s string, v double")
    back = sorted(tuple(r) for r in tb.csv_roundtrip(df, "edge").collect())
    assert back == [(1, "a,b", 1.5), (2, 'quote "x"', None)]


def test_code_fence_strip(spark):
    df = spark.createDataFrame([("```json\n{\"k\": 1}\n```",), ("  {\"k\": 2}  ",)], "t string")
    got = [r.c for r in df.select(fx.strip_code_fence(F.col("t")).alias("c")).collect()]
    assert got == ['{"k": 1}', '{"k": 2}']
