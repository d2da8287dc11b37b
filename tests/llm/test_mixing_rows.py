"""Mixing loses and merges no row, and takes columns of any name."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from panelspark.llm import common, mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string, at timestamp, ntz timestamp_ntz, replica int, SHUFFLE_KEY string, __mix_name string, `a.b` double, __f_bit int"


def row(k, text="t", micro=0, number=0.0):
    at = datetime(2024, 1, 1) + timedelta(microseconds=micro)
    return (k, text, "s", at, at, 7, "x", "y", number, 3)


def test_rows_that_differ_by_microseconds_stay_apart(spark):
    rows = [row(1, micro=k) for k in range(1, 9)] + [row(2, None)] * 3 + [row(None, "", micro=k % 2) for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = mixing.mix(df, {"s": 1.0}, budget=40 * len(rows))
    assert out.columns == [*df.columns, "replica_", "shuffle_key_"]
    got = Counter(map(tuple, out.drop("replica_", "shuffle_key_").collect()))
    assert set(got) == set(rows) and all(20 * n < got[r] < 60 * n for r, n in Counter(rows).items())
    again = mixing.mix(df.repartition(5), {"s": 1.0}, budget=40 * len(rows))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)


def test_equal_text_forms_do_not_merge(spark):
    df = spark.createDataFrame([(1, "s", 0.0), (1, "s", -0.0), (1, "s", float("nan"))], "doc_id long, source string, x double")
    df = df.select("doc_id", "source", F.struct(F.when(F.col("x") == 0, F.lit(None).cast("int")).alias("n"), "x").alias("x"))
    got = Counter(str(r["x"]["x"]) for r in mixing.mix(df, {"s": 1.0}, budget=300).collect())
    assert set(got) == {"0.0", "-0.0", "nan"} and all(n > 50 for n in got.values())


def test_many_equal_rows_over_partitions(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 3).alias("kind")).repartition(8)
    rows = common.written(df.select(F.col("kind").alias("k"), F.monotonically_increasing_id().alias("__mix_row")))
    for r in mixing.numbered(rows, "k").groupBy("k").agg(F.sort_array(F.collect_list("__mix_k")).alias("n")).collect():
        assert r["n"] == [*range(1, 1001)]
    assert mixing.mix(df).count() == pytest.approx(3000, rel=0.1)


def test_files_with_the_added_columns_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([row(k) for k in range(20)], SCHEMA)
    mixing.mix(df).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").columns[-2:] == ["replica_", "shuffle_key_"]
    assert mixing.mix(df.where("false")).count() == 0
