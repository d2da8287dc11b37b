"""Columns of any name and case go through the operators that keep all columns; rows of one id are spread."""

import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from panelspark.llm import secrets, token_files, toxicity  # noqa: E402

SCHEMA = "doc_id long, Text string, source string, N_Chars int, `row` string, `doc` int, `spans` string, `all` string, __row string, `a.b` double"


def frame(spark):
    rows = [(k, t, "s", len(t or ""), "r", k, "s", "a", "_", 0.5) for k, t in enumerate(["clean text", f"password=abcdef0123456789{'x' * 5}", None, "", "a " + "Zk3pW" + "aB9xQ7" * 4])]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_redact_keeps_columns_of_any_name(spark):
    df, rows = frame(spark)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.schema["N_Chars"].dataType == df.schema["N_Chars"].dataType
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got[0] == rows[0] and got[2] == rows[2] and got[3] == rows[3]
    for k in (1, 4):
        assert secrets.MARK in got[k][1] and got[k][3] == len(got[k][1]) and got[k][4:] == rows[k][4:]


def test_drop_toxic_finds_its_column_by_sparks_rules(spark):
    df, rows = frame(spark)
    r = random.Random(2)
    words = [" ".join(r.choice(["apple", "pear", "plum"] + ["horrid"] * (3 * (k % 2))) for _ in range(30)) for k in range(60)]
    labelled = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    model = toxicity.fit(labelled, spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int"))
    out = toxicity.drop_toxic(df.withColumn("Text", F.when(F.col("doc_id") == 0, "horrid " * 30).otherwise(F.col("text"))), model)
    assert out.columns == df.columns and sorted(x[0] for x in out.collect()) == [1, 2, 3, 4]


def test_rows_of_one_id_are_spread(spark, tmp_path):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text here").alias("text"), F.lit(1).alias("row"), F.lit(1).alias("first")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = token_files.write_shards(df, P.path("word_bpe_49k.json"), f"file://{tmp_path}/files")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["n_docs"] for r in found.collect())[-1] < 2500 and found.count() > 1
    got = token_files.read_shards(spark, f"file://{tmp_path}/files")
    assert got.count() == 4000 and got.agg(F.countDistinct("start")).first()[0] == 4000


def test_equal_ids_go_by_their_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, None), (1, "a"), (0, "z"), (1, "a")], "doc_id long, text string")
    got = token_files.token_files(df, P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got][:2] == [(0, 2), (1, 1)] and [r["start"] for r in got] == [0, 2, 3, 5, 7]
    assert got[2]["ids_crc32"] == got[3]["ids_crc32"] != got[4]["ids_crc32"]
