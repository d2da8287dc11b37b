"""The corpus pipeline: documents without toxic ones, near copies and secrets, mixed to target weights and packed.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

    toxicity     drops the documents that the ordinal severity model rejects (labels: the table `labels`)
    near_dedup   keeps one row of each group of near copies (5-word shingles, Jaccard index 0.8 or more): that of
                 the least doc_id, nulls last, then the first as read; rows may share an id or have none
    secrets      masks secrets in the texts: base kinds, and random-looking values that few owners hold
    mixing       repeats or leaves out documents so that sources get their target shares, and shuffles
    packing      packs all that is left into sequences of 1024 tokens

Odd rows: null, empty and word-less texts are clean, no copies of each other and hold no secrets, and are packed as
the end id alone; null ids and repeated rows are rows of their own, except that near_dedup keeps one of equal texts and
mixing draws for each by itself; null sources are a source; other columns are kept as they are, whatever their names;
no documents give no sequences.

ORACLE_SQL is None, as SQL can express neither the model nor the tokenizer; tests/llm/test_whole_pipeline.py holds
each stage's rows, and those of run(), against a plain-Python version of all five.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import mixing, packing, secrets, setsketch, toxicity
from panelspark.llm.common import free_name, spread, table, written


#: Of each generation of a worker's caches. An executor's JVM keeps the heap that any stage has made it take, and workers
#: keep their memory beside it, so that caches are smaller here than in the operators' own queries: time, not results.
FEATURES_BYTES, WORDS_BYTES, IDS_BYTES = 8 << 20, 4 << 20, 12 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(spread(docs), table(spark, sf_dir, "labels"), cache_bytes=FEATURES_BYTES)
    return toxicity.drop_toxic(docs, model, cache_bytes=FEATURES_BYTES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name("row", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = setsketch.near_duplicates(spread(rows), size=5, percent=80, id_col=row, cache_bytes=WORDS_BYTES)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(first).alias("first")).select(F.col("first")[row].alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spread(docs))  # up to here tables keep the order of their rows, by which near_dedup decides ties


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, replica_col=None, key_col=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_bytes=IDS_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
