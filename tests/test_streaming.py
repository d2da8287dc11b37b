"""The streamed ledger books the same sessions as the batch one."""

from datetime import date, timedelta

import numpy as np

from panelspark.operators import execution
from panelspark.streaming.ledger import stream_ledger


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = [date(2020, 1, 6) + timedelta(days=k) for k in range(8)]
    rows = [("r", d, f"T{i}", float(100 + rng.normal()), float(rng.normal(0, 0.1))) for d in days for i in range(3)]
    schema = "run_id string, date date, ticker string, price double, target_weight double"
    for k, part in enumerate((rows[:12], rows[12:])):  # whole sessions, in order
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{k}")
    costs = execution.get_cost_model("medium")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
    q = stream_ledger(stream, costs).writeStream.format("memory").queryName("ledger").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("ledger").orderBy("date").toPandas()
    batch = execution.run_backtests(spark.createDataFrame(rows, schema), "price", costs).snapshots.orderBy("date").toPandas()
    assert len(got) == 8
    np.testing.assert_allclose(got["equity"], batch["equity"])
