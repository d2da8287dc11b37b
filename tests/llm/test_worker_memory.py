"""What the pipeline's Python functions keep in a worker, which stands beside all that the executor's JVM has ever taken."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from panelspark.llm import common, packing  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def tables(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "vile", "rotten", "scum"]
    docs = [(k, " ".join(words[(k * j + j * j) % (8 if k % 4 == 0 else 5)] for j in range(1, 40)), "s") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage, limit", [("toxicity", 16 << 20), ("near_dedup", 8 << 20), ("packing", 48 << 20)])
def test_caches_are_small_and_of_one_operator(spark, tables, stage, limit, monkeypatch):
    docs = common.table(spark, tables, "documents")
    kind, plan, made, most = type(docs), type(docs).mapInArrow, [], []

    first = common.SegmentCache.__init__

    def counted(self, *args, **options):
        first(self, *args, **options)
        made.append(2 * self.limit)

    def here(self, function, schema, *args, **options):
        """Runs function in this process, too, on the same rows, after another operator's."""
        batches = self.toArrow().to_batches()
        with monkeypatch.context() as m:
            m.setattr(common.SegmentCache, "__init__", counted)
            m.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda _: 0})())
            common._worker.clear()
            common._worker["earlier"] = object()
            made.clear()
            list(function(iter(batches)))
            if made:
                most.append(sum(made))
                assert "earlier" not in common._worker and len(common._worker) == 1
        return plan(self, function, schema, *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", here)
    STAGES[stage](spark, docs, tables)
    common._worker.clear()
    assert most and max(most) <= limit
