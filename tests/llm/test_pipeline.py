"""The pipeline's stages on a small corpus: what each must drop, keep and return."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(120):
        t = [r.choice(words) for _ in range(50)]
        if k % 4 == 0:
            t[5] = t[20] = t[30] = "horriblest"
        rows.append((k, " ".join(t), "en", f"src{k % 3}", 0))
        labels.append((k, 1, int(k % 4 == 0)))
    rows.append((200, rows[1][1] + " tail", "en", "src0", 0))  # a near copy
    rows.append((201, rows[1][1], "en", "src1", 0))
    rows.append((202, " ".join(r.choice(words) for _ in range(30)) + " password=abcdef0123456789abcdef", "en", "src1", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {k: {x["doc_id"] for x in v.select("doc_id").collect()} for k, v in out.items()}
    assert ids["toxicity"] == {k for k in range(120) if k % 4} | {200, 201, 202}
    assert ids["near_dedup"] == ids["toxicity"] - {200, 201} == ids["secrets"]
    assert all(out[k].columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in ("toxicity", "near_dedup", "secrets", "mixing"))
    assert out["secrets"].where("doc_id = 202").first()["text"].endswith("<SECRET>")
    assert ids["mixing"] <= ids["secrets"] and ids["packing"] == ids["mixing"]
    assert out["packing"].where("piece = 0").count() == out["mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out["packing"].count()


def test_near_dedup_decides_by_row(spark):
    import corpus_pipeline

    r = random.Random(2)
    a, b, c, d = (" ".join(f"word{r.randrange(300)}" for _ in range(50)) for _ in range(4))
    rows = [(None, a), (None, a), (1, b), (1, b), (2, b + " tail"), (2, c), (None, c + " tail"), (3, ""), (3, None), (4, "alone"), (9, d), (8, d)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    firsts = [(x["doc_id"], x["text"]) for x in kept]
    assert sorted(firsts, key=repr) == sorted([(None, a), (1, b), (2, c), (3, ""), (3, None), (4, "alone"), (8, d)], key=repr)
