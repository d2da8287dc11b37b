"""run() against a plain-Python version of its five stages, on documents with every odd case: null and repeated ids,
repeated rows, empty and very long texts, ties, columns with clashing names, and none at all."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from panelspark.llm import mixing, secrets, token_ids, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, __mix string, node long, bucket string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def corpus():
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(400)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = []
    for k in range(160):
        t = line(r.choice([12, 40, 90]))
        if k % 4 == 0:
            for _ in range(r.randint(1, 4)):
                t[r.randrange(len(t))] = r.choice(["horriblest", "vilethings"])
        rows.append((k, " ".join(t)))
    rows += [(300 + k, rows[9][1] + f" tail{k}") for k in range(6)]  # near copies of one text
    rows += [(None, rows[10][1]), (None, "nobody knows " + " ".join(line(20))), (None, None), (None, ""), (None, "nobody knows this " + " ".join(line(20)))]
    rows += [rows[11], rows[11], (11, " ".join(line(30))), (12, rows[13][1])]  # repeated rows and ids
    rows += [(400, ""), (401, None), (402, " \n\t"), (403, "word1 " * 9000), (404, " ".join(line(15000))), (405, "É ß 日本 🙂 don't " + " ".join(line(9)))]
    live, shared = "Zk3pW" + "aB9xQ7" * 4, "Ex4mple" + "Q1w2" * 5
    rows += [(500, " ".join(line(20)) + f" password=abcdef0123456789 and {live}"), (501, " ".join(line(20)) + " AKIA" + "A1" * 8)]
    rows += [(510 + k, " ".join(line(20)) + f" {shared} " + " ".join(line(9))) for k in range(5)]
    return [(k, t, "en", None if i % 17 == 5 else f"src{i * i % 4}", len(t or ""), "x", "y", i % 3, "z") for i, (k, t) in enumerate(rows)]


def clean(rows, model):
    """Weights times log(1 + counts), feature by feature, against the cut."""
    known = model.features

    def p(text):
        found = Counter(known[h] for part in (text or "").lower().split() for h in toxicity.features_of(part) if h in known)
        margin = sum(model.weights[k] * math.log(1 + n) for k, n in found.items())
        return 1 / (1 + math.exp(model.thresholds[0] - margin))

    return [r for r in rows if p(r[1]) < model.cut]


def without_copies(rows, size=5):
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = [*range(len(rows))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return [rows[min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))] for g in groups.values()]


def found_spans(text):
    """(start, end, kind, value) of base kinds, and of candidates outside them."""
    assigned = [(m.start(), m.end(), 0, m[2]) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    base = assigned + [(m.start(), m.end(), k, m[0]) for k, pattern in ((1, r"AKIA[A-Z0-9]{14,}"), (2, r"[0-9a-f]{16,}")) for m in re.finditer(pattern, text)]
    random_ones = [m for m in re.finditer(r"[A-Za-z0-9_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 10]
    return base, [(m.start(), m.end(), 3, m[0]) for m in random_ones if not any(b[0] < m.end() and m.start() < b[1] for b in base)]


def owned(rows):
    """Values that few owners and few repositories hold."""
    owners, repos = {}, {}
    for r in rows:
        for s in sum(found_spans(r[1] or ""), []):
            owners.setdefault(s[3], set()).add(r[3])
            repos.setdefault(s[3], set()).add((r[3], r[0]))
    return {v for v in owners if len(owners[v]) < 3 and len(repos[v]) < 20}


def masked(rows):
    live, out = owned(rows), []
    for r in rows:
        base, more = found_spans(r[1] or "")
        spans = sorted(base + [s for s in more if s[3] in live])
        if spans:
            text, at = "", 0
            for a, b, *_ in spans:
                if a >= at:
                    text += r[1][at:a] + secrets.MARK
                at = max(at, b)
            text += r[1][at:]
            r = (r[0], text, r[2], r[3], len(text), *r[5:])
        out.append(r)
    return out


def mixed(rows):
    sizes = Counter(r[3] for r in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    ids, seen, out = Counter(r[0] for r in rows), Counter(), []
    for r in rows:
        name = str(r[0])
        if r[0] is None or ids[r[0]] > 1:
            said = json.dumps({k: v for k, v in zip(NAMES, r) if v is not None}, separators=(",", ":"), ensure_ascii=False)
            seen[said] += 1
            name = f"{chr(0) if r[0] is None else r[0]}:{hashlib.md5(said.encode()).hexdigest()}:{seen[said]}"
        rate = math.sqrt(sizes[r[3]]) * (len(rows) / total) / sizes[r[3]]
        u = int(hashlib.md5(f"{mixing.SEED}:1:{name}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [r] * k
    return out


def pieces(rows):
    ids = token_ids.token_ids(P.path("byte_bpe_50k.json"))
    out = []
    for r in rows:
        x = np.frombuffer(ids.whole(r[1] or "") + (2).to_bytes(4, "little"), "<u4") if r[1] else np.array([2], "<u4")
        first = (len(x) - 1) % 1024 + 1
        cuts = [0, *range(first, len(x) + 1, 1024)]
        out += [(r[0], k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    written(spark, tmp_path, rows, [(k, 1, int(k % 4 == 0)) for k in range(160)])
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    stages = [clean(rows, model)]
    for stage in (without_copies, masked, mixed, pieces):
        stages.append(stage(stages[-1]))
    assert all(len(a) > len(b) for a, b in zip([rows, *stages], stages[:2])) and stages[2] != stages[1]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr), name
        assert docs.columns == NAMES
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(zip(got["doc_id"].astype(object).where(got["doc_id"].notna(), None), *(got[c] for c in ("piece", "start", "length", "ids_crc32"))), key=repr) == sorted(stages[-1], key=repr)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 1024 * 11 / 9) + 1  # best fit decreasing


def test_nothing(spark, tmp_path):
    import corpus_pipeline

    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_odd_rows(spark, tmp_path):
    import corpus_pipeline

    written(spark, tmp_path, [(None, None, None, None, None, None, None, None, None)] * 3 + [(1, "", "en", "s", 0, None, None, None, None)], [(1, 1, None), (None, 1, 1)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 4, name  # texts without words are no copies of each other
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["length"] for r in got.collect()} <= {1}
