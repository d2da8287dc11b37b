"""The corpus operators against brute force, on small fixtures with the odd cases: nulls, empty and long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from panelspark.llm import ann, mixing, packing, quality_rules, secrets, setsketch, token_counts, token_files, token_ids, toxicity, urls  # noqa: E402

DOCS = "doc_id long, text string, source string, n_chars long, n_tokens string, row string, node string, bucket string"


def docs(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "x" * 20000, "tab\tand\u00a0space  two\n lines ", "<|endoftext|> in text", "É ß 日本 🙂 don't", "same text here", "same text here"]


def test_token_counts(spark):
    path = P.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, ODD), path, limit=100).collect()}
    model = token_counts.counter(path).model
    for i, t in enumerate(ODD):
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs(spark, ODD).where("false"), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_are_the_librarys(name):
    ids = token_ids.token_ids(P.path(name))
    r = random.Random(1)
    signs = ["a", "b", " ", " ", "\n", "\t", "<|endoftext|>", "'s", "É", "İ", "ſ", "\u0301", "\xa0", "1", "!", ",", "Σ", "Ab", "\x1c", "日", "🙂"]
    texts = [t or "" for t in ODD] + ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    whole = [array("I", e.ids).tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.encode(t) for t in texts] == whole


def expected_ids(name, texts, end):
    ids = token_ids.token_ids(P.path(name))
    return [np.frombuffer(ids.whole(t or "") + end.to_bytes(4, "little"), "<u4") if t else np.array([end], "<u4") for t in texts]


def test_packing(spark):
    df = docs(spark, ODD)
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), capacity=64).toPandas()
    for i, ids in enumerate(expected_ids("byte_bpe_50k.json", ODD, 2)):
        mine = got[got["doc_id"] == i].sort_values("piece")
        assert mine["piece"].tolist() == [*range(len(mine))] and mine["length"].sum() == len(ids)
        assert (mine["length"].iloc[1:] == 64).all() and mine["length"].max() <= 64
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 64
    assert packing.pack_documents(df.where("false"), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_limit(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    seq, off, n = packing.vector_best_fit(lengths, (100, 3, 10000), (1.0, 0.1, 0.1), rule)
    assert n >= lengths.sum() / 100
    for k in range(n):
        mine = lengths[seq == k]
        assert 0 < len(mine) <= 3 and mine.sum() <= 100 and (mine**2).sum() <= 10000
        assert sorted(off[seq == k])[0] == 0
    free = packing.vector_best_fit(lengths, (100, 100, 10000), (1.0, 0.01, 0.01), "norm")[2]
    plain: list[int] = []  # best fit decreasing on tokens alone
    for x in sorted(lengths.tolist(), reverse=True):
        room = [k for k, left in enumerate(plain) if left >= x]
        if room:
            plain[min(room, key=plain.__getitem__)] -= x
        else:
            plain.append(100 - x)
    assert free <= len(plain) + 1


def test_elias_fano_round_trip():
    rng = np.random.default_rng(2)
    for values in ([0], [5, 5, 5], rng.integers(0, 2**40, 2000), rng.integers(0, 50, 3000), [0, 2**62]):
        v = np.sort(np.array(values, np.uint64))
        e = token_files.EliasFano.from_bytes(token_files.EliasFano.of(v).to_bytes())
        assert (e.values() == v).all()
        assert [e.select(i) for i in range(0, len(v), 37)] == v[::37].tolist()
    assert len(token_files.EliasFano.of(np.arange(0, 10**6, 100)).to_bytes()) < 10**4 * 10 / 8 + 300


def test_token_files(spark):
    df = docs(spark, ODD).union(spark.createDataFrame([(None, "null id", "s", 1, "x", "x", "x", "x")], DOCS))
    got = token_files.token_files(df, P.path("word_bpe_49k.json")).collect()
    by_id = {r["doc_id"]: r for r in got}
    start = by_id[None]["n_tokens"]
    assert by_id[None]["start"] == 0
    for i, ids in enumerate(expected_ids("word_bpe_49k.json", ODD, 1)):
        assert (by_id[i]["start"], by_id[i]["n_tokens"], by_id[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(df.where("false"), P.path("word_bpe_49k.json")).count() == 0


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = [*range(len(sets))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_texts():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    out = [*ODD]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 40, 150]))]
        for _ in range(r.choice([1, 3, 9])):
            copy = [*base]
            for _ in range(r.randint(0, len(base) // 10)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    texts = near_texts()
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(docs(spark, texts), size, 80).collect()}
    for i, (n, c) in enumerate(brute_components(texts, size, 80)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i)


def test_near_duplicates_of_nothing(spark):
    assert setsketch.near_duplicates(docs(spark, ODD).where("false")).count() == 0
    none = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in setsketch.near_duplicates(none).collect()) == [(0, 0, False), (1, 1, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
    n = np.array([2000.0])
    ok, j = setsketch.likely(ra[None], rb[None], n, n, 0.8)
    assert not ok[0] and j[0] == pytest.approx(1 / 3, abs=0.15)
    assert setsketch.likely(ra[None], ra[None], n, n, 0.8)[0][0]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50:90] = v[50]  # ties
    rows = [(k, v[k].tolist(), "x") for k in range(300)]
    rows += [(400, None, "x"), (401, [0.0] * 16, "x"), (402, [float("nan")] * 16, "x"), (403, [None] * 16, "x"), (404, [], "x"), (None, [1.0] * 16, "x"), (405, [1.0, 2.0], "x"), rows[60], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = ann.nearest(df, k=20).toPandas()
    d = v.astype(float)
    for q in range(0, 300, 20):
        s = np.zeros(300)
        for k in range(16):
            s += d[q, k] * d[:, k]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["vec_id"].tolist() == order and mine["score"].tolist() == s[order].tolist()
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1)")).count() == 1


def test_toxicity(spark):
    r = random.Random(6)
    words, bad = [f"word{k}" for k in range(200)], ["vileone", "viletwo", "vilethree"]
    texts, y = [], []
    for k in range(300):
        t = [r.choice(words) for _ in range(60)]
        if k % 3 == 0:
            for _ in range(r.randint(1, 6)):
                t[r.randrange(60)] = r.choice(bad)
        texts.append(" ".join(t))
        y.append(int(k % 3 == 0))
    df = docs(spark, texts + [None, "", "word1 " * 5000])
    labels = spark.createDataFrame([(k, y[k]) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    assert all(got[k]["toxic"] == bool(y[k]) for k in range(200, 300))  # held out
    assert not any(got[k]["toxic"] for k in (300, 301, 302)) and (np.diff(model.thresholds) > 0).all()
    assert toxicity.drop_toxic(df, model).count() == 203 and toxicity.drop_toxic(df, model).columns == df.columns
    assert toxicity.toxicity(df, labels.where("false")).where("toxic").count() == 0
    assert toxicity.toxicity(df.where("false"), labels).count() == 0


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_quality_rules(spark):
    r = random.Random(7)
    texts = [*ODD, "a b c d e f g h " * 3, "x\nx\ny\n \nx", "q " * 50]
    texts += [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 300))) for _ in range(40)]
    texts += [("good words of a text " + " ".join(f"w{r.randrange(500)}" for _ in range(60))) + (" ### $$$" if k % 2 else "") for k in range(200)]
    df = docs(spark, texts)
    first = len(texts) - 200
    labels = spark.createDataFrame([(first + k, 1 - k % 2) for k in range(160)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(df, labels).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n = brute_repeats(words)
        want = (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n, len(words) < 20 or 100 * n > 30 * len(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert all(got[first + k]["kept"] == (k % 2 == 0) for k in range(160, 200))  # held out
    assert quality_rules.quality_rules(df.where("false"), labels).count() == 0
    assert str(quality_rules.learn([], ["n_words"])) == "else: good"


def test_secrets(spark):
    live, example = "Zk3pW" + "aB9xQ7" * 4, "Ex4mple" + "Q1w2" * 5
    texts = [None, "", f"é password=abcdefghijkl and token: short, {live}", "AKIA" + "A1" * 8 + " " + "0f" * 10, 'api_key: "AbCdEf123456"', "password: token: abcdefghijklmnop", *[f"see {example} here {k}" for k in range(8)], "secret=" + "0f" * 12, "z " * 9000]
    df = docs(spark, texts, ["s0", "s1", "s2", "s3"])
    got = {x["doc_id"]: x for x in secrets.scan(df).collect()}
    assert got[0]["spans"] == got[1]["spans"] == "" and got[5]["spans"] == ""
    at = texts[2].index(live)
    assert got[2]["spans"] == f"assign:2:23,owned:{at}:{at + len(live)}" and got[2]["n_owned"] == 1
    assert got[3]["spans"] == "access:0:20,hex:21:41" and got[4]["n_assign"] == 1
    assert all(got[k]["spans"] == "" and got[k]["n_copied"] == 1 for k in range(6, 14))
    assert got[14]["spans"] == "assign:0:31,hex:7:31"
    out = {x["doc_id"]: x for x in secrets.redact(df).collect()}
    assert out[2]["text"] == "é <SECRET> and token: short, <SECRET>" and out[14]["text"] == "<SECRET>" and out[14]["n_chars"] == 8
    assert out[0]["text"] is None and out[6]["text"] == texts[6]
    assert secrets.scan(df.where("false")).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{k:020x}" for k in range(700))
    got = secrets.scan(docs(spark, [text])).first()["spans"]
    assert got == ",".join(f"hex:{21 * k}:{21 * k + 20}" for k in range(700))


def test_urls(spark):
    rules = [urls.Rule.of(*r.split()) for r in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8")]
    r = random.Random(8)
    pages = [("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7"), ("https://x.com/en/1", "x.com", "/en/1", "com/en/"), ("http://xcom/en/1", "xcom", "/en/1", None), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8"), ("http://h?x://y", "h", "", None), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None)]
    many = [(f"http://nice{r.randrange(50)}.net/de/{r.randrange(9)}a", None) for _ in range(150)] + [(f"http://spamfarm{r.randrange(50)}.com/en/{r.randrange(9)}", None) for _ in range(150)]
    last = [("http://spamfarm7.org/xx", None), ("http://nice7.org/xx", None)]
    rows = [(k, u, "x") for k, (u, *_) in enumerate([*pages, *many, *last])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {x["page_id"]: x for x in urls.judge_urls(df, rules).collect()}
    for k, (_, host, path, rule) in enumerate(pages):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
    assert (got[0]["verdict"], got[1]["verdict"], got[3]["verdict"], got[6]["verdict"]) == ("allow", "block", "block", "allow")
    assert (got[len(rows) - 2]["verdict"], got[len(rows) - 1]["verdict"]) == ("block", "allow")
    assert urls.judge_urls(df.where("false"), rules).count() == 0


A = 39  # symbols


def witten_bell(counts: dict[int, int]) -> list[float]:
    """P(c | a b) of all trigrams over A symbols, from their counts: the dense form of the tables of urls.log_ratios()."""
    of2: dict[int, int] = {}
    of1: dict[int, int] = {}
    for g, n in counts.items():
        of2[g % (A * A)] = of2.get(g % (A * A), 0) + n
        of1[g % A] = of1.get(g % A, 0) + n

    def contexts(grams: dict[int, int]) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        for g, n in grams.items():
            total, kinds = out.get(g // A, (0, 0))
            out[g // A] = (total + n, kinds + 1)
        return out

    def mixed(grams: dict[int, int], lower: list[float], size: int) -> list[float]:
        seen = contexts(grams)
        out = []
        for g in range(size):
            total, kinds = seen.get(g // A, (0, 0))
            below = lower[g % len(lower)]
            out.append((grams.get(g, 0) + kinds * below) / (total + kinds) if total else below)
        return out

    p1 = mixed(of1, [1.0 / A] * A, A)
    p2 = mixed(of2, p1, A * A)
    return mixed(counts, p2, A * A * A)


def test_witten_bell_sums_to_one():
    p = np.array(witten_bell({5 * A + 3: 4, 5 * A + 9: 1, 77: 2})).reshape(-1, A)
    np.testing.assert_allclose(p.sum(axis=1), 1.0)


def test_mixing(spark):
    n = 4000
    rows = [(k, "t", "hot" if k % 3 else ("a" if k % 2 else None), 1, "x", "x", "x", "x") for k in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    a = mixing.mix(df, {"hot": 1.0, "a": 3.0}, budget=3000)
    got = {r["source"]: r["count"] for r in a.groupBy("source").count().collect()}
    assert got["hot"] == pytest.approx(750, rel=0.15) and got["a"] == pytest.approx(2250, rel=0.1) and None not in got
    assert sorted(a.collect()) == sorted(mixing.mix(df.repartition(7), {"hot": 1.0, "a": 3.0}, budget=3000).collect())
    assert a.groupBy("doc_id", "replica").count().where("count > 1").count() == 0
    order = [r["doc_id"] for r in a.collect()]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.1
    assert mixing.mix(df).count() == pytest.approx(n, rel=0.1) and mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df, replica_col=None, key_col=None).columns == df.columns


def test_poisson_quantiles(spark):
    u = [(k + 0.5) / 20000 for k in range(20000)]
    df = spark.createDataFrame([(x,) for x in u], "u double").select(mixing.poisson(F.lit(2.5), F.col("u")).alias("k"))
    k = np.array([r["k"] for r in df.collect()])
    assert k.mean() == pytest.approx(2.5, abs=0.01) and k.var() == pytest.approx(2.5, abs=0.02)


def test_redact_counts_all_spans_as_scan(spark):
    value, live = "Ab3dEf6hIj9kLmNoPq" + "Z7x", "Zk3pW" + "aB9xQ7" * 4
    texts = [f"token={value}"] * 3 + [f"bare {value} here", f"bare {live} here", "none", None]
    df = docs(spark, texts, ["s0", "s1", "s2", "s3"])
    scanned = {x["doc_id"]: x["spans"] for x in secrets.scan(df).collect()}
    assert scanned[3] == "" and scanned[4] == f"owned:5:{5 + len(live)}"
    for x in secrets.redact(df).collect():
        t = texts[x["doc_id"]]
        for span in reversed([s for s in scanned[x["doc_id"]].split(",") if s]):
            a, b = map(int, span.split(":")[1:])
            t = t[:a] + secrets.MARK + t[b:]
        assert x["text"] == t
