"""Vector codes, periodic runs and SimHash links against brute force, with the odd cases, and their SQL on the tables."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

pytest.importorskip("public_tokenizers")

from panelspark.llm import periodic, simhash, vector_codes  # noqa: E402
from panelspark.llm.common import Scratch  # noqa: E402
from panelspark.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@tables
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_periodic_runs"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert got and sorted(map(tuple, df.collect()), key=repr) == sorted(got, key=repr)


# vector codes


def brute_codes(rows, entries=256, parts=4, rounds=4):
    """rows (id, vector, label) -> {(id, vector): (code, error)} and the codebooks, in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[max(-(1 << 24), min(1 << 24, int(np.floor(max(-2.0**30, min(2.0**30, x)) * 1024)))) for x in r[1]] for r in kept]
    n = len(whole[0])
    cut = [slice(p * n // parts, (p + 1) * n // parts) for p in range(parts)]
    books = [[w[c] for w in whole[:entries]] for c in cut]

    def assign(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, c in enumerate(cut):
            found = [assign(w[c], books[p])[1] for w in whole]
            for k in set(found):
                mine = [w[c] for w, f in zip(whole, found) if f == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for r, w in zip(kept, whole):
        best = [assign(w[c], books[p]) for p, c in enumerate(cut)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), r[2]))
    said = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(said.encode()).hexdigest()


def expected(rows, **more):
    out, said = brute_codes(rows, **more)
    by = {}
    for _, _, error, label in out:
        by[label] = by.get(label, 0) + error
    return sorted(((i, code, error, by[label], said) for i, code, error, label in out), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, code string, n int"


def vector_rows(seed, n, dims):
    r = np.random.default_rng(seed)
    v = (r.integers(-4, 5, (n, dims)) / 8).astype(np.float32).tolist()  # many ties
    return [(int(k), v[k], None if k % 7 == 0 else int(k % 3), "x", "x", "x", 1) for k in range(n)]


@pytest.mark.parametrize("dims", [8, 10, 3])
def test_vector_codes(spark, dims):
    rows = vector_rows(1, 150, dims)
    rows += rows[:5] + [(3, rows[80][1], 1, "x", "x", "x", 1), (None, rows[9][1], None, "x", "x", "x", 1), (900, None, 1, "x", "x", "x", 1), (-1, [None] * dims, 1, "x", "x", "x", 1), (901, [float("nan")] * dims, 1, "x", "x", "x", 1), (902, [3e38] * dims, 1, "x", "x", "x", 1), (-5, [-float("inf")] * dims, 1, "x", "x", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = vector_codes.compress(df, entries=40)
    assert sorted(map(tuple, got.collect()), key=repr) == expected([r[:3] for r in rows], entries=40)


def test_vector_codes_of_odd_tables(spark):
    df = spark.createDataFrame(vector_rows(2, 30, 4), SCHEMA)
    assert vector_codes.compress(df.where("false")).collect() == []
    other = [(k, [0.5 * k, 1.0], 1, "x", "x", "x", 1) for k in range(100, 105)] + [(200, [], 1, "x", "x", "x", 1)]
    got = sorted(map(tuple, vector_codes.compress(df.union(spark.createDataFrame(other, SCHEMA))).select("vec_id", "code", "error", "codebooks_sha256").collect()))
    want = []
    for rows in (vector_rows(2, 30, 4), other[:5], other[5:]):
        out, said = brute_codes([r[:3] for r in rows])
        want += [(i, code, error, said) for i, code, error, _ in out]
    assert got == sorted(want)


def test_the_tree_loses_nothing_and_prunes():
    r = np.random.default_rng(3)
    centres = r.integers(-400, 400, (12, 16))
    book = centres[r.integers(0, 12, 256)] + r.integers(-20, 20, (256, 16))
    book[200:210] = book[:10]  # equal entries
    parts = np.concatenate([centres[r.integers(0, 12, 5000)] + r.integers(-25, 25, (5000, 16)), book])
    tree = vector_codes.Tree(book)
    index, best = tree.nearest(parts)
    squares = np.square(parts[:, None, :] - book).sum(axis=2)
    assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
    assert tree.compared < 0.5 * squares.size


# periodic runs


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        words = [r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("abcxyz") for _ in range(r.randint(1, 40))]
            words += (unit * r.randint(2, 9))[: r.randint(1, 300)]
        yield words


def test_runs_are_those_of_brute_force():
    for words in texts(4, 400):
        assert periodic.runs_of(words) == brute_runs(words)
    for words in (["a"] * 3000, ["a", "b"] * 700 + ["c"] + ["a", "b"] * 700, list("abcabcabcabc" * 30 + "x" + "abcabd" * 40)):
        assert periodic.runs_of(words) == brute_runs(words)


def test_long_periods():
    unit = [f"w{k}" for k in range(1000)]
    words = [f"u{k}" for k in range(777)] + unit * 5 + unit[:123] + [f"v{k}" for k in range(500)]
    assert periodic.runs_of(words) == [(777, 5123, 1000)]
    assert periodic.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]


def test_periodic_query(spark):
    odd = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x y x y x y x y", "no period here at all", "a b " * 2000, "É 日 É 日 É 日 É 日 É 日"] + [" ".join(w) for w in texts(5, 60)]
    rows = [(i, t, "x", 0) for i, t in enumerate(odd)] + [(None, odd[6], "x", 0), (3, odd[3], "x", 0), (70, "p q r s t u v w x y z " * 9, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = {}
    for r in periodic.periodic_runs(df, plant=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    ends = 0
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            ends, g, n = ends + 1, h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        r = got[i][0]
        assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == kept.decode() and (r["n_words"], r["n_runs"]) == (len(words), len(runs))
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert ends and sum(map(len, got.values())) == len(rows)
    assert periodic.periodic_runs(df.where("false")).count() == 0


# SimHash


def brute_fingerprint(text, size=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (doc_id, fingerprint) a row -> component_id a row."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[root(k)] = min((x for x in (i, least.get(root(k))) if x is not None), default=None)
    return [least[root(k)] for k in range(len(prints))]


def test_simhash(spark):
    r = random.Random(6)
    vocabulary = [f"Word{k}" for k in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(40, 400))] for _ in range(12)]
    all_texts = [None, "", " \t", "one", "One two", "one TWO", "İ É ß a"] + [" ".join(b) for b in bases]
    for b in bases:
        for _ in range(12):
            w = list(b)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            all_texts.append(" ".join(w))
    rows = [(i, t, "x", 0) for i, t in enumerate(all_texts)] + [(None, all_texts[9], "x", 0), (None, "quite alone here", "x", 0), (8, all_texts[8], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, cell int").repartition(3)
    got = sorted(map(tuple, simhash.simhash_duplicates(df).collect()), key=repr)
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))), key=repr)
    assert got == want and len({c for *_, c in want}) < len(want) - 20
    assert simhash.simhash_duplicates(df.where("false")).count() == 0


def node(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("width,full", [(2, 64), (2, 4), (4, 3), (8, 64)])
def test_links_connect_all_near_fingerprints(spark, width, full):
    r = random.Random(7)
    found = {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        found.add(x)
        for _ in range(12):  # walks of 2 or 3 bits
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                x ^= 1 << b
            found.add(x)
    x = r.getrandbits(64)  # a crowd in few cells
    found |= {x ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    found = sorted(found)
    want = brute_components(list(enumerate(found)))
    scratch = Scratch(spark)
    nodes = spark.createDataFrame([(node(x),) for x in found], "node long")
    pairs = [(r["a"], r["b"]) for r in simhash.links(nodes, scratch, width, full).collect()]
    place = {node(x): k for k, x in enumerate(found)}
    up = list(range(len(found)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
        i, j = sorted((root(place[a]), root(place[b])))
        up[j] = i
    assert [root(k) for k in range(len(found))] == want
    scratch.remove()
