"""Near-duplicate documents by SetSketch registers.

Sketch. A document's set holds a 64-bit hash of each distinct shingle. Register i is the least of one uniform hash of
the set's elements, taken through the exponential distribution and cut to exponentially spaced steps (base b):
K_i = floor(1 - log_b(-ln(1 - u_i) / a)), within 0 and 65535. Registers merge by their maxima, and agree more often the
more alike two sets are.

Candidates. Documents with equal sets form a class, which goes on as one node. Bands of registers put nodes into
buckets. For a pair, the counts of larger, equal and smaller registers and the set sizes, which are known, give the
likelihood of each Jaccard value (Ertl, SetSketch: Filling the Gap between MinHash and HyperLogLog, 2021); the pair is
dropped only if its best value lies below the threshold and is likelier by far (LIKELIHOOD_RATIO).

Links. First each node is held against one node of its buckets: the least of a bucket stands for it. Their sets are
compared in full, and connected nodes become components. Then the nodes of each bucket are tested across components, in
blocks of at most about BLOCK nodes a side; likely pairs put components into one cluster. Last, all likely pairs of a
cluster are compared in full, block against block of CLUSTER_BLOCK nodes, until their components are joined. Pairs
within a component, as most of a large group of near copies are by then, cost nothing, and a block returns only as many
links as join its components. No bucket, candidate or partner is capped; only pairs that differ in all bands or by the
likelihood are missed. With 32 bands of 4 registers a link at exactly 0.8 shares no band with probability below 1e-7.

Sets are 64-bit hashes, and so are class ids: the chance that two of n shingles of a pair collide is n^2 / 2^65.

Defined results: a null or empty text has an empty set and stands alone; a null id has no component and is not kept;
rows that share an id share a component only if they are linked; rows with equal texts are one class; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SegmentCache, bound_batches, only_in_worker, type_of, with_maybe, written

REGISTERS = 128
BAND = 4
BANDS = 32
BASE = 1.02
RATE = 20.0
LIKELIHOOD_RATIO = 30.0
BLOCK = 1024
CLUSTER_BLOCK = 512
CLUSTER_SHINGLES = 2 << 20
GRID = 24
CHUNK = 2048
OUT_ROWS = 2000
#: Of each of a worker's two generations of words' hashes.
WORDS_BYTES = 16 << 20

_U = np.uint64


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) | _U(1)


_TIMES, _XOR = _constants(REGISTERS, 11), _constants(REGISTERS, 12)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, size: int, cache_bytes: int = WORDS_BYTES) -> np.ndarray:
    """Sorted hashes of the distinct shingles of size words."""
    known = only_in_worker(("words", cache_bytes), lambda: SegmentCache(xxhash.xxh3_64_intdigest, cache_bytes))
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, ~_U(0))
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[at : at + CHUNK] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    u = ((least >> _U(11)).astype(float) + 0.5) / 2.0**53
    k = np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / math.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1.0) / BASE) / math.log(BASE)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of registers a and b of sets of n_a and n_b elements: may they reach the threshold, and the likeliest Jaccard value."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    most = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _p(u - v * j), _p(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1.0 - p - q, 1e-12, 1.0))

    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0.0, 1.0, GRID):
        ll = log_likelihood(share * most)
        at = np.where(ll > best, share * most, at)
        best = np.maximum(best, ll)
    held = log_likelihood(np.minimum(threshold, most))
    big = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    return big & ((at >= threshold) | (2.0 * (best - held) <= LIKELIHOOD_RATIO)), at


def _node(hashes: np.ndarray) -> int:
    """Id of the class of documents with this set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str, cache_bytes: int = WORDS_BYTES) -> DataFrame:
    """(doc_id, n_shingles, node, sig) of every row; node and sig are null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                n, node, sig = [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), size, cache_bytes)
                    n.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    sig.append(registers(s).astype("<u2").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "node", "sig"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, f"doc_id {type_of(docs, id_col)}, n_shingles long, node long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def likely_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) whose registers may reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok, j = likely(_sigs(b.column("sig_a")), _sigs(b.column("sig_b")), b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j)], ["a", "b", "jaccard"]).filter(pa.array(ok))

    of = lambda side: nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(test, "a long, b long, jaccard double")


def full_sets(wanted: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, scratch: Scratch, cache_bytes: int = WORDS_BYTES) -> DataFrame:
    """(node, members) of the nodes of wanted (node, rep), as a table in the shared folder."""
    # a filter of fixed size finds their texts without moving the others; the join below is exact
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where(F.col("rep").isNotNull())
    texts = with_maybe(texts, F.col("rep"), wanted.select("rep"), "wanted").where("wanted").select("rep", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                found = [shingle_set(t.as_py(), size, cache_bytes) for t in part.column("text")]
                node = [_node(s) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(node, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "node", "members"])

    full = texts.mapInArrow(sets, f"rep {type_of(docs, id_col)}, node long, members binary").join(wanted, ["rep", "node"], "left_semi").select("node", "members")
    return scratch.written(full.groupBy("node").agg(F.first("members").alias("members")))


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, scratch: Scratch, cache_bytes: int = WORDS_BYTES) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep"), "node")
    full = full_sets(wanted, docs, size, id_col, text_col, scratch, cache_bytes)
    # b's set is sent ahead of the sets to hold against it; one with many partners is sent to several places
    many = scratch.written(pairs.groupBy("b").agg(F.ceil(F.count("*") / 4096).cast("int").alias("places")))
    first = many.join(full, many.b == full.node).select("b", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(None).cast("long").alias("a"), "members")
    rest = pairs.select("a", "b").join(many, "b").join(full, F.col("a") == full.node).select("b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"), "a", "members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            of, a, data = b.column("b").to_pylist(), b.column("a").to_pylist(), b.column("members")
            keep = []
            for k in range(b.num_rows):
                s = np.frombuffer(data[k].as_py(), np.uint64)
                if a[k] is None:
                    key, held = of[k], s
                    continue
                if of[k] != key:
                    raise ValueError("a set is missing")
                if alike(s, held, percent):
                    keep.append((a[k], key))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([x for _, x in keep], pa.int64())], ["a", "b"])

    dealt = first.unionByName(rest).repartition("b", "place").sortWithinPartitions("b", "place", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge (a, b): the least node reachable. Large-star and small-star steps
    over edges a > b; what is joined with them by a node that may have many is a table."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = scratch.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while True:
        # the larger neighbours of b go to b's least neighbour, or stay with b if it has none that is less
        least = scratch.written(now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")))
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.written(small)
        was, seen = seen, state(now)
        if was == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = WORDS_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs; documents whose shingle sets (size words) have a
    Jaccard index of at least percent / 100 are linked; component_id is the least id reachable, which is kept."""
    bound_batches(docs.sparkSession)
    threshold = percent / 100
    scratch = Scratch(docs.sparkSession)
    rows = written(sketches(docs, size, id_col, text_col, cache_bytes))
    known = rows.where("node is not null and doc_id is not null")
    nodes = scratch.written(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    bands = [F.xxhash64(F.expr(f"substring(sig, {1 + 2 * BAND * k}, {2 * BAND})"), F.lit(k)) for k in range(BANDS)]
    dealt = nodes.select("node", F.explode(F.array(*bands)).alias("bucket"))
    shared = scratch.written(dealt.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b"))
    # all that may be linked at all; every later step reads only these
    dealt = scratch.written(dealt.join(shared, "bucket"))

    pairs = dealt.where("node != b").select(F.col("node").alias("a"), "b").distinct()
    pairs = likely_pairs(pairs, nodes, threshold)
    pairs = scratch.written(pairs.groupBy("a").agg(F.min_by("b", F.struct(F.col("jaccard") < threshold + 0.03, "b")).alias("b")))
    links = scratch.written(verified(pairs, nodes, docs, size, percent, id_col, text_col, scratch, cache_bytes))
    found = components(links, scratch)

    near = scratch.written(_likely_links(dealt, found, nodes, threshold, scratch))
    links = links.union(_cluster_links(links, near, found, nodes, docs, size, percent, id_col, text_col, scratch, cache_bytes))
    found = components(links, scratch)

    # what a component, or a text, with many rows is joined with is a table each time
    firsts = scratch.written(found.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("component_id")))
    found = found.join(firsts, "component").select("node", "component_id")
    ids = written(nodes.select("node", "rep").join(found, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
    scratch.remove()
    linked = known.select("doc_id", "n_shingles", "node").join(ids, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("doc_id", id_col)


class Joined:
    """Sets of components that have been joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _open_pairs(t: pa.Table, left: np.ndarray, right: np.ndarray, within: bool, threshold: float, joined: Joined) -> Iterator[tuple[int, int]]:
    """Places (i, j) of likely pairs of components that are still apart when the pair comes up."""
    node, comp, n = (t.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    sig = _sigs(t.column("sig").combine_chunks())
    kinds, kind = np.unique(comp, return_inverse=True)
    for at in range(0, len(left), 64):
        part = left[at : at + 64, None]
        roots = np.array([joined.root(c) for c in kinds.tolist()])[kind]
        apart = (roots[part] != roots[right]) & (np.minimum(n[part], n[right]) >= threshold * np.maximum(n[part], n[right]) - 1e-9)
        if within:
            apart &= node[part] > node[right]
        rows, cols = np.nonzero(apart)
        for k in range(0, len(rows), 4096):
            i, j = part[rows[k : k + 4096], 0], right[cols[k : k + 4096]]
            roots = np.array([joined.root(c) for c in kinds.tolist()])[kind]
            still = roots[i] != roots[j]
            i, j = i[still], j[still]
            if len(i):
                ok, jaccard = likely(sig[i], sig[j], n[i], n[j], threshold)
                order = np.flatnonzero(ok)[np.argsort(-jaccard[ok], kind="stable")]
                for x, y in zip(i[order].tolist(), j[order].tolist()):
                    if joined.root(int(comp[x])) != joined.root(int(comp[y])):
                        yield x, y


def _tiles(rows: DataFrame, key: str, blocks, *columns: str) -> DataFrame:
    """rows dealt to (key, x, y) for x <= y of the blocks of a key: each row meets all others of its key, itself once."""
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    to = F.transform(F.sequence(F.lit(0), blocks - 1), lambda y: F.struct(F.least(own, y).alias("x"), F.greatest(own, y).alias("y"), (y < own).cast("int").alias("side")))
    return rows.select(key, *columns, F.explode(to).alias("t")).select(key, "t.x", "t.y", "t.side", *columns)


def _spread(tiles: DataFrame, *keys: str) -> DataFrame:
    """tiles by keys in as many partitions as shuffles have: what a tile costs is comparisons, not the bytes by which
    Spark would put partitions together."""
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _sides(key, t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    if key[1].as_py() == key[2].as_py():
        return np.arange(t.num_rows), np.arange(t.num_rows), True
    side = t.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _likely_links(dealt: DataFrame, found: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): of each bucket as many likely pairs of nodes of different components as join all that are likely."""
    named = dealt.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("kinds")).where("kinds > 1")
    sizes = scratch.written(sizes)
    rows = named.join(sizes, "bucket").join(nodes.select("node", "n_shingles", "sig"), "node")
    main, rest = (F.ceil(n / BLOCK).cast("int") for n in (F.col("n_main"), F.col("n_all") - F.col("n_main")))
    row = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    # the largest component's blocks meet the others' blocks (x < 0), and these meet each other (x >= 0)
    of_main = F.transform(F.sequence(F.lit(0), rest - 1), lambda y: F.struct((-1 - row(main)).alias("x"), y.alias("y"), F.lit(0).alias("side")))
    to_main = F.transform(F.sequence(F.lit(0), main - 1), lambda x: F.struct((-1 - x).alias("x"), row(rest).alias("y"), F.lit(1).alias("side")))
    to_rest = F.transform(F.sequence(F.lit(0), rest - 1), lambda y: F.struct(F.least(row(rest), y).alias("x"), F.greatest(row(rest), y).alias("y"), (y < row(rest)).cast("int").alias("side")))
    tiles = rows.select("bucket", "node", "component", "n_shingles", "sig", F.explode(F.when(F.col("component") == F.col("main"), of_main).otherwise(F.concat(to_main, to_rest))).alias("t"))
    tiles = tiles.select("bucket", "t.x", "t.y", "t.side", "node", "component", "n_shingles", "sig")

    def test(key, t):
        joined, out = Joined(), []
        node, comp = t.column("node").to_pylist(), t.column("component").to_pylist()
        left, right, within = _sides(key, t)
        for i, j in _open_pairs(t, right, left, within, threshold, joined):
            joined.join(comp[i], comp[j])
            out.append((node[i], node[j]))
        return _pairs(out)

    return _spread(tiles, "bucket", "x", "y").groupBy("bucket", "x", "y").applyInArrow(test, "a long, b long").distinct()


def _cluster_links(links: DataFrame, near: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, scratch: Scratch, cache_bytes: int) -> DataFrame:
    """(a, b): links that join all components that are linked within a cluster. Clusters are what links and likely
    links connect; each block of a cluster meets each other one with full sets."""
    threshold = percent / 100
    clusters = components(links.union(near), scratch).select("node", F.col("component").alias("cluster"))
    named = clusters.join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
    every = scratch.written(named.join(nodes.select("node", "rep", "n_shingles", "sig"), "node"))
    # blocks are bounded by nodes and by what their sets hold
    blocks = F.ceil(F.greatest(F.count("*") / CLUSTER_BLOCK, F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int")
    sizes = every.groupBy("cluster").agg(blocks.alias("blocks"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("cluster", "blocks")
    sizes = scratch.written(sizes)
    rows = every.join(sizes, "cluster")
    rows = rows.join(full_sets(rows.select("node", "rep"), docs, size, id_col, text_col, scratch, cache_bytes), "node")
    tiles = _tiles(rows, "cluster", F.col("blocks"), "node", "component", "n_shingles", "sig", "members")

    def test(key, t):
        joined, out = Joined(), []
        node, comp = t.column("node").to_pylist(), t.column("component").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("members")]
        left, right, within = _sides(key, t)
        for i, j in _open_pairs(t, left, right, within, threshold, joined):
            if alike(sets[i], sets[j], percent):
                joined.join(comp[i], comp[j])
                out.append((node[i], node[j]))
        return _pairs(out)

    return scratch.written(_spread(tiles, "cluster", "x", "y").groupBy("cluster", "x", "y").applyInArrow(test, "a long, b long").distinct())
