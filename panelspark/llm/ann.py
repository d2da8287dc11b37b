"""Exact nearest neighbours by inner product, pruned by int8 product tiles.

Vectors are quantised to int8, a scale each: x = s.a + e. Tiles of products of query and candidate codes (exact
integers, by float matrix products of at most 1024 dimensions at a time) give s_q.s_c.(a_q.a_c), which lies within
|q^|.|e_c| + |e_q|.|c| of the inner product (Cauchy-Schwarz; q^ = s_q.a_q). A pair survives unless its upper bound lies
below the k-th best lower bound of the tile or the k-th best score so far. Survivors are recomputed in double precision
from the original vectors, dimension after dimension, and go to a bounded heap for each query. So the result is exact.

Candidates are never shuffled: a task keeps those that it scans, up to STRIPE_BYTES at a time, and streams past them
the queries, which are stored once as a table in the shared folder, in blocks of QUERY_BLOCK. Memory is a stripe and a
block, whatever the input. What moves is the k best of each query and stripe; they are merged by query, again by heaps.
Of equal vectors of a stripe only those with the k + 1 smallest ids (one may be the query's own) can be among the k
nearest; the others are left out of the tiles, so that a vector that a third of all rows share costs no more than others.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
with a null id; vectors of different lengths are no candidates for each other; equal rows (id and vector) count once;
rows that share an id, but not the vector, are each a query with a list of its own, and each a candidate of queries of
other ids; equal scores go to the smaller id; scores that overflow are infinite, and those that are no number come
last; fewer candidates than k are all returned; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, type_of

DIMS = 1024
ROWS = 256
BATCH = 4096
QUERY_BLOCK = 2048
STRIPE_BYTES = 128 << 20
OUT_ROWS = 10_000
MOST = np.finfo(float).max
TINY = np.finfo(float).tiny
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    """Vectors of one length, quantised. marks: what tells rows with equal ids apart."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray):
        self.ids, self.marks, self.vectors = ids, marks, vectors
        top = np.abs(vectors).max(axis=1).astype(float)
        unit = vectors / top[:, None]  # within 1, so that squares do not overflow
        self.scale = np.maximum(top / 127.0, TINY)
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        near = self.codes * (self.scale / top)[:, None]
        up = top * (1.0 + 1e-9)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(np.square(unit).sum(axis=1)) * up
            self.near_norm = np.sqrt(np.square(near).sum(axis=1)) * up
            self.error = np.sqrt(np.square(unit - near).sum(axis=1)) * up + 1e-12 * self.norm

    def __len__(self) -> int:
        return len(self.ids)


def tile(q: Block, c: Block, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of some queries with all candidates, within the finite numbers, and how far off they
    may be (never NaN)."""
    out = np.zeros((len(q.codes[rows]), len(c)))
    for at in range(0, q.codes.shape[1], DIMS):  # int8 products of 1024 dimensions sum to whole numbers below 2^24
        out += q.codes[rows, at : at + DIMS].astype(np.float32) @ c.codes[:, at : at + DIMS].astype(np.float32).T
    with np.errstate(over="ignore", invalid="ignore"):
        out *= q.scale[rows, None]
        out *= c.scale
        np.clip(out, -MOST, MOST, out=out)
        far = q.near_norm[rows, None] * c.error + q.error[rows, None] * c.norm
        far += 1e-9 * q.norm[rows, None] * c.norm + TINY
        far[np.isnan(far)] = np.inf
    return out, far


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision, summed from the first dimension to the last."""
    out = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(q.shape[1]):
            out += q[:, k].astype(float) * c[:, k].astype(float)
    return out


class Heaps:
    """For each query of a block the k best (order, -id, mark, score) so far; order is the score, or least if it is NaN."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int, int, float]]] = [[] for _ in queries.ids]
        self.bar = np.full(len(queries), -np.inf)

    def offer(self, c: Block) -> None:
        k = self.k
        for at in range(0, len(self.q), ROWS):
            rows = slice(at, at + ROWS)
            near, far = tile(self.q, c, rows)
            other = self.q.ids[rows, None] != c.ids
            bar = self.bar[rows]
            if near.shape[1] > k:
                lower = np.where(other, near - far, -np.inf)
                bar = np.maximum(bar, np.partition(lower, -k, axis=1)[:, -k])
            i, j = np.nonzero(other & (near + far >= bar[:, None]))
            i += at
            for part in range(0, len(i), 1 << 17):
                self._keep(i[part : part + (1 << 17)], j[part : part + (1 << 17)], c)

    def _keep(self, i: np.ndarray, j: np.ndarray, c: Block) -> None:
        score = exact(self.q.vectors[i], c.vectors[j])
        rank = np.where(np.isnan(score), -np.inf, score)
        order = np.lexsort((c.ids[j], -rank, i))
        i, j, score, rank = i[order], j[order], score[order], rank[order]
        first = np.searchsorted(i, i, side="left")
        keep = (np.arange(len(i)) - first < self.k) & (rank >= self.bar[i])
        for row, *entry in zip(i[keep].tolist(), rank[keep].tolist(), (-c.ids[j[keep]]).tolist(), c.marks[j[keep]].tolist(), score[keep].tolist()):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, tuple(entry))
            else:
                heapq.heappushpop(heap, tuple(entry))
            if len(heap) == self.k:
                self.bar[row] = heap[0][0]

    def found(self) -> pa.RecordBatch:
        rows = [(row, query, -x, mark, s) for row, query, heap in zip(self.q.marks.tolist(), self.q.ids.tolist(), self.heaps) for _, x, mark, s in heap]
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows) if rows else [[]] * len(FOUND), FOUND.types)], schema=FOUND)


def marks_of(vectors: np.ndarray) -> np.ndarray:
    """A hash of each vector."""
    bits = np.ascontiguousarray(vectors).view(np.uint64 if vectors.itemsize == 8 else np.uint32).astype(np.uint64)
    odd = np.random.default_rng(7).integers(1, 1 << 63, vectors.shape[1], dtype=np.uint64) | np.uint64(1)
    mark = np.zeros(len(vectors), np.uint64)
    for d in range(bits.shape[1]):
        mark = (mark ^ (mark >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + bits[:, d] * odd[d]
    return mark.view(np.int64)


def needed(ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows but of repeated ones, and of those whose vector k + 1 smaller ids have, too."""
    order = np.lexsort((ids, marks))
    m, x = marks[order], ids[order]
    begins = np.concatenate([[True], m[1:] != m[:-1]])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(m)), 0))
    fresh = begins | np.concatenate([[True], x[1:] != x[:-1]])
    smaller = np.cumsum(fresh) - 1
    spare = np.flatnonzero(~fresh | (smaller - smaller[first] > k))
    spare = spare[(vectors[order[spare]] == vectors[order[first[spare]]]).all(axis=1)]  # equal marks may be chance
    return np.sort(np.delete(order, spare))


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat components and the places of each vector's begin, with the end of the last."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length."""
    flat, ends = vectors_of(column)
    lengths = np.diff(ends)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[ends[at][:, None] + np.arange(n)]


def stored(uri: str) -> Iterator[pa.RecordBatch]:
    """The query table's rows, in blocks."""
    fs, path = pafs.FileSystem.from_uri(uri)
    found = pads.dataset(path, filesystem=fs, format="parquet")
    yield from found.to_batches(batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by every, its k nearest among all others."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    queries = shared_folder(vectors.sparkSession)
    rows.where(F.col("id") % every == 0).distinct().select(F.monotonically_increasing_id().alias("query"), "id", "v").write.parquet(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            stripe: dict[int, list[Block]] = {}
            for n, parts in held.items():
                ids, v = (np.concatenate(x) for x in zip(*parts))
                marks = marks_of(v)
                some = needed(ids, marks, v, k)
                stripe[n] = [Block(ids[at], marks[at], v[at]) for at in (some[b : b + BATCH] for b in range(0, len(some), BATCH))]
            held.clear()
            size = 0
            if stripe:
                for b in stored(queries):
                    for at, v in by_length(b.column("v")):
                        heaps = Heaps(Block(b.column("id").to_numpy()[at], b.column("query").to_numpy()[at], v), k)
                        for c in stripe.get(v.shape[1], ()):
                            heaps.offer(c)
                        yield heaps.found()

        for b in batches:
            ids = b.column(0).to_numpy()
            for at, v in by_length(b.column(1)) if b.num_rows else ():
                held.setdefault(v.shape[1], []).append((ids[at], v))
                size += v.nbytes
            if size >= STRIPE_BYTES:
                yield from flush()
        yield from flush()

    best = rows.mapInArrow(search, "query long, query_id long, id long, mark long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: tuple[int, int] | None = None
        heap: list[tuple[float, int, int, float]] = []
        done: list[tuple[int, int, int, float]] = []

        def close() -> None:
            done.extend((query[1], r, -x, s) for r, (_, x, _, s) in enumerate(sorted(heap, key=lambda e: (-e[0], -e[1], e[2])), 1))

        def packed() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], ["query_id", "rank", "id", "score"])

        for b in batches:
            for row, q, x, mark, s in zip(*(b.column(c).to_pylist() for c in FOUND.names)):
                if query is None or row != query[0]:
                    if heap:
                        close()
                    query, heap = (row, q), []
                entry = (s if s == s else -np.inf, -x, mark, s)
                if any(entry[:3] == e[:3] for e in heap):  # a repeated row of another stripe
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
            if len(done) >= OUT_ROWS:
                yield packed()
                done.clear()
        if heap:
            close()
        if done:
            yield packed()

    merged = best.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query_id long, rank int, id long, score double")
    return merged.select("query_id", "rank", F.col("id").cast(type_of(vectors, id_col)).alias(id_col), "score")
