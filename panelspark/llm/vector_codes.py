"""Vector codes: each of a vector's equal parts is named by its nearest codebook entry, in whole numbers throughout.

Components become floor(1024 * x). A part position's codebook starts as that part of the vectors with the least ids.
Each round assigns every part to the nearest entry and replaces an entry by the floored means of its parts. Then parts
are assigned for the last time.

Nearest entries are found in a vantage-point tree over the entries of each part position: a node holds an entry and, for
its nearer and its farther half, the least and the greatest distance from that entry. By the triangle inequality a half
is left out only if it cannot hold an entry as near as the best so far. These bounds are rounded outwards (SLACK), and
halves that may only tie are visited, so that the search loses nothing; what is compared are exact squared distances in
64-bit integers, ties to the lower index. A batch of vectors walks the tree together, each by its own order of halves.

Codebooks, the only thing all tasks share, are at most 256 x the vector's length whole numbers, whatever the input. A
task adds up its parts by entry before anything is shuffled, and the input is read once a round, never moved. The sums of
labels are broadcast only where labels are numbers and few (MOST_BROADCAST), else joined.

Defined results: vectors that are null or hold null or non-finite components are dropped; of one vector length, codebooks
are filled by the rows with the least ids, null ids last, equal ids by their vectors; fewer rows than entries give
fewer entries; unused entries stay as they were. Vectors of another length have codebooks of their own; a length that is no
multiple of the parts is cut at floor(part * length / parts), and an empty part has code 0 and error 0. Components beyond
2^24 in size (x beyond 16,384) count as 2^24; an error or sum that no long holds is the greatest long. Repeated rows are
rows; null labels are one label; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import by_length
from .common import bound_batches, type_of, written

SCALE = 1024
LARGEST = 1 << 24
LEAF = 16
SLACK = 1e-12
ROWS = 4096
MOST_BROADCAST = 20_000
MOST_LONG = (1 << 63) - 1
_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x), within LARGEST."""
    return np.clip(np.floor(np.clip(vectors.astype(float), -LARGEST, LARGEST) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def cuts(length: int, parts: int) -> list[slice]:
    return [slice(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


class Tree:
    """A vantage-point tree over a codebook's entries (rows of whole numbers)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.compared = 0
        self.root = self._grow(np.arange(len(book)))

    def _grow(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        first = np.square(self.book[at] - self.book[at[0]]).sum(axis=1)
        vantage = at[first.argmax()]
        rest = at[at != vantage]
        far = np.sqrt(np.square(self.book[rest] - self.book[vantage]).sum(axis=1))
        order = far.argsort(kind="stable")
        half = len(rest) // 2
        halves = []
        for part in (order[:half], order[half:]):
            bounds = far[part].min() * (1 - SLACK), far[part].max() * (1 + SLACK)
            halves.append((*bounds, self._grow(np.sort(rest[part]))))
        return vantage, far[order[half]], halves

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, and its squared distance."""
        index, best = np.zeros(len(parts), np.int64), np.full(len(parts), MOST_LONG)
        for at in range(0, len(parts), ROWS):
            some = slice(at, at + ROWS)
            self._visit(self.root, parts[some], np.arange(len(parts[some])), index[some], best[some])
        return index, best

    def _offer(self, entries: np.ndarray, q: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Compares rows of q with entries (ascending); the squared distances to the first."""
        self.compared += len(rows) * len(entries)
        squares = np.square(q[rows][:, None, :] - self.book[entries]).sum(axis=2)
        at = squares.argmin(axis=1)
        least, which = squares[np.arange(len(rows)), at], entries[at]
        nearer = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
        best[rows[nearer]], index[rows[nearer]] = least[nearer], which[nearer]
        return squares[:, 0]

    def _visit(self, node, q: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            self._offer(node, q, rows, index, best)
            return
        vantage, middle, halves = node
        away = np.sqrt(self._offer(np.array([vantage]), q, rows, index, best))
        for side, order in ((away < middle, halves), (away >= middle, halves[::-1])):
            some, d = rows[side], away[side]
            for low, high, child in order:
                reach = np.sqrt(best[some]) * (1 + SLACK)
                may = (d * (1 + SLACK) + reach >= low) & (d * (1 - SLACK) - reach <= high)
                self._visit(child, q, some[may], index, best)


Books = dict[int, list[np.ndarray]]


def first_books(rows: DataFrame, entries: int, parts: int) -> Books:
    """Codebooks of each vector length, from the rows (id, v) with the least ids."""
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    books: Books = {}
    for n in lengths:
        first = rows.where(F.size("v") == n).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        vectors = whole(np.array([r["v"] for r in first], float).reshape(len(first), n))
        books[n] = [vectors[:, cut] for cut in cuts(n, parts)]
    return books


def next_books(rows: DataFrame, books: Books) -> Books:
    """Codebooks after a round: each entry the floored means of the parts that are nearest to it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {n: [Tree(b) for b in of] for n, of in books.items()}
        sums = {n: [np.zeros_like(b) for b in of] for n, of in books.items()}
        counts = {n: [np.zeros(len(b), np.int64) for b in of] for n, of in books.items()}
        for b in batches:
            for _, v in by_length(b.column(0)) if b.num_rows else ():
                n, v = v.shape[1], whole(v)
                for p, cut in enumerate(cuts(n, len(books[n]))):
                    index, _ = trees[n][p].nearest(v[:, cut])
                    np.add.at(sums[n][p], index, v[:, cut])
                    counts[n][p] += np.bincount(index, minlength=len(counts[n][p]))
        out = [(n, p, e, int(counts[n][p][e]), sums[n][p][e].tolist()) for n in books for p in range(len(books[n])) for e in np.flatnonzero(counts[n][p]).tolist()]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["n", "part", "entry", "count", "sums"])

    found = rows.select("v").mapInArrow(add, "n int, part int, entry int, count long, sums array<long>")
    found = found.select("n", "part", "entry", "count", F.posexplode("sums").alias("place", "sum"))
    found = found.groupBy("n", "part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    out = {n: [b.copy() for b in of] for n, of in books.items()}
    for r in found.collect():
        out[r["n"]][r["part"]][r["entry"], r["place"]] = r["sum"] // r["count"]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codebooks(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> Books:
    """The final codebooks by vector length: a list of arrays, one a part position."""
    bound_batches(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col)
    books = first_books(rows, entries, parts)
    for _ in range(rounds if books else 0):
        books = next_books(rows, books)
    return books


def _rows(vectors: DataFrame, id_col: str, vector_col: str, *more) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).alias("id"), *more)
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", bad))


def encoded(vectors: DataFrame, books: Books, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of every vector kept."""
    digests = {n: digest(of) for n, of in books.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {n: [Tree(b) for b in of] for n, of in books.items()}
        for b in batches:
            for at, v in by_length(b.column(0)) if b.num_rows else ():
                n, v = v.shape[1], whole(v)
                codes, error = np.zeros((len(v), len(trees[n])), np.int64), np.zeros(len(v))
                total = np.zeros(len(v), np.int64)
                for p, cut in enumerate(cuts(n, len(trees[n]))):
                    codes[:, p], squares = trees[n][p].nearest(v[:, cut])
                    total += squares
                    error += squares
                total[error >= float(MOST_LONG)] = MOST_LONG
                rows = pa.array(at)
                digits = max(2, *(len(f"{len(t.book) - 1:x}") for t in trees[n]))
                text = pa.array(["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(rows), b.column(2).take(rows), text, pa.array(total), pa.array([digests[n]] * len(v), pa.string())],
                    ["id", "label", "code", "error", "codebooks_sha256"],
                )

    rows = _rows(vectors, id_col, vector_col, F.col(label_col).alias("label"))
    return rows.mapInArrow(assign, f"id {type_of(vectors, id_col)}, label {type_of(vectors, label_col)}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector kept."""
    books = codebooks(vectors, entries, parts, rounds, id_col, vector_col)
    coded = written(encoded(vectors, books, id_col, vector_col, label_col))
    most = F.lit(MOST_LONG).cast("decimal(38,0)")
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    labels = written(labels)
    if type_of(coded, "label") in _FIXED and labels.count() <= MOST_BROADCAST:
        labels = F.broadcast(labels)
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
