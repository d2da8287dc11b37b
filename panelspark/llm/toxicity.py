"""Toxicity severity by cumulative-link ordinal regression.

P(severity >= k) = sigmoid(w.x - t_k) for k = 1..GRADES: one weight vector, ordered thresholds t_1 < t_2 < ...; the
expected severity is the sum of these. x holds log(1 + count) of sparse text features: words, and their first four and
five letters, which inflected forms share.

Training takes at most max_train labelled rows of each class (those with the least hashes of id and text; equal rows
once). A feature is kept if its document frequency differs between the classes far beyond chance; only the counts of
such features in these rows come to the driver. Rows fall in FOLDS parts by their hash. For each part, features are
chosen and a model of one threshold is fitted on the others, and the part is scored by it. Labels say toxic or not: the
severity of a toxic row in training is 1, 2 or 3 by the terciles of that score for each unit of log(1 + words), which a
model that has not seen the row gives, so that it is not what the row's own weights repeat, nor the text's length. The
cut on P(severity >= 1) is where ordinal models, fitted likewise, lose least on the parts they have not seen, clean
documents counting CLEAN_LOST times. The model that is used is then fitted on all rows, with features chosen on all.
Fits take accelerated gradient steps with an L2 penalty; all features of all rows are held as triples.

Defined results: a null or empty text has no features, and so the severity of the thresholds alone; a null id is
scored and returned; repeated rows are scored each; labels that are null take no part, and of several for one id the
largest counts; with fewer than two rows of either class in and out of each part nothing is toxic; a tie at the cut is
toxic; other columns are not read (drop_toxic keeps them as they are); an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, SegmentCache, bound_batches, column_place, only_in_worker, type_of, written

GRADES = 3
WORD = re.compile(r"\w+")
TEXTS = 500
FOLDS = 5
LEAST_GAP = 1e-3
#: How much worse it is to reject a share of the clean documents than to miss that share of the toxic ones.
CLEAN_LOST = 5.0


def features_of(part: str) -> tuple[int, ...]:
    """Hashes of the features of a piece of text without white space."""
    out = []
    for w in WORD.findall(part):
        out.append(f"w {w}")
        if len(w) > 4:
            out.append(f"4 {w[:4]}")
        if len(w) > 5:
            out.append(f"5 {w[:5]}")
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in out)


def counted(text: str | None, cache: SegmentCache) -> Counter:
    """Features of a whole text and their counts; the cache says which of a piece's features count."""
    found: Counter = Counter()
    for piece in filter(None, map(cache.__getitem__, (text or "").lower().split())):
        found.update(piece)
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """features: hash -> column. key: a name of its own, by which workers keep its cache from task to task."""

    features: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5
    key: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False, compare=False)
    _cache: SegmentCache | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": None}

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(severity >= k) for k = 1..GRADES, a column each."""
        return _sigmoid(np.asarray(margin)[:, None] - self.thresholds)

    def cache(self, cache_bytes: int = CACHE_BYTES) -> SegmentCache:
        known = self.features
        return SegmentCache(lambda part: tuple(known[h] for h in features_of(part) if h in known), cache_bytes)

    def in_worker(self, cache_bytes: int) -> OrdinalModel:
        """The model with the cache of this worker."""
        self._cache = only_in_worker(("toxicity", self.key, cache_bytes), lambda: self.cache(cache_bytes))
        return self

    def margin(self, text: str | None) -> float:
        if self._cache is None:
            self._cache = self.cache()
        found = counted(text, self._cache)
        return float(sum(self.weights[k] * np.log1p(n) for k, n in sorted(found.items())))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, P(severity >= 1) and the likeliest grade."""
        p = self.at_least(np.array([self.margin(t) for t in texts]))
        each = np.concatenate([np.ones((len(p), 1)), p], axis=1) - np.concatenate([p, np.zeros((len(p), 1))], axis=1)
        return p.sum(axis=1), p[:, 0], each.argmax(axis=1)


class Sparse:
    """A matrix of (row, column, value) triples."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    @classmethod
    def of(cls, rows: list[dict[int, int]], columns: dict[int, int]) -> Sparse:
        """log(1 + count) of the features that have a column."""
        found = [(i, columns[h], n) for i, r in enumerate(rows) for h, n in r.items() if h in columns]
        row, column, n = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        return cls(row, column, np.log1p(n), (len(rows), len(columns)))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * e[self.row], self.shape[1])


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int = GRADES, penalty: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; rows of each class count alike in sum."""
    d = x.shape[1]
    positive = grade > 0
    row = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    reached = (grade[:, None] >= np.arange(1, grades + 1)).astype(float)
    # thresholds as the first one and the gaps between them, which stay at LEAST_GAP or more
    z = np.zeros(d + grades)
    z[d:] = 1.0

    def thresholds(v):
        return np.cumsum(v[d:])

    def gradient(v):
        err = (_sigmoid(x.times(v[:d])[:, None] - thresholds(v)) - reached) * row[:, None]
        by_threshold = -err.sum(axis=0)
        g = np.empty_like(v)
        g[:d] = x.transposed_times(err.sum(axis=1)) + penalty * v[:d]
        g[d:] = by_threshold[::-1].cumsum()[::-1]
        return g

    square = np.bincount(x.row, np.square(x.value), x.shape[0])
    rate = 1.0 / (0.25 * grades * (square @ row + grades) + penalty)
    before, y, momentum = z.copy(), z.copy(), 1.0
    for _ in range(steps):
        z = y - rate * gradient(y)
        z[d + 1 :] = np.maximum(z[d + 1 :], LEAST_GAP)
        nxt = 0.5 * (1.0 + np.sqrt(1.0 + 4.0 * momentum**2))
        y = z + (momentum - 1.0) / nxt * (z - before)
        before, momentum = z, nxt
    return z[:d], thresholds(z)


@dataclass(frozen=True)
class Example:
    counts: dict[int, int]  # of the features that any fit takes
    words: int
    toxic: int
    fold: int


def learn(rows: list[Example], chosen: list[list[int]]) -> OrdinalModel:
    """chosen: the features without each fold, and at last those of all."""
    y, fold = np.array([r.toxic for r in rows], int), np.array([r.fold for r in rows], int)
    few = lambda some: min((y[some] == 1).sum(), (y[some] == 0).sum()) < 2
    if any(few(fold != k) or few(fold == k) for k in range(FOLDS)):
        return OrdinalModel({}, np.zeros(0), np.arange(1.0, GRADES + 1) * 10)

    def unseen(grade: np.ndarray, grades: int) -> np.ndarray:
        """Of each row w.x less the first threshold, by the model of the other folds."""
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            columns = {h: i for i, h in enumerate(chosen[k])}
            own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            w, t = fit_ordinal(Sparse.of([rows[i].counts for i in rest], columns), grade[rest], grades)
            out[own] = Sparse.of([rows[i].counts for i in own], columns).times(w) - t[0]
        return out

    severity = unseen(y, 1) / np.log1p(np.maximum(1, [r.words for r in rows]))
    low, high = np.quantile(severity[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (severity > low) + (severity > high), 0)
    p = _sigmoid(unseen(grade, GRADES))
    tries = np.unique(np.concatenate([p, [0.5]]))
    tries = (tries[1:] + tries[:-1]) / 2
    at = lambda some: len(some) - np.searchsorted(np.sort(some), tries)  # noqa: E731  how many reach each cut
    worth = at(p[y == 1]) / (y == 1).sum() - CLEAN_LOST * at(p[y == 0]) / (y == 0).sum()
    cuts = tries[worth >= worth.max(initial=0) - 1e-12]
    columns = {h: i for i, h in enumerate(chosen[-1])}
    w, t = fit_ordinal(Sparse.of([r.counts for r in rows], columns), grade)
    return OrdinalModel(columns, w, t, float(np.median(cuts)) if len(cuts) else 0.5)


def telling(sample: DataFrame, least_z: float) -> list[list[int]]:
    """The features whose document frequencies in the two classes of (y, fold, features) differ: without each fold's
    rows, and in all."""
    part = lambda name, y: [F.count_if((F.col("y") == y) & (F.col("fold") == k)).alias(f"{name}{k}") for k in range(FOLDS)]
    sizes = sample.agg(*part("a", 1), *part("b", 0)).first()
    found = sample.select("y", "fold", F.explode("features").alias("f")).groupBy("f").agg(*part("a", 1), *part("b", 0))

    def tells(without: int | None) -> Column:
        total = lambda of, name: sum((of(f"{name}{k}") for k in range(FOLDS) if k != without), F.lit(0))
        n1, n0 = (sum(sizes[f"{x}{k}"] for k in range(FOLDS) if k != without) for x in "ab")
        if min(n1, n0) < 2:
            return F.lit(False)
        a, b = total(F.col, "a"), total(F.col, "b")
        p, q, both = a / n1, b / n0, (a + b) / (n1 + n0)
        z = (p - q) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
        return (a >= 3) & (z >= least_z) & (p >= 10 * (b + 0.5) / n0)

    verdicts = [tells(k).alias(f"v{k}") for k in (*range(FOLDS), None)]
    told = found.select("f", *verdicts).where(" or ".join(f"v{k}" for k in (*range(FOLDS), None))).orderBy("f").collect()
    return [[r["f"] for r in told if r[f"v{k}"]] for k in (*range(FOLDS), None)]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 3000, least_z: float = 5.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cache_bytes: int = CACHE_BYTES) -> OrdinalModel:
    """A model of at most max_train labelled rows of each class. cache_bytes: of each of a worker's two generations."""
    bound_batches(docs.sparkSession)
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    some = [named.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train) for k in (0, 1)]
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some[0].union(some[1])), "doc_id")
    sample = sample.select(F.xxhash64("doc_id", "text").alias("key"), "y", "text")
    schema = "key long, y int, words int, features array<long>, counts array<int>"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = only_in_worker(("features", cache_bytes), lambda: SegmentCache(features_of, cache_bytes))
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                found = [counted(t.as_py(), cache) for t in part.column("text")]
                words = [len(t.as_py().split()) if t.is_valid else 0 for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), pa.array(words, pa.int32()), pa.array([[*f] for f in found], pa.list_(pa.int64())), pa.array([[*f.values()] for f in found], pa.list_(pa.int32()))], ["key", "y", "words", "features", "counts"])

    rows = written(sample.mapInArrow(counts, schema))
    # ids may stand for many rows: the bound is on rows
    kept = rows.select("y", "key").distinct()
    kept = kept.where("y = 0").orderBy("key").limit(max_train).union(kept.where("y = 1").orderBy("key").limit(max_train))
    rows = written(rows.join(F.broadcast(kept), ["y", "key"]).dropDuplicates(["y", "key"]).withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")))
    chosen = telling(rows, least_z)
    known, names = set().union(*chosen), rows.columns

    def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            few = [[(f, n) for f, n in zip(fs, ns) if f in known] for fs, ns in zip(b.column("features").to_pylist(), b.column("counts").to_pylist())]
            columns = {c: b.column(c) for c in names} | {"features": pa.array([[f for f, _ in r] for r in few], pa.list_(pa.int64())), "counts": pa.array([[n for _, n in r] for r in few], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    got = rows.mapInArrow(only_chosen, rows.schema).orderBy("key", "y").collect()
    return learn([Example(dict(zip(r["features"], r["counts"])), r["words"], r["y"], r["fold"]) for r in got], chosen)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, grade, p_toxic, toxic, kept) of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.in_worker(CACHE_BYTES)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                severity, p, grade = model.scores([t.as_py() for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity), pa.array(grade, pa.int32()), pa.array(p), pa.array(p >= model.cut), pa.array(p < model.cut)], ["id", "expected_severity", "grade", "p_toxic", "toxic", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {type_of(docs, id_col)}, expected_severity double, grade int, p_toxic double, toxic boolean, kept boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns, whatever their names (they go through by place)."""
    bound_batches(docs.sparkSession)
    at = column_place(docs, text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.in_worker(cache_bytes)
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS):
                b = whole.slice(first, TEXTS)
                yield b.filter(pa.array(model.scores([t.as_py() for t in b.column(at)])[1] < model.cut))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
