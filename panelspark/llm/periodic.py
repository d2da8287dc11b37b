"""Periodic runs: stretches of words that repeat with a period, found by comparing a text with itself at all lags.

A text's words get numbers, and each bit of these numbers is a plane: a big integer with a bit a word. For a lag q, each
plane is XORed with itself shifted by q, and these are ORed: a bit is zero where words q apart are identical. A run of
period q is a stretch of such zeros of at least max(6, 4 q) - q; ANDs of the inverse with itself, shifted by 1, 2, 4, ...,
leave only the places where such a stretch begins, so that a lag costs a logarithm of big-integer steps and no loop over
words. A stretch that has a smaller period, too, was found at a lag that divides q, with the same bounds, as it is longer
than both periods together; it is no run of period q.

Lags. A run of a period from 2^k to 2^(k+1) - 1 holds a block of 2^k words, at a multiple of 2^k, that recurs one period
later. Hashes of all windows of 2^k words come from those of 2^(k-1) by one step, and one comparison of n hashes says at
which lags of the class any block recurs; other lags are not tried (below ALL_LAGS all are). Recurrences inside a run of a
period that divides the lag tell nothing new and do not count, so that a text of one word only is not tried at all lags.
Equal hashes of different windows cost a try and change no result.

All is done within a text, so that nothing is shuffled; a task holds one text, its words and about 20 numbers a word.

Defined results: a null or word-less text has no words and no runs; a null id plants nothing; repeated rows are rows;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, type_of

LEAST, TIMES = 6, 4
#: Lags below are always tried. A power of two.
ALL_LAGS = 8
OUT_ROWS = 2000

Run = tuple[int, int, int]
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as a big integer, for each b."""
    bits = np.arange(max(1, int(ids.max(initial=0)).bit_length()))
    packed = np.packbits((ids[None, :] >> bits[:, None] & 1).astype(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def stretches(of: list[int], n: int, lag: int) -> list[tuple[int, int]]:
    """(begin, end) of the longest stretches of words with this period, of at least max(6, 4 * lag) words."""
    least = max(LEAST, TIMES * lag) - lag
    differ = 0
    for plane in of:
        differ |= plane ^ (plane >> lag)
    same = ~differ & ((1 << (n - lag)) - 1)
    long = 1
    while same and long < least:
        step = min(long, least - long)
        same &= same >> step
        long += step
    if not same:
        return []
    flags = np.unpackbits(np.frombuffer(same.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(flags, prepend=0, append=0))
    return list(zip(edges[::2].tolist(), (edges[1::2] + least - 1 + lag).tolist()))


def lags_in(hashes: np.ndarray, n: int, size: int, runs: list[Run]) -> list[int]:
    """Lags from size to 2 * size - 1 at which a block of size words recurs. hashes: of all windows of size words."""
    blocks = len(hashes) // size
    later = np.zeros(blocks * size, np.uint64)
    later[: len(hashes) - size] = hashes[size:]
    again = later.reshape(blocks, size) == hashes[: blocks * size : size, None]
    again.ravel()[len(hashes) - size :] = False
    block, lag = np.nonzero(again)
    begin, lag = block * size, lag + size
    for s, length, period in runs:
        if len(lag) and length >= size:
            news = (begin < s) | (begin + lag > s + length) | (lag % period != 0)
            begin, lag = begin[news], lag[news]
    lags = np.unique(lag)
    return lags[lags * TIMES <= n].tolist()


def runs_of(words: list) -> list[Run]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return []
    of = planes(ids)
    found: list[Run] = []
    seen: set[tuple[int, int]] = set()

    def attempt(lags) -> None:
        for lag in lags:
            for begin, end in stretches(of, n, lag):
                if (begin, end) not in seen:
                    seen.add((begin, end))
                    found.append((begin, end - begin, lag))

    attempt(range(1, min(ALL_LAGS - 1, n // TIMES) + 1))
    hashes, size = _mix(ids.astype(np.uint64) + _U(1)), 1
    while TIMES * size <= n:
        if size >= ALL_LAGS:
            attempt(lags_in(hashes, n, size, found))
        hashes = _mix(hashes[:-size] * _U(3) + hashes[size:])
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words but those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for begin, length, period in runs:
        change[begin + period] += 1
        change[begin + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0 if runs else np.zeros(len(words), bool)
    return [w for w, gone in zip(words, dropped.tolist()) if not gone]


def planted(words: list, doc_id: str | None) -> list:
    """words with, for a tenth of the ids, a periodic end."""
    n = len(words)
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, details: bool = True) -> DataFrame:
    """Of every row of docs: the id, n_words, n_runs; start, length, period and exponent_milli of the longest run (ties:
    the first, then the least period); hashes of all runs and of the text with its runs collapsed; and, with details,
    both (runs: by start, then period). plant: periodic ends are made in a tenth of the texts, by id."""
    bound_batches(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = {"n_words": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(run), "collapsed": pa.binary()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                rows = []
                for ident, text in zip(part.column(1), part.column(2)):
                    words = (text.as_py() or b"").split()
                    if plant:
                        words = planted(words, ident.as_py())
                    runs = runs_of(words)
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
                    kept = b" ".join(collapsed(words, runs))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rows.append((len(words), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs] if details else None, kept if details else None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, fields.values()))], ["id", *fields])

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text"))
    kind = type_of(docs, id_col)
    out = rows.mapInArrow(find, f"id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    out = out.withColumn("collapsed", F.col("collapsed").cast("string")) if details else out.drop("runs", "collapsed")
    return out.withColumnRenamed("id", id_col)
