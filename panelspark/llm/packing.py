"""Vector best-fit packing of documents into token sequences.

A sequence (bin) has three capacities: tokens, documents and attention cost (the sum of the squared lengths). Pieces
come longest first; each goes to the open sequence that has room for it in every dimension and whose residual vector
fits best: the least weighted norm of what would be left ("norm"), or the largest weighted dot product of demand and
residual ("dot"). Only if none has room is a sequence opened.

Pieces as long as a sequence fill one by themselves and are streamed. The others (at most one a document) are dealt by
a row number's hash to buckets of about bucket_rows documents, each packed by itself in one task: memory is bounded by
a bucket, no key decides where a row goes, and each bucket leaves about one sequence part empty.

Defined results: a null or empty text is a document of just the end id; null ids are kept; repeated rows are packed
each; ties in fit go to the sequence opened first; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, type_of
from .token_ids import CACHE_BYTES, token_ids

PIECES = "id {}, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = "id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
OUT_ROWS = 20_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """A row for each piece. A longer document is cut so that all pieces but the first are full."""
    bound_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer_path, cache_bytes).encode
        end = end_id.to_bytes(4, "little")
        salt = TaskContext.get().partitionId() << 40
        names = ["id", "piece", "start", "length", "ids_crc32", "salt"]

        def packed(ids, rows):
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

        for b in batches:
            rows, of = [], []
            for k, text in enumerate(b.column(1)):
                data = encode(text.as_py() or "") + end
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                at = 0
                for piece in range((n - first) // capacity + 1):
                    length = capacity if piece else first
                    rows.append((piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), salt))
                    of.append(k)
                    at += length
                    salt += 1
                if len(rows) >= OUT_ROWS:
                    yield packed(b.column(0).take(pa.array(of)), rows)
                    rows, of = [], []
            if rows:
                yield packed(b.column(0).take(pa.array(of)), rows)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, PIECES.format(type_of(docs, id_col)))


def vector_best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence of each piece (from 0), its offset there and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    cap = np.array(capacities, float)
    w = np.array(weights, float)
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = int(lengths.min()) if n else 0
    left = np.empty((3, 64))  # residuals of the open sequences, as shares of the capacities
    name = np.empty(64, np.int64)
    opened = live = 0
    eps = 1e-12
    for i in order:
        length = int(lengths[i])
        demand = np.array([length, 1, length * length]) / cap
        r = left[:, :live]
        room = np.flatnonzero((r >= demand[:, None] - eps).all(axis=0))
        if len(room):
            r = r[:, room]
            score = w @ ((r - demand[:, None]) ** 2) if rule == "norm" else -((w * demand) @ r)
            k = room[int(np.argmin(score))]
        else:
            if live == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                name = np.concatenate([name, np.empty_like(name)])
            k = live
            left[:, k], name[k] = 1.0, opened
            live += 1
            opened += 1
        sequence[i] = name[k]
        offset[i] = round((1.0 - left[0, k]) * cap[0])
        left[:, k] -= demand
        if left[0, k] * cap[0] < least - 0.5 or left[1, k] * cap[1] < 0.5:  # nothing that is left fits: closed, and the order of opening kept
            left[:, k : live - 1] = left[:, k + 1 : live]
            name[k : live - 1] = name[k + 1 : live]
            live -= 1
    return sequence, offset, opened


def pack(pieces: DataFrame, buckets: int, capacity: int, max_docs: int | None = None, max_attention: int | None = None, weights=(1.0, 0.25, 0.25), rule: str = "norm") -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32, salt) with sequence_id and offset."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is norm or dot, not {rule!r}")
    caps = (capacity, max_docs or capacity, max_attention or capacity * capacity)
    if caps[2] < capacity * capacity:
        raise ValueError("a full piece costs capacity squared; max_attention is at least that")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket, used = None, 0

        def out(t, ids, offsets):
            keep = [t.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            return pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        def flush():
            nonlocal held, used
            if held:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                seq, off, n = vector_best_fit(t.column("length").to_numpy(), caps, weights, rule)
                yield out(t, (bucket << 32) + used + seq, off)
                held, used = [], used + n

        for b in batches:
            keys = b.column("bucket").to_numpy()
            ends = [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            at = 0
            for end in ends:
                if end == at:
                    continue
                if keys[at] != bucket:
                    yield from flush()
                    bucket, used = int(keys[at]), 0
                part = b.slice(at, end - at)
                full = part.column("length").to_numpy() == capacity
                if full.any():
                    whole = part.filter(pa.array(full))
                    yield out(whole, (bucket << 32) + used + np.arange(whole.num_rows), np.zeros(whole.num_rows, np.int64))
                    used += whole.num_rows
                if not full.all():
                    held.append(part.filter(pa.array(~full)))
                at = end
        yield from flush()

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("salt"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "salt")
    return dealt.mapInArrow(bins, PACKED.format(type_of(pieces, "id")))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, bucket_rows: int = 8192, max_docs: int | None = None, max_attention: int | None = None, weights=(1.0, 0.25, 0.25), rule: str = "norm", id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    buckets = max(1, math.ceil(docs.count() / bucket_rows))
    pieces = cut_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, cache_bytes)
    return pack(pieces, buckets, capacity, max_docs, max_attention, weights, rule).withColumnRenamed("id", id_col)
