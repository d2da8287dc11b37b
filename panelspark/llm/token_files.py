"""Token-id shards: a flat id array with Elias-Fano encoded document boundaries.

Shard file (all numbers little-endian):

    header   8 bytes magic, then HEADER: bytes per id, documents, null ids among them, ids, least document id,
             and the byte lengths of the sections that follow
    ids      all ids in a row, 2 bytes each if every id of the vocabulary fits, else 4
    ends     Elias-Fano sequence: for each document the number of ids up to its end
    docs     Elias-Fano sequence: document ids less the least one (null ids come first and are not in it); if they
             are no whole numbers, of the ends of their texts
    names    those texts in a row, in UTF-8

Elias-Fano keeps the low bits of each value packed and the high bits in unary, about 2 + log2(universe / n) bits a
value, with one 32-bit select sample for every 256 values: select(i), and span(i, j) for values in a row, read a sample
and scan on from there, so that offsets are found without a table of 64-bit offsets. Readers find all offsets so.

The rows are dealt by ranges of doc_id, so that shard order is document order; of equal ids, by the first PREFIX characters
of their texts and their places in the input, so that no id's rows, however many, meet in one task. A task writes its shards under a
temporary name and renames them; a task that runs again writes the same bytes to the same names. Files are written
through pyarrow.fs and read by Spark's binaryFile source.

Defined results: a null or empty text is a document of just the end id; null ids sort first; rows with equal ids are
kept each, in the order of their texts' first PREFIX characters, then as read; ids keep their type (whole numbers, or what a string can be cast to); other
columns are not read; an empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, type_of
from .token_ids import token_ids

MAGIC = b"PSIDS\x00\x02\n"
HEADER = struct.Struct("<BQQQqQQQQ")
EF_HEADER = struct.Struct("<QBQQ")
SAMPLE_EVERY = 256
MANIFEST = "part int, shard int, path string, n_docs long, n_ids long"
READ = "path string, row long, doc_id {}, local_start long, n_tokens long, ids_crc32 long"
WHOLE = ("tinyint", "smallint", "int", "bigint")
OUT_ROWS = 20_000
PREFIX = 16


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.samples, self.low, self.high = n, low_bits, samples, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1, np.uint8)
        marks[at] = 1
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, at[::SAMPLE_EVERY].astype(np.uint32), np.packbits(low.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = EF_HEADER.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.samples.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = EF_HEADER.unpack_from(data)
        at, n_samples = EF_HEADER.size, -(-n // SAMPLE_EVERY)
        samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        return cls(n, low_bits, samples, np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low))

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.span(i, i + 1)[0])

    def span(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the sample before i to the one after them."""
        if i >= j:
            return np.zeros(0, np.uint64)
        at, after = int(self.samples[i // SAMPLE_EVERY]), -(-j // SAMPLE_EVERY)
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        marks = np.flatnonzero(np.unpackbits(self.high[at // 8 : end], bitorder="little")) + at // 8 * 8
        marks = marks[marks >= at][i % SAMPLE_EVERY :][: j - i]
        out = (marks - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first, last = i * self.low_bits, j * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first].reshape(j - i, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def values(self) -> np.ndarray:
        return self.span(0, self.n)


def shard_bytes(doc_ids: list, lengths: list[int], ids: bytes, wide: bool) -> bytes:
    """doc_ids ascending, None first, of whole numbers or texts; ids: unsigned 32-bit."""
    known = [d for d in doc_ids if d is not None]
    least, names = known[0] if known else 0, b""
    if isinstance(least, str):
        texts = [d.encode() for d in known]
        least, names, numbers = 0, b"".join(texts), np.cumsum([len(t) for t in texts])
    else:
        numbers = [d - least for d in known]
    data = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    ends = EliasFano.of(np.cumsum(np.array(lengths, np.uint64))).to_bytes()
    docs = EliasFano.of(np.array(numbers, np.uint64)).to_bytes()
    head = HEADER.pack(4 if wide else 2, len(doc_ids), len(doc_ids) - len(known), len(ids) // 4, least, len(data), len(ends), len(docs), len(names))
    return MAGIC + head + data + ends + docs + names


class Shard:
    """Reads one shard file's bytes."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id shard")
        at = len(MAGIC) + HEADER.size
        width, self.n_docs, self.n_null, self.n_ids, self.least, n_data, n_ends, n_docs, n_names = HEADER.unpack_from(data, len(MAGIC))
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.n_ids, at)
        at += n_data
        self.ends = EliasFano.from_bytes(data[at : at + n_ends])
        at += n_ends
        self.docs = EliasFano.from_bytes(data[at : at + n_docs])
        self.names = data[at + n_docs : at + n_docs + n_names]

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 begin, and where the last one ends."""
        before = [self.ends.select(i - 1)] if i else [0]
        return np.concatenate([np.array(before, np.int64), self.ends.span(i, j).astype(np.int64)])

    def document(self, i: int) -> np.ndarray:
        return self.ids[slice(*self.bounds(i, i + 1))]

    def doc_ids(self, i: int, j: int) -> list:
        nulls = [None] * (min(j, self.n_null) - min(i, self.n_null))
        i, j = max(0, i - self.n_null), max(0, j - self.n_null)
        if not self.names:
            return nulls + [int(d) + self.least for d in self.docs.span(i, j)]
        ends = [self.docs.select(i - 1) if i else 0, *self.docs.span(i, j).tolist()]
        return nulls + [self.names[a:b].decode() for a, b in zip(ends, ends[1:])]


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, shard_ids: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes folder/shards/*.psids, and folder/manifest (a Parquet table), which is returned. folder: a URI that all share."""
    bound_batches(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        wide = max(tokens.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) > 0xFFFF
        fs, root = pafs.FileSystem.from_uri(f"{folder}/shards")
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(root, recursive=True)
        names, lengths, ids = [], [], bytearray()
        shard = 0

        def flush():
            nonlocal names, lengths, ids, shard
            path = f"{root}/{part:08d}-{shard:06d}.psids"
            with fs.open_output_stream(f"{path}.{attempt}.tmp") as f:
                f.write(shard_bytes(names, lengths, bytes(ids), wide))
            fs.move(f"{path}.{attempt}.tmp", path)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path.rpartition("/")[2], "n_docs": len(names), "n_ids": len(ids) // 4}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            names, lengths, ids, shard = [], [], bytearray(), shard + 1
            return row

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), tokens.encode_texts(b.column(1))):
                names.append(doc)
                lengths.append(len(data) // 4 + 1)
                ids += data
                ids += end
                if len(ids) >= 4 * shard_ids:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"first": F.substring("text", 1, PREFIX), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("id", "first", "row").sortWithinPartitions("id", "first", "row")
    dealt = dealt.select(F.col("id").cast("long" if type_of(docs, id_col) in WHOLE else "string").alias("id"), "text")
    dealt.mapInArrow(shards, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    kind = pa.int64() if id_type in WHOLE else pa.string()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                s = Shard(content.as_py())
                for at in range(0, s.n_docs, OUT_ROWS):
                    stop = min(at + OUT_ROWS, s.n_docs)
                    bounds = s.bounds(at, stop)
                    crc = [zlib.crc32(s.ids[i:k].astype("<u4")) for i, k in zip(bounds.tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(crc)), pa.array(np.arange(at, stop)), pa.array(s.doc_ids(at, stop), kind), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        ["path", "row", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                    )

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # ids before each shard: within its part, and in all parts before (a row a part)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = parts.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("before_part"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    base = manifest.select("part", "path", within.alias("within")).join(before, "part").select("path", (F.col("within") + F.col("before_part")).alias("base"))
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.psids").load(f"{folder}/shards")
    rows = files.select(F.substring_index("path", "/", -1).alias("path"), "content").mapInArrow(documents, READ.format("long" if id_type in WHOLE else "string"))
    return rows.join(base, "path").select(F.col("doc_id").cast(id_type).alias("doc_id"), (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns what the files hold of each document."""
    spark, id_type = docs.sparkSession, type_of(docs, id_col)
    folder = folder or shared_folder(spark)
    if not write_shards(docs, tokenizer_path, folder, end_id, id_col=id_col, text_col=text_col).take(1):
        return spark.createDataFrame([], f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", id_col)
    return read_shards(spark, folder, id_type).withColumnRenamed("doc_id", id_col)
