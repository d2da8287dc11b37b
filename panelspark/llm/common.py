"""What the corpus operators share: tables, the shared folder, columns and word segments."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.tables import Scratch, remove_tables, shared_folder, written

#: Words are runs of anything but these characters.
ASCII_SPACE = r"\x20\x09-\x0D"


__all__ = ["Scratch", "remove_tables", "shared_folder", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows of a table, in their order, dealt over all cores if fewer tasks would read them. A row group is one task's,
    however many cores there are, so what is computed row by row from a table of few row groups would leave most idle.
    A table of as many files as cores, or of as many tasks with rows (counted from the files' footers), is left as it is,
    so that large tables are never moved. Rows and columns are the same, whatever their names."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).limit(cores).collect()
    if not 0 < len(sizes) < cores:
        return rows
    total, before = 0, []
    for part, n in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += n
    at = free_name("row", rows.columns)
    place = F.create_map(*before)[F.shiftright(at, 33).cast("int")] + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.withColumn(at, F.monotonically_increasing_id())
    to = F.coalesce(F.pmod(F.floor(place * cores / total), F.lit(cores)), F.lit(0)).cast("int")
    return dealt.repartitionById(cores, to).sortWithinPartitions(at).drop(at)


#: Bits of with_maybe()'s filter: 4 MB at most, whatever the input.
FILTER_BITS = 1 << 25
#: Spark's own bound on the bytes that a Python worker is sent at once, and ours.
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches, unless it was set to another than Spark's: each task holds a batch
    several times over, in the JVM and in Python, and 64 MB of texts each time are too much beside its other needs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(name, BATCH_BYTES)


def with_maybe(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column name: false only where key is none of the values of wanted's only column. What is
    broadcast is a bitmap of FILTER_BITS bits."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bitmap = wanted.select(bit(F.col(wanted.columns[0])).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("__f_bucket"))
    bitmap = bitmap.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("__f_bits"))
    out = rows.withColumn("__f_bit", bit(key)).withColumns({"__f_bucket": F.expr("bitmap_bucket_number(__f_bit)"), "__f_at": F.expr("bitmap_bit_position(__f_bit)")})
    out = out.join(F.broadcast(bitmap), "__f_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__f_bits, cast(__f_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = byte.bitwiseAND(F.expr("shiftleft(1, cast(__f_at % 8 as int))")) != 0
    return out.withColumn(name, F.coalesce(found, F.lit(False))).drop("__f_bit", "__f_bucket", "__f_at", "__f_bits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def free_name(wanted: str, columns: Iterable[str]) -> str:
    """wanted, with as many underscores at its end as make it none of columns, in either case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column_place(df: DataFrame, name: str) -> int:
    """The place of a column, by Spark's rules for names."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def safe_chunks(text: str, size: int, boundary: re.Pattern) -> Iterator[str]:
    """text cut at the first safe space after every size characters; that space is dropped."""
    at = 0
    while len(text) - at > size and (m := boundary.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def byte_batches(items: Iterable[str], most: int) -> Iterator[list[str]]:
    """Lists of items of about most bytes each (an item is at least one, and is never cut)."""
    batch: list[str] = []
    held = 0
    for x in items:
        n = len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
        if batch and held + n > most:
            yield batch
            batch, held = [], 0
        batch.append(x)
        held += n
    if batch:
        yield batch


CACHE_BYTES = 32 << 20


class SegmentCache(dict):
    """Values of text segments: two generations of at most limit bytes each, as keys and values take them (values:
    bytes, or tuples of whole numbers); long segments are not kept."""

    def __init__(self, make: Callable, limit: int = CACHE_BYTES, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old, self.held = make, limit, longest, {}, 0

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        size = 100 + getsizeof(key) + getsizeof(value)  # with the place in the table
        if type(value) is tuple:
            size += 36 * len(value)
        if self.held + size > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = value


_worker: dict = {}


def give_back() -> None:
    """What Python and Arrow have freed goes back to the system, as far as the C library can do that: a worker keeps it
    otherwise, beside what the executor's JVM needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def only_in_worker(key, make: Callable):
    """make(), kept by this Python process until it is asked for another key: processes outlive tasks and stages, and
    what an earlier stage has kept must not stay beside what a later one keeps."""
    if key not in _worker:
        _worker.clear()
        give_back()
        _worker[key] = make()
        give_back()
    return _worker[key]
