"""Near-duplicate documents by SimHash fingerprints that differ in few bits.

Fingerprint. h is the XXH64 (seed 42) of each shingle of size words, repeats included; a bit is 1 if it is set in more
than half of all h.

Links. Documents of one fingerprint are one node. The bits of a fingerprint are cut into segments of WIDTH, and the
number of set bits of each segment is a coordinate: a point whose Manhattan distance from another's is never more than
the number of bits in which they differ. Points are the cells of a grid. Two points at a distance of 2 have a cell
between them that is at most 1 from both, so each node is dealt to its own cell and to those 1 away, about 49, and nodes
that may be linked meet in a cell. All pairs of a cell of up to FULL nodes are verified by XOR, inside the join. Fuller
cells are dealt anew on the grid of one bit a segment: there the distance is the number of differing bits itself, a cell
has at most 65 nodes, and any two of them are linked, so one link a node does (links are verified all the same). So no
group is compared pair by pair, however many near copies it has, and no link is lost. Links are joined to components by
large-star and small-star steps.

All is done on tables of the distinct fingerprints in JVM code but for the fingerprints themselves. Only links are
joined again; a hot fingerprint is one node, and the last join is against a table that Spark can split.

Defined results: null, empty and word-less texts have the fingerprint 0 and are linked like others; null ids take part,
and link what they are near, but are no component's least id, unless it has no other; repeated rows are rows; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, type_of, written
from .setsketch import components

SEED = 42
BITS = 64
WIDTH = 2
FULL = 64
CHUNK = 1 << 14
OUT_ROWS = 2000


def fingerprint(text: bytes | None, size: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(size, len(words))
    begins, ends = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1], ends[size - 1 :] - 1
    hashes, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(begins), CHUNK):
        some = slice(at, at + CHUNK)
        h = np.array([hashes(line[a:b], SEED) for a, b in zip(begins[some].tolist(), ends[some].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(begins), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node) of every row of docs; node is the fingerprint's 64 bits as a long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                found = np.array([fingerprint(t.as_py(), size) for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["id", "node"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(make, f"id {type_of(docs, id_col)}, node long")


def in_cells(nodes: DataFrame, width: int) -> DataFrame:
    """(node, cell): each node in its own cell and in those 1 away. A cell has each segment's number of set bits in the
    segment's place."""
    point = F.lit(0).cast("long")
    for at in range(0, BITS, width):
        segment = F.shiftrightunsigned("node", at).bitwiseAND(F.lit((1 << width) - 1))
        point = point.bitwiseOR(F.shiftleft(F.bit_count(segment).cast("long"), at))
    # step 0 stays, odd steps add a bit to a segment, even ones take one away
    dealt = nodes.select("node", point.alias("point")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2 * BITS // width))))
    dealt = dealt.withColumn("at", F.expr(f"greatest(step - 1, 0) div 2 * {width}").cast("int"))
    dealt = dealt.withColumn("n", F.expr(f"shiftrightunsigned(point, at) & {(1 << width) - 1}")).where(f"step = 0 or if(step % 2 = 1, n < {width}, n > 0)")
    to = F.expr("n ^ (n + if(step % 2 = 1, 1, -1))")
    return dealt.select("node", F.when(F.col("step") == 0, F.col("point")).otherwise(F.col("point").bitwiseXOR(F.call_function("shiftleft", to, F.col("at")))).alias("cell"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, scratch: Scratch, width: int = WIDTH, full: int = FULL) -> DataFrame:
    """(a, b): pairs of nodes that differ in at most 2 bits, enough to connect all such pairs."""
    # a node becomes many rows: spread over all tasks, not by the few bytes that nodes take
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_cells(nodes.repartition(tasks, "node"), width)
    met = scratch.written(dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = scratch.written(dealt.join(met, "cell"))
    some = dealt.where(F.col("n") <= full)
    a, b = some.select("cell", F.col("node").alias("a")), some.select(F.col("cell").alias("c"), F.col("node").alias("b"))
    pairs = a.join(b, (F.col("cell") == F.col("c")) & (F.col("a") > F.col("b")) & (differing("a", "b") <= 2)).select("a", "b")
    crowd = dealt.where(F.col("n") > full).select("node").distinct()
    fine = in_cells(crowd, 1).groupBy("cell").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)  # 65 at most
    stars = fine.select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a")).where("a > b").where(differing("a", "b") <= 2)
    return scratch.written(pairs.union(stars.select("a", "b")).distinct())


def simhash_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, full: int = FULL) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs: fingerprints that differ in at most 2 bits are linked, and
    component_id is the least id reachable."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = written(fingerprints(docs, size, id_col, text_col))
    nodes = scratch.written(rows.groupBy("node").agg(F.min("id").alias("rep")))
    found = components(links(nodes, scratch, width, full), scratch)
    found = scratch.written(nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")))
    firsts = scratch.written(found.groupBy("component").agg(F.min("rep").alias("component_id")))
    ids = written(found.join(firsts, "component").select("node", "component_id"))
    scratch.remove()
    out = rows.join(ids, "node")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
