"""Token counts of whole texts by a sentencepiece model.

Only lengths leave the Arrow function. Texts are taken in groups of about the same number of bytes. A text is cut at
safe boundaries: a space after something that is no space. No piece of the vocabulary goes on over such a space (this
is checked when the model is loaded), and the model puts a space before a text, so that the parts' counts add up.
Equal parts of a group are encoded once, in batches of about the same number of bytes.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id is returned as null; repeated rows are
counted each by itself; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentCache, bound_batches, byte_batches, only_in_worker, safe_chunks, type_of

GROUP_BYTES = 2 << 20
BATCH_BYTES = 256 << 10
CHUNK_CHARS = 1 << 20
#: Sentencepiece's own sign for a space.
META = "▁"
BOUNDARY = re.compile("(?<=[^ ]) ")


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        tests = ("a b", "a  b", " a", "a\n b")
        joined = any(META in p.lstrip(META) for p in pieces)
        # cutting at spaces also needs a model that leaves spaces as they are
        self.cuts = not joined and all(self._whole(t) == sum(map(self._whole, BOUNDARY.split(t))) for t in tests)
        self.cache = SegmentCache(self._whole)
        #: what is left of a text after a space at its end
        self.end = self._whole("a ") - self._whole("a")

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def _parts(self, text: str) -> Iterator[list[str]]:
        if not self.cuts or META in text:
            yield [text]
            return
        for chunk in safe_chunks(text, CHUNK_CHARS, BOUNDARY):
            yield BOUNDARY.split(chunk) if "  " in chunk or chunk[:1] == " " else chunk.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for group in byte_batches(texts, GROUP_BYTES):
            if len(group) == 1:
                out.append(sum(self._known(parts) for parts in self._parts(group[0])) if group[0] else 0)
            else:
                parts = [list(chain.from_iterable(self._parts(t))) for t in group]
                self._encode(set(chain.from_iterable(parts)))
                out += [sum(map(self.cache.__getitem__, p)) if t else 0 for t, p in zip(group, parts)]
        return out

    def _known(self, parts: list[str]) -> int:
        self._encode(set(parts))
        return sum(map(self.cache.__getitem__, parts))

    def _encode(self, parts: set[str]) -> None:
        cache = self.cache
        cache[""] = self.end
        new = [p for p in parts if p not in cache and p not in cache.old and len(p) <= cache.longest]
        for batch in byte_batches(new, BATCH_BYTES):
            for part, ids in zip(batch, self.model.encode(batch, num_threads=1)):
                cache.keep(part, len(ids))


def counter(path: str) -> PieceCounter:
    return only_in_worker(("counts", path), lambda: PieceCounter(path))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs, by the sentencepiece model at model_path."""
    bound_batches(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).counts
        for b in batches:
            n = count([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2)], ["id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(lengths, f"id {type_of(docs, id_col)}, n_tokens long, n_bytes long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
