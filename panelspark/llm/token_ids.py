"""Ids of whole texts by a `tokenizers` file, as little-endian unsigned 32-bit bytes.

Texts are cut before a space that follows something that is no white space. Neither kind of tokenizer here has a token
over such a place (byte-level pre-tokens begin with the space; the word kind drops spaces), so the ids of a text are
those of its parts in a row, and each worker encodes a part that it has met before only once. Texts that hold one of
the file's special strings, or white space in other places, are cut by a slower rule or encoded whole. A part of letters
and one mark, or of two lines, is made of its pre-tokens; one of letters is a pre-token, whose bytes' signs go to the
model.

encode_texts takes an Arrow column of texts. For the word kind, the bytes of a group of texts are cut into pre-tokens all at
once, Arrow finds the different ones, Python gets the ids of each of those once, and Arrow puts all ids in a row. Words between
white space that hold an apostrophe, or characters other than ASCII and the letters of Latin-1, stay whole there.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SegmentCache, byte_batches, only_in_worker, safe_chunks

#: Unicode's White_Space, which \s means in the library.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE_CHARS = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
PARTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BOUNDARY = re.compile(f"(?<=[^{WHITE}]) ")
CHUNK_CHARS = 1 << 20
CACHE_BYTES = 72 << 20
#: Texts that encode_texts takes at once; longer ones are encoded each by itself.
GROUP_BYTES = 4 << 20
#: Words that go to the library together, as it holds far more than their bytes meanwhile.
BATCH_BYTES = 64 << 10
#: Marks that are a pre-token of their own after letters, in both kinds of file.
MARKS = frozenset(".,;:!?")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level signs: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order.
SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
SPACE = SIGNS[32]
#: The word kind's rule, and the same for lower-cased ASCII text.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Classes of UTF-8's bytes: white space, letters (with all that is no ASCII), digits, others.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[[*range(9, 14), 32]] = 0
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[48:58] = 2
#: Bytes that leave a word whole, and those that do so after LATIN, which begins Latin-1's letters: its two signs.
LATIN = 0xC3
WHOLE = np.zeros(256, bool)
WHOLE[[0x27, *range(0xC0, LATIN), *range(LATIN + 1, 256)]] = True


def pre_tokens(at: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts, lower-cased (or words left whole, as they are), and how many begin before each text and in
    all. at: where the texts begin in data, their UTF-8, and where the last one ends."""
    kind = CLASSES[data]
    shown = kind != 0
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    begins = begins[:-1]
    words = shown & begins
    words[1:] |= shown[1:] & ~shown[:-1]
    starts = kind == 2
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= shown
    starts |= words
    low = data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    whole = np.flatnonzero(WHOLE[data])
    latin = np.flatnonzero(data[:-1] == LATIN) + 1
    if len(latin):
        after = data[latin]
        low[latin[after < 0x9F]] += 32
        whole = np.concatenate([whole, latin[(after == 0x97) | (after == 0xB7)]])
    if len(whole):
        first = np.flatnonzero(words)
        inside = np.zeros(len(first), bool)
        inside[np.searchsorted(first, whole, "right") - 1] = True
        inside = np.repeat(inside, np.diff(first, append=len(data)))
        tail = slice(first[0], None)  # white space may come before the first word
        low[tail] = np.where(inside, data[tail], low[tail])
        starts[tail] &= words[tail] | ~inside
    text = low[shown]
    ends = np.append(np.flatnonzero(starts[shown]), len(text)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(text))
    return found, np.searchsorted(np.flatnonzero(starts), at)


class Pieces(SegmentCache):
    """parts(key): the value put together from parts' values, or None where a key is one piece."""

    def __init__(self, parts, make, limit: int):
        super().__init__(make, limit)
        self.parts = parts

    def __missing__(self, key):
        value = self.parts(key)
        if value is None:
            return super().__missing__(key)
        if len(key) <= 10:
            self.keep(key, value)
        return value


class TokenIds:
    """encode(text) -> bytes of its ids."""

    def __init__(self, path: str, cache_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        # the word kind: white space is made one space and then dropped
        self.drops = not byte_level and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.cuts = byte_level or self.drops
        self.by_rule = self.drops and [p.get("pattern") for p in pre.get("pretokenizers", [])] == [{"Regex": WORD_RULE}, None]
        self.first = Pieces(self._first_of, self._encode_first, cache_bytes)
        self.spaced = self.first if self.drops else Pieces(self._spaced_of, self._encode_spaced, cache_bytes)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, letters: str, before: str = "") -> bytes:
        """Of a pre-token of letters."""
        signs = letters if letters.isascii() else "".join(map(SIGNS.__getitem__, letters.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(before + signs)]).tobytes()

    def _plain(self, word: str) -> bool:
        """One pre-token of letters. The word kind also lower-cases and composes: there, only Latin letters that stay as they are."""
        return word.isalpha() and (not self.drops or (max(word) <= "\u017f" and word == word.lower()))

    def _first_of(self, word: str) -> bytes | None:
        simple = not self.drops or (word and max(word) <= "\u017f" and "\u0130" not in word)  # lower-cased letter by letter
        if word and word[-1] in MARKS and word[:-1].isalpha() and simple:
            return self.first[word[:-1]] + self.first[word[-1]]
        if self.drops and word.isalpha() and simple and word != word.lower():
            return self.first[word.lower()]
        at = word.find("\n", 1)
        if at > 0 and word[at - 1] not in WHITE_CHARS:
            return self.first[word[:at]] + self.first[word[at:]]
        if len(word) > 1 and word[0] == "\n" and word[1] not in WHITE_CHARS:
            return self.first["\n"] + self.first[word[1:]]
        return None

    def _encode_first(self, word: str) -> bytes:
        return self._word(word) if self._plain(word) else self.whole(word)

    def _spaced_of(self, word: str) -> bytes | None:
        if not word or word[-1] in WHITE_CHARS:
            return None
        if word[-1] in MARKS and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.first[word[-1]]
        at = word.find("\n", 1)
        if at > 0 and word[at - 1] not in WHITE_CHARS:
            return self.spaced[word[:at]] + self.first[word[at:]]
        return None

    def _encode_spaced(self, word: str) -> bytes | None:
        """None: the next space may belong to this part's white space."""
        if not word or word[-1] in WHITE_CHARS:
            return None
        return self._word(word, SPACE) if self._plain(word) else self.whole(" " + word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return self.whole(text)
        if len(text) <= CHUNK_CHARS:
            return self._chunk(text, True)
        return b"".join(self._chunk(c, not k) for k, c in enumerate(safe_chunks(text, CHUNK_CHARS, BOUNDARY)))

    def _chunk(self, text: str, starts: bool) -> bytes:
        """starts: the text begins here; otherwise a space stood before it."""
        words = text.split(" ")
        if self.drops:
            return b"".join(map(self.first.__getitem__, words))
        try:
            if starts:
                if not words[0] or words[0][-1] in WHITE_CHARS:
                    raise TypeError
                return self.first[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))
            return b"".join(map(self.spaced.__getitem__, words))
        except TypeError:  # a None among the parts
            return b"".join(map(self.first.__getitem__, PARTS.findall(text if starts else " " + text)))

    def encode_texts(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """encode() of every text; a null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_rule:
            yield from (self.encode(t.as_py()) for t in texts)
            return
        groups = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            yield from self._group(texts[a:b])

    def _group(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        alone = pc.greater(pc.binary_length(texts), GROUP_BYTES)
        for special in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, special))
        rest = pc.if_else(alone, pa.scalar("", texts.type), texts) if pc.any(alone).as_py() else texts
        _, at, data = rest.buffers()
        at = np.frombuffer(at, np.int64 if pa.types.is_large_string(rest.type) else np.int32)[rest.offset : rest.offset + len(rest) + 1]
        data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        words, ends = pre_tokens(at - at[0], data)
        parts = words.dictionary_encode()
        ids = pa.array(self._of_words(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, np.int64)[ends].tolist() if len(ids) else [0] * len(ends)
        data = memoryview(data or b"")
        for k, by_itself in enumerate(alone.to_pylist()):
            yield self.encode(texts[k].as_py()) if by_itself else data[ends[k] : ends[k + 1]]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Of different pre-tokens and words; what the library must cut goes to it together."""
        cache = self.first
        values = list(map(cache.get, words))
        whole = []
        for k in [k for k, v in enumerate(values) if v is None]:
            word = words[k]
            value = cache.old.get(word)
            if value is None:
                if self._plain(word):
                    value = self._word(word)
                elif word.isascii() and word.isprintable():
                    pieces = ASCII_RULE.findall(word.lower())
                    value = self._word(pieces[0]) if len(pieces) == 1 else b"".join(map(cache.__getitem__, pieces))
                else:
                    whole.append(k)
                    continue
            if len(word) <= cache.longest:
                cache.keep(word, value)
            values[k] = value
        batches = byte_batches((words[k] for k in whole), BATCH_BYTES)
        for k, found in zip(whole, chain.from_iterable(self.tokenizer.encode_batch_fast(b, add_special_tokens=False) for b in batches)):
            values[k] = array("I", found.ids).tobytes()
            if len(words[k]) <= cache.longest:
                cache.keep(words[k], values[k])
        return values


def token_ids(path: str, cache_bytes: int = CACHE_BYTES) -> TokenIds:
    """The encoder of this worker. cache_bytes: of each generation of each of its two caches."""
    return only_in_worker(("ids", path, cache_bytes), lambda: TokenIds(path, cache_bytes))
