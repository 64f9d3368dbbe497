"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list; candidate merges wait in a priority queue ordered by
rank, then position. A popped entry whose symbols have meanwhile been merged is stale and skipped.
Decoding concatenates the byte strings of the vocabulary.

Texts are cut at special tokens and then before every space that a non-space follows. Such a
space always begins a word of the vocabulary's own pattern, whatever stands around it, so pieces
can be encoded apart; so can those on both sides of a border of letter and punctuation. Texts go many at a time: their pieces are dictionary-encoded, each distinct
piece is looked up or encoded once, and the results are gathered back by position. Only pieces not
remembered meet the full pattern, and only words not remembered are merged. That holds for one kind of vocabulary file, which checked()
makes sure of; other files raise a ValueError.

Defined results: a null text is empty, with no ids; an id's unpaired bytes decode to U+FFFD;
equal texts get equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

#: Fixed pattern of the vocabulary's words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOSE = re.compile(r" (?!\S)")
CUT = re.compile(r" (?=\S)")
#: Begins a piece that no space stands before; texts that hold it are not cut in bulk.
GLUED = "\x01"
#: Pairs of neighbours between which a word always ends: a letter of every Unicode edition before or after ASCII punctuation
#: other than the apostrophe, which may begin a contraction, such a letter before a line end, or after one that stands alone.
_LETTER, _POINT = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
BORDERS = (f"([{_LETTER}])([\n{_POINT}])", f"([{_POINT}]|[{GLUED}{_LETTER}{_POINT}]\n)([{_LETTER}])")
#: Pieces a worker remembers at most.
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


V = TypeVar("V")


class Remembered:
    """A bounded store in two generations: the young one, when full, replaces the old one; what is asked for again moves back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = max(1, limit // 2), {}, {}

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def get(self, key: str, make: Callable):
        """What is known about the key; make() is asked where nothing is."""
        value = self.young.get(key)
        if value is None:
            if (value := self.old.get(key)) is None:
                value = make(key)
            self.put(key, value)
        return value

    def all(self, keys: list[str], make: Callable) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.get(keys[i], make)
        return found


class Pieces:
    """Splits texts into pieces that encode independently, and remembers what each encodes to.

    word() gives the value of one word of the pattern; combine() adds up consecutive values. A piece is
    kept without the space that it begins with; a text's first piece has none and is not kept whole.
    """

    def __init__(self, word: Callable[[str], V], combine: Callable[[list[V]], V], special: dict[str, V], limit: int = REMEMBERED):
        self.word, self.combine, self.special, self.empty = word, combine, special, combine([])
        self.plain, self.full = patterns()
        self.spaced, self.bare = Remembered(limit), Remembered(limit // 8)
        self.marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _part(self, word: str) -> V:
        return self.spaced.get(word[1:], self._spaced) if word[0] == " " and len(word) > 1 and word[1] != GLUED else self.bare.get(word, self.word)

    def _words(self, piece: str) -> V:
        words = self.plain(piece) if piece.isascii() else self.full(piece)
        if len(words) == 1:
            return self.word(piece)
        return self.combine([self._part(w) for w in words])

    def _spaced(self, piece: str) -> V:
        """Value of a piece that follows a space, which is part of it, or of a glued one."""
        if piece[:1] == GLUED:
            return self.word(piece[1:]) if piece[1:].isalpha() else self._words(piece[1:])
        return self.word(" " + piece) if piece.isalpha() else self._words(" " + piece)

    def head(self, piece: str) -> V:
        """Value of a text's first piece."""
        return self._words(piece) if piece else self.empty

    def of(self, text: str) -> V:
        """Value of one text; special tokens are pieces."""
        if self.marks is not None and (marks := self.marks.findall(text)):
            plain = self.marks.split(text)
            out = [self._plain(plain[0])]
            for mark, part in zip(marks, plain[1:], strict=True):
                out += [self.special[mark], self._plain(part)]
            return self.combine(out)
        return self._plain(text)

    def _plain(self, text: str) -> V:
        if GLUED in text:
            return self._words(text)
        first, *later = CUT.split(text)
        return self.combine([self.head(first), *self.spaced.all(later, self._spaced)])

    def gathered(self, texts: pa.Array) -> tuple[list[V], np.ndarray, np.ndarray]:
        """Values, the positions among them of the pieces of all texts in order, and where each text ends there."""
        whole = pc.fill_null(texts, "").cast(pa.large_string())  # marks of borders add to it
        strings = whole.to_pylist()
        odd = {i: self.of(t) for i, t in enumerate(strings) if LOOSE.search(t) or GLUED in t or (self.marks is not None and self.marks.search(t))}
        if odd:  # cut one by one; each counts as one piece
            whole = pa.array(["" if i in odd else t for i, t in enumerate(strings)], whole.type)
        for border in BORDERS:
            whole = pc.replace_substring_regex(whole, border, rf"\1 {GLUED}\2")
        heads = [t.split(" ", 1)[0] for t in whole.to_pylist()]
        of_head = [odd[i] if i in odd else self.head(h) for i, h in enumerate(heads)]
        parts = pc.split_pattern(whole, " ")
        coded = parts.flatten().dictionary_encode()
        ends = np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        index[np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(heads)]] = len(coded.dictionary) + np.arange(len(heads))
        return self.spaced.all(coded.dictionary.to_pylist(), self._spaced) + of_head, index, ends


def joined(values: list[bytes], index: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values at these positions one after the other, and where each text begins and ends in that."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(index))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return memoryview(data) if data is not None else memoryview(b""), at[np.concatenate([[0], ends]).astype(np.int64)]


def chunks(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with about `size` bytes of text; a longer text is alone or the last of its run."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    start = 0
    while start < len(texts):
        before = int(total[start - 1]) if start else 0
        end = min(len(texts), int(np.searchsorted(total, before + size)) + 1)
        yield start, end - start
        start = end


@lru_cache(maxsize=1)
def patterns() -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Splitters into words, for ASCII and for any text.

    The libraries know different editions of Unicode: of the letters and numbers that this Python does
    not know, those that the vocabulary's own library does not know either count as neither.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    wide = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))
    young = [c for c in wide if unicodedata.category(c) == "Cn"]
    newer = [c for c in young if len(cut("a" + c)) > 1 and len(cut("1" + c)) > 1]
    codes, spans = list(map(ord, newer)), []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    new = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)
    full = WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{new}]]").replace(r"\p{L}+", rf"[\p{{L}}--[{new}]]+").replace(r"\p{N}+", rf"[\p{{N}}--[{new}]]+") if new else WORDS
    return regex.compile(WORDS).findall, regex.compile(full, regex.V1).findall


def checked(path: str) -> dict:
    """The vocabulary file, if cutting and encoding here are right for it; else a ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (model.get("type", "BPE") == "BPE" and plain and whole and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary with the usual word pattern")
    return spec


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        spec = checked(path)
        vocab, stand = spec["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in stand.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(map(back.__getitem__, s)) for s, i in vocab.items() if all(c in back for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.decimal_of = {i: b"%d," % i for i in self.bytes_of}
        self.byte_id = [vocab[stand[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def word(self, data: bytes) -> list[int]:
        symbols = [self.byte_id[b] for b in data]
        n, merge = len(symbols), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], i, found[1]) for i in range(n - 1) if (found := merge(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j, left = after[i], symbols[i]
            if left < 0 or j < 0 or (found := merge(left << 20 | symbols[j])) is None or found[0] != rank:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merge(made << 20 | symbols[k]):
                    heapq.heappush(queue, (found[0], i, found[1]))
            k = before[i]
            if k >= 0 and (found := merge(symbols[k] << 20 | made)):
                heapq.heappush(queue, (found[0], k, found[1]))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[ByteBpe, Pieces]:
    """The codec, and its pieces with three values: ids as integers of 32 bits, decimals with a comma after each, decoded bytes."""
    bpe = ByteBpe(path)
    text, raw = bpe.decimal_of, bpe.bytes_of

    def value(ids: list[int]) -> tuple[bytes, bytes, bytes]:
        return array("I", ids).tobytes(), b"".join([text[i] for i in ids]), b"".join([raw[i] for i in ids])

    def combine(values: list[tuple[bytes, bytes, bytes]]) -> tuple[bytes, bytes, bytes]:
        return tuple(map(b"".join, zip(*values, strict=True))) if values else (b"", b"", b"")

    return bpe, Pieces(lambda w: value(bpe.word(w.encode())), combine, {t: value([i]) for t, i in bpe.special.items()})


def encode(text: str | None, path: str) -> list[int]:
    """The ids of one text."""
    return array("I", codec(path)[1].of(text or "")[0]).tolist()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a struct `bpe` of DIGESTS: the ids of the whole text, and what they decode to."""
    path = path or vocabulary_path()

    def one(texts: pa.Array) -> pa.Array:
        values, index, ends = codec(path)[1].gathered(texts)
        ids, decimals, raw = zip(*values, strict=True) if values else ((), (), ())
        n = np.diff(joined(ids, index, ends)[1]) // 4
        (listed, a), (bare, b) = joined(decimals, index, ends), joined(raw, index, ends)
        of_ids = [hashlib.sha256(listed[i : max(i, j - 1)]).hexdigest() for i, j in pairwise(a.tolist())]
        of_text = [hashlib.sha256(str(bare[i:j], "utf-8", "replace").encode()).hexdigest() for i, j in pairwise(b.tolist())]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([one(texts.slice(i, n)) for i, n in chunks(texts)]) if len(texts) else one(texts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("bpe", F.arrow_udf(run, DIGESTS)(F.col("text")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "bpe.*")
