"""Packing by best-fit decreasing.

Documents become token ids and an end id; each is cut into full windows and one tail. Best-fit decreasing only looks
at lengths, and there are at most ``window`` of them, so the plan is made from the counts of pieces by length: a
segment tree indexed by remaining capacity finds the tightest open window for each length, many equal pieces at a time.
The plan has no more entries than pairs of length and capacity, whatever the number of documents. Pieces then take
their places by their rank among pieces of the same length.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, texts_of, written

WINDOW = 4096
END_ID = 2
#: Pieces whose ids a worker remembers in each of two generations; when the younger is full it becomes the older.
CACHE_WORDS = 150_000


#: Bytes as the printable characters that byte-level tokenizers use: those that print stand for themselves, the others
#: follow from U+0100 on in their order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: The pattern by which the vocabulary's tokenizer cuts text, and what it comes to in lower-cased Latin-1.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\x09-\x0d\x20\x85\xa0"
_LATIN = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


class _Memory(dict):
    """Ids of words or pieces, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.make(word)
        return found


class WordIds:
    """Token ids of a text as little-endian 32-bit bytes, with a memory for pieces seen before.

    Equal to encoding the whole text. A Latin-1 text is lower-cased and cut as the tokenizer does it: there are no
    characters to compose. Any other text is cut at spaces and line feeds, since no step of the tokenizer looks across
    white space, and its words go through the tokenizer's own steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        setup = json.loads(self.tokenizer.to_str())
        split = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        kinds = [x["type"] for x in (setup.get("normalizer") or {}).get("normalizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") and sys.byteorder == "little"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(self.special)  # what each special token begins with
        self.pieces, self.older = _Memory(self._piece), {}
        self.words = _Memory(self._word)

    def _piece(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
            found = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        return found

    def _word(self, word: str) -> bytes:
        t = self.tokenizer
        if self.sign in word and any(s in word for s in self.special):
            return np.array(t.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))
        return b"".join(array("I", [y.id for y in self.model.tokenize(x)]).tobytes() for x, _ in found)

    def _is_latin(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self.plain and self.sign not in text

    def __call__(self, text: str) -> bytes:
        if len(self.pieces) > CACHE_WORDS:
            self.older, self.pieces = self.pieces, _Memory(self._piece)
        if len(self.words) > CACHE_WORDS // 4:
            self.words.clear()
        if not self._is_latin(text):
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.pieces.__getitem__, _LATIN.findall(text.lower())))


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece, with its rank ``nth`` among the pieces of its length
    in its task ``task``. tokenizer: a file's place on each executor; by default the installed vocabulary's own place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer or default_tokenizer())
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = {}
        for batch in slices(batches, 2000):
            out = []
            for row, text in enumerate(texts_of(batch.column("text"))):
                data = encode(text or "") + end
                n = len(data) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    out.append((row, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, nth))
            row, start, length, crc, n, nth = (pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 6))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), start, length, crc, n, batch.column("task").take(row), nth], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.spark_partition_id().cast("bigint").alias("task"))
    return rows.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, nth bigint")


class Tightest:
    """A segment tree over remaining capacities 0..window: how many windows are open at each, and the smallest
    capacity at or above a given one that has any."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += n
            at //= 2

    def at_least(self, capacity: int) -> int | None:
        at = capacity + self.size
        if self.open[at]:
            return capacity
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over pieces given by length. For each length entries (first rank, pieces in a window, first
    window, offset): the pieces from that rank on lie side by side in consecutive windows, at that offset."""
    tree = Tightest(window)
    held: dict[int, list[list[int]]] = {}  # by remaining capacity: runs [first window, windows]
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    windows = 0

    def put(capacity: int, first: int, n: int) -> None:
        held.setdefault(capacity, []).append([first, n])
        tree.add(capacity, n)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank, entries = counts[length], 0, out.setdefault(length, [])
        while left:
            room = tree.at_least(length)
            if room is None:
                room, need = window, -(-left // (window // length))
                put(room, windows, need)
                windows += need
            # The tightest window takes pieces until none fits; so do all windows that are as tight.
            fit, run = room // length, held[room][0]
            whole = min(run[1], left // fit)
            n, k = (whole, fit) if whole else (1, left)
            entries.append((rank, k, run[0], window - room))
            tree.add(room, -n)
            put(room - k * length, run[0], n)
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                held[room].pop(0)
            rank, left = rank + n * k, left - n * k
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each row of docs.

    A text's ids are followed by end_id; null text counts as empty, so its one piece is that id. Long texts are cut into
    full windows and a tail; nothing is dropped. Sequences are numbered from 0, and pieces in them touch. Rows that
    repeat a doc_id are packed like any others. Empty tables give empty results; extra columns are ignored.
    """
    cut = written(pieces(docs, tokenizer, window, end_id), "pieces")
    per = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length: at most window rows
    steps = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in plan(counts, window).items()}
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = docs.sparkSession.sparkContext.broadcast(steps)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, fit, window_id, at = told.value[int(length)]
                i = np.searchsorted(first, ranks[rows], side="right") - 1
                j = ranks[rows] - first[i]
                sequence[rows] = window_id[i] + j // fit[i]
                offset[rows] = at[i] + (j % fit[i]) * length
            kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ranked = cut.join(before.drop("n"), ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def place_of(steps: dict[int, list[tuple[int, int, int, int]]], length: int, rank: int) -> tuple[int, int]:
    """Window and offset of one piece, for tests and small uses."""
    entries = steps[length]
    first, fit, window_id, at = entries[bisect_right([e[0] for e in entries], rank) - 1]
    return window_id + (rank - first) // fit, at + (rank - first) % fit * length


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
