"""Token ids as wavelet matrices: one compressed file a shard, with rank and select on its bit-planes.

A wavelet matrix holds a sequence of ids as one bit-plane for each bit, highest first; below each plane the sequence is
stably parted into zeros and ones. With the ones counted before each block of a plane (rank) and their places (select),
a file answers which id stands at a place, how often an id occurs and where, by reading a block or two of each plane.

File format, version 1 (little-endian). Blocks of 65,536 bits of plane 0, 1, ..., each packed highest bit first and
compressed by itself with zstandard; then the sections ``offsets`` (8 bytes: where each block begins, and the end of the
last), ``ones`` (8 bytes: ones of the plane before each block), ``doc_ids`` and ``lengths`` (8 bytes each, one entry for
each document or part of one), ``nulls`` (1 byte: the doc_id is null), all compressed; then a JSON object with n, bits,
zeros (of each plane), continued and open (the first document began in an earlier shard, the last goes on in a later
one) and the place of each section; then the object's length (4 bytes) and the sign WMX1.
"""

from __future__ import annotations

import contextlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import located, rooted, shared_dir, slices, texts_of, written
from .packing import _BYTES

SIGN = b"WMX1"
#: Bits of one block of a plane.
BLOCK = 1 << 16
#: Tokens of one shard file. A longer document goes on in the next shard.
SHARD_TOKENS = 2_000_000
END_ID = 0
SECTIONS = ("offsets", "ones", "doc_ids", "lengths", "nulls")


def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def packed(ids: np.ndarray, bits: int, doc_ids: list[int | None], lengths: list[int], continued: bool = False, open_end: bool = False) -> bytes:
    """The bytes of a shard file that holds ids (each below 2**bits)."""
    squeeze, _ = _zstd()
    n = len(ids)
    body, offsets, ones, zeros, at = [], [], [], [], 0
    v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits):
        bit = (v & v.dtype.type(1 << (bits - 1 - level))).astype(bool)
        before = 0
        for lo in range(0, n, BLOCK):
            part = bit[lo : lo + BLOCK]
            body.append(squeeze.compress(np.packbits(part).tobytes()))
            offsets.append(at)
            ones.append(before)
            at += len(body[-1])
            before += int(np.count_nonzero(part))
        zeros.append(n - before)
        v = np.concatenate([v[np.flatnonzero(~bit)], v[np.flatnonzero(bit)]])
    offsets.append(at)
    sections = dict(zip(SECTIONS, (np.array(offsets, "<i8"), np.array(ones, "<i8"), np.array([x or 0 for x in doc_ids], "<i8"), np.array(lengths, "<i8"), np.array([x is None for x in doc_ids], "u1"))))
    about = {"n": n, "bits": bits, "zeros": zeros, "continued": continued, "open": open_end}
    for name, values in sections.items():
        body.append(squeeze.compress(values.tobytes()))
        about[name] = [at, len(body[-1])]
        at += len(body[-1])
    footer = json.dumps(about).encode()
    return b"".join(body) + footer + struct.pack("<I", len(footer)) + SIGN


class Shard:
    """A shard file that is open for reading. read: a function from (place, length) to bytes; size: the file's length."""

    def __init__(self, read, size: int):
        self.read, (_, self.squeeze) = read, _zstd()
        tail = read(size - 8, 8)
        if tail[4:] != SIGN:
            raise ValueError("not a wavelet shard")
        length = struct.unpack("<I", tail[:4])[0]
        about = json.loads(read(size - 8 - length, length))
        self.n, self.bits, self.zeros, self.continued, self.open = (about[k] for k in ("n", "bits", "zeros", "continued", "open"))
        kinds = dict(zip(SECTIONS, ("<i8", "<i8", "<i8", "<i8", "u1")))
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(self.squeeze.decompress(read(*about[name])), kind))
        self.blocks = -(-self.n // BLOCK)

    def block(self, level: int, b: int) -> np.ndarray:
        """The bits of one block, a byte each."""
        k = level * self.blocks + b
        data = self.read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
        return np.unpackbits(np.frombuffer(self.squeeze.decompress(data), np.uint8), count=min(BLOCK, self.n - b * BLOCK))

    def ranks(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at places 0..n, and the ones before them; beyond the end the bit is 0."""
        bit, rank = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        which = np.minimum(at >> 16, max(self.blocks - 1, 0))
        for b in np.unique(which) if self.n else ():
            here = which == b
            bits = np.concatenate([self.block(level, int(b)), [0]]).astype(np.int64)
            inside = at[here] - b * BLOCK
            bit[here] = bits[inside]
            rank[here] = self.ones[level * self.blocks + b] + np.concatenate([[0], np.cumsum(bits)])[inside]
        return bit, rank

    def select(self, level: int, nth: np.ndarray, bit: int) -> np.ndarray:
        """The places of the nth (from 0) bits of this value in a plane."""
        ones = self.ones[level * self.blocks : (level + 1) * self.blocks]
        before = ones if bit else np.arange(self.blocks) * BLOCK - ones
        which = np.searchsorted(before, nth, "right") - 1
        out = np.zeros(len(nth), np.int64)
        for b in np.unique(which):
            here = which == b
            out[here] = np.flatnonzero(self.block(level, int(b)) == bit)[nth[here] - before[b]] + b * BLOCK
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at, ids = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for level in range(self.bits):
            bit, rank = self.ranks(level, at)
            ids = ids << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + rank, at - rank)
        return ids

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of an id among places lo..hi-1 lie below the last plane."""
        ends = np.array([lo, hi], np.int64)
        for level in range(self.bits):
            _, rank = self.ranks(level, ends)
            ends = self.zeros[level] + rank if token >> (self.bits - 1 - level) & 1 else ends - rank
            if ends[0] == ends[1]:
                break
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs among places lo..hi-1."""
        if not 0 <= token < 1 << self.bits:
            return 0
        first, end = self._span(token, lo, self.n if hi is None else hi)
        return end - first

    def positions(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The places of an id among lo..hi-1, ascending."""
        if not self.count(token, lo, hi):
            return np.zeros(0, np.int64)
        at = np.arange(*self._span(token, lo, self.n if hi is None else hi), dtype=np.int64)
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            at = self.select(level, at - self.zeros[level] * one, one)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: what lies below the last plane is merged upwards, plane by plane."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.concatenate([self.block(level, b) for b in range(self.blocks)] or [np.zeros(0, np.uint8)]) == 1
            above = np.empty_like(v)
            above[np.flatnonzero(~bit)] = v[: self.zeros[level]]
            above[np.flatnonzero(bit)] = v[self.zeros[level] :] | v.dtype.type(1 << (self.bits - 1 - level))
            v = above
        return v


# Text to ids

#: Pieces whose ids a worker remembers in each of two generations (when the younger is full it becomes the older); a longer
#: piece isn't remembered.
CACHE, LONGEST = 250_000, 100
#: How byte-level vocabularies cut text, as Latin-1 has it: letters, numbers and white space of its 256 characters.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = chr(_BYTES[32])
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\x09-\x0d\x20\x85\xa0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Ids(dict):
    """Piece to ids (little-endian 32-bit bytes) of a byte-level tokenizer, remembered. ids(text) equals encoding the
    whole text: a Latin-1 text without special tokens is cut by the tokenizer's own pattern, and its pieces go through the
    tokenizer's model; any other text goes through the tokenizer as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.older = self.tokenizer.model, {}
        setup = json.loads(self.tokenizer.to_str())
        split = setup.get("pre_tokenizer") or {}
        self.plain = setup.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            shown = piece.replace(" ", _SPACE) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
            found = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.special) or not text.isascii() and _beyond_latin(text):
            return self._whole(text)
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, _LATIN.findall(text)))


def _beyond_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Shards

MANIFEST = "part int, seq int, path string, n_tokens bigint, n_docs bigint, bytes bigint"


def _opened(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """A whole file or none: it is written beside its place and moved there. A task that runs again replaces it."""
    store, place = _opened(path)
    store.create_dir(place.rsplit("/", 1)[0])
    beside = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as f:
        f.write(data)
    store.move(beside, place)


@contextlib.contextmanager
def open_shard(path: str) -> Iterator[Shard]:
    store, place = _opened(path)
    with store.open_input_file(place) as f:

        def read(at: int, length: int) -> bytes:
            f.seek(at)
            return f.read(length)

        yield Shard(read, f.size())


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All texts as token ids in ascending order of doc_id, in shard files below folder; returns the manifest (a written
    table): a row for each file, files in the order part, seq.

    Each document's ids are followed by end_id. A null text is empty. A null doc_id comes first and stays null; rows that
    repeat a doc_id follow one another in the order of the table's files. A document longer than a shard's room goes on
    in the next file; a task holds one shard. An empty table gives no file. Extra columns are ignored. folder: a URI or
    path that driver and executors share."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer or default_tokenizer())
        end = np.array([end_id], "<u4").tobytes()
        held, names, lengths, room, seq, part, continued = [], [], [], shard_tokens, 0, 0, False

        def closed(open_end: bool) -> pa.RecordBatch:
            data = packed(np.frombuffer(b"".join(held), "<u4"), ids.bits, names, lengths, continued, open_end)
            path = f"{folder}/shard-{part:06d}-{seq:06d}.wm"
            _put(path, data)
            values = (part, seq, path, sum(lengths), len(names), len(data))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], [x.split()[0] for x in MANIFEST.split(", ")])

        for batch in slices(batches, 2000):
            part = batch.column("part")[0].as_py()
            for name, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                data = ids.ids(text or "") + end
                at, n = 0, len(data) // 4
                while at < n:
                    if room == 0:
                        yield closed(at > 0)
                        held, names, lengths, room, seq, continued = [], [], [], shard_tokens, seq + 1, at > 0
                    take = min(room, n - at)
                    held.append(data[4 * at : 4 * (at + take)])
                    names.append(name)
                    lengths.append(take)
                    at, room = at + take, room - take
        if names:
            yield closed(False)

    docs = rooted(docs)
    rows = located(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "_file", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return written(ranged.mapInArrow(encode, MANIFEST), "shards")


def _started(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids before each file. Totals are summed for each part first, so that one task
    sees a row a part, of which there are no more than shuffle partitions."""
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = totals.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return manifest.withColumn("_inside", before).join(base, "part").withColumn("start", F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def _files(manifest: DataFrame) -> DataFrame:
    """The manifest with starts, a part's files in one task and in order, as many tasks as parts."""
    parts = manifest.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    return _started(manifest).repartitionById(parts, F.col("part")).sortWithinPartitions("seq").select("seq", "path", "start", "n_tokens")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the ids in the shard files."""
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = n = 0
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_shard(path) as shard:
                    data = shard.ids().astype("<u4")
                    rows, at, last = [], 0, len(shard.lengths) - 1
                    for i, (name, null, length) in enumerate(zip(shard.doc_ids.tolist(), shard.nulls.tolist(), shard.lengths.tolist())):
                        crc = zlib.crc32(data[at : at + length], crc)
                        at, n = at + length, n + length
                        if i < last or not shard.open:
                            rows.append((None if null else name, start + at - n, n, crc))
                            crc = n = 0
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names)

    return _files(manifest).mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of a few given ids occurs in all shards; a block or two of each plane is read."""
    tokens = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_shard(path) as shard:
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return _files(manifest).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, place: every place (from 0, over all shards) of each of a few given ids."""
    tokens = sorted(set(tokens))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_shard(path) as shard:
                    for token in tokens:
                        at = shard.positions(token) + start
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), pa.array(at)], ["token", "place"])

    return _files(manifest).mapInArrow(find, "token bigint, place bigint")


def tokens_at(manifest: DataFrame, places: DataFrame) -> DataFrame:
    """place, token for each row of places (column place, from 0 over all shards); places outside give null."""
    files = _started(manifest)
    step = SHARD_TOKENS
    cover = files.select("path", "start", "n_tokens", F.explode(F.expr(f"sequence(start div {step}, (start + n_tokens - 1) div {step})")).alias("_slot"))
    found = places.select("place").withColumn("_slot", F.expr(f"place div {step}")).join(cover, "_slot", "left").where("start is null or place between start and start + n_tokens - 1")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            place, start = batch.column("place").to_numpy(), batch.column("start").to_numpy()
            token = np.full(len(paths), -1, np.int64)
            for path in set(paths):
                with open_shard(path) as shard:
                    here = paths == path
                    token[here] = shard.access(place[here] - start[here])
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(token)], ["place", "token"])

    inside = found.where("start is not null").repartition("path").select("path", "place", "start").mapInArrow(look, "place bigint, token bigint")
    return places.select("place").join(inside.distinct(), "place", "left")


def op11_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to wavelet shards in a new folder and read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_shards(docs, shared_dir(spark, "wavelet")))
