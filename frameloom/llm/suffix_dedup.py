"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept only at minimiser positions: the smallest hash of ``gram`` words in each run of such hashes that a
passage of ``least`` words must contain. Equal passages of that length keep equal positions. Suffixes whose first words
occur in more than one document take part:

* They are sorted by their following words, and by the words before them read backwards, and neighbours in either order are
  compared: the lengths of their common beginnings part the order into intervals, one for each number of words to the right
  or to the left. A suffix's ``least`` words with l of them on the left repeat where an interval of l words to the left
  and one of least - gram - l to the right have suffixes of two documents in common, whoever lies between them in either
  order. So matches extend to both sides at once, and nothing is compared pair by pair.
* Where more than WHOLE suffixes begin alike (a passage of a third of all documents), no task can sort them all. There each
  run of ``least`` words is known by its 64-bit hash and belongs to the one suffix that is its minimiser. Suffixes with
  the same runs are counted as one; a run that two documents hold is a repeated passage. No partner is left out,
  however many there are.

Spans of a document are then merged. Of documents with equal texts one takes part; all of them are repeats from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bits_for, maybe_in, slices, texts_of, without, written

LEAST = 50
GRAM = 10
#: Suffixes that begin alike are sorted in one task up to this number; larger groups go by the hashes of their runs.
WHOLE = 4096
#: Runs of one row at most; they are numbered by the bits of a bigint.
PART = 60
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 20) - 1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word: a run without ASCII white space, A-Z lower-cased."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    n = len(h) - gram + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(gram if n > 0 else 0):
        out = (out ^ h[i : n + i]) * _M1
        out ^= out >> np.uint64(29)
    return out * _M2


def _owners(g: np.ndarray, run: int) -> np.ndarray:
    """For every ``run`` neighbours the position of the smallest hash (the first of equals); none if there are fewer."""
    n = len(g)
    if n < run:
        return np.empty(0, np.int64)
    key = (g & ~_LOW) | (np.arange(n, dtype=np.uint64) & _LOW)
    blocks = -(-n // run)
    padded = np.full(blocks * run, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, run)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(n - run + 1)
    least = np.minimum(behind[: n - run + 1], ahead[run - 1 : n])
    return first + ((least & _LOW).astype(np.int64) - first) % (1 << 20)


def minimisers(g: np.ndarray, run: int) -> np.ndarray:
    """Positions of the smallest hash in every ``run`` neighbours."""
    return np.unique(_owners(g, run))


def _anchors(text: str | None, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; hash and place of each minimiser; the first of the runs that it owns, and their number."""
    h = word_hashes(text)
    g = gram_hashes(h, gram)
    at, first, runs = np.unique(_owners(g, least - gram + 1), return_index=True, return_counts=True)
    return h, g[at].view(np.int64) if len(at) else np.empty(0, np.int64), at, first, runs


def repeated_grams(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """g: hashes at minimiser positions that occur in more than one document; n: how many suffixes begin so."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, grams, times = [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                g, n = np.unique(_anchors(text, least, gram)[1], return_counts=True)
                rows.append(np.full(len(g), i)), grams.append(g), times.append(n)
            row, g, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, grams, times))
            yield pa.RecordBatch.from_arrays([pa.array(g), batch.column("doc_id").take(pa.array(row)), pa.array(n)], ["g", "doc_id", "n"])

    rows = docs.mapInArrow(anchors, "g bigint, doc_id bigint, n bigint")
    return rows.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("n")).where("a < b").select("g", "n")


def _bits(grams: DataFrame) -> np.ndarray:
    """A bitmap of the hashes, 2 to 64 MB by their number, eight to a byte. A set bit is a candidate; false ones only cost
    time."""
    size = bits_for(grams.count())
    at = F.pmod("g", F.lit(size))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, data in grams.groupBy(F.floor(at / 32768).alias("b")).agg(F.bitmap_construct_agg(at % 32768)).toLocalIterator():
        bits[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bytes(data), np.uint8)
    return bits


def _has(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = g % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _joined_runs(g: list[int], first: list[int], owned: list[int]) -> list[tuple[int, int, int]]:
    """Rows of at most PART neighbouring runs: g of the suffix that begins a row, the row's first run and its end. Suffixes
    whose runs follow one another share a row; where rows end goes by the suffixes' hashes, so that copies are cut alike. A
    suffix like the one before it ends no row: in a line said over and over all suffixes are alike, and each would."""
    parts: list[list[int]] = []
    last = None
    for x, start, n in zip(g, first, owned):
        if parts and parts[-1][2] == start and start + n - parts[-1][1] <= PART and (x & 3 or x == last):
            parts[-1][2] = start + n
        else:
            parts.append([x, start, start + n])
        last = x
    return [(x, y, min(y + PART, end)) for x, start, end in parts for y in range(start, end, PART)]


_ROW = "g bigint, doc_id bigint, at bigint, words bigint, ahead binary, back binary, runs array<bigint>"


def suffixes(docs: DataFrame, bits: np.ndarray, many: np.ndarray, least: int, gram: int) -> DataFrame:
    """g, doc_id, at (word), words (of the document), ahead and back (four bytes for each of the next, previous words).
    Suffixes whose g is in ``many`` have, in place of ahead and back, at as the first of the runs they own, and the
    hashes of these runs of ``least`` words."""
    told = docs.sparkSession.sparkContext.broadcast((bits, many))
    far = least - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, crowd = told.value
        for batch in slices(batches):
            rows, grams, ats, sizes, aheads, backs, runs = [], [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                h, g, at, first, owned = _anchors(text, least, gram)
                hit = _has(known, g)
                g, at, first, owned = g[hit], at[hit], first[hit], owned[hit]
                if not len(at):
                    continue
                n = len(h)
                large = _has(crowd, g)
                if large.any():
                    whole = gram_hashes(h, least).view(np.int64)
                    cuts = _joined_runs(g[large].tolist(), first[large].tolist(), owned[large].tolist())
                    runs += [whole[y:z] for _, y, z in cuts]
                    k = len(cuts)
                    aheads += [None] * k
                    backs += [None] * k
                    rows.append(np.full(k, i)), grams.append(np.array([x for x, _, _ in cuts])), ats.append(np.array([y for _, y, _ in cuts])), sizes.append(np.full(k, n))
                g, at = g[~large], at[~large]
                if len(at):
                    short = np.concatenate([h >> np.uint64(32), np.zeros(1, np.uint64)]).astype(">u4")
                    right = at[:, None] + gram + np.arange(far)
                    left = at[:, None] - 1 - np.arange(far)
                    aheads += [x.tobytes() for x in short[np.minimum(right, n)]]
                    backs += [x.tobytes() for x in short[np.where(left < 0, n, left)]]
                    runs += [None] * len(at)
                    rows.append(np.full(len(at), i)), grams.append(g), ats.append(at), sizes.append(np.full(len(at), n))
            row, g, at, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, grams, ats, sizes))
            yield pa.RecordBatch.from_arrays([pa.array(g), batch.column("doc_id").take(pa.array(row)), pa.array(at), pa.array(n), pa.array(aheads, pa.binary()), pa.array(backs, pa.binary()), pa.array(runs, pa.list_(pa.int64()))], ["g", "doc_id", "at", "words", "ahead", "back", "runs"])

    return docs.mapInArrow(cut, _ROW)


def _steps(g: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row of an order, how many words it begins with as the row before it does; -1 where g changes."""
    if not len(g):
        return np.empty(0, np.int64)
    same = words[1:] == words[:-1]
    common = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
    return np.concatenate([[-1], np.where(g[1:] == g[:-1], common, -1)])


def _shared(t: pa.Table, least: int, gram: int) -> pa.Table:
    """doc_id, start, stop, twin of the passages of whole groups of suffixes, which are sorted by g and ahead."""
    n, far = t.num_rows, least - gram
    g, doc, at, words = (t.column(c).to_numpy() for c in ("g", "doc_id", "at", "words"))
    as_grid = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(n, -1)
    ahead, back = as_grid("ahead"), as_grid("back")
    # The order to the left: by g, then by the words before the suffix, the nearest first.
    keyed = np.concatenate([g.astype(">i8").view(np.uint8).reshape(n, 8), np.ascontiguousarray(back).view(np.uint8).reshape(n, -1)], axis=1)
    leftward = np.argsort(keyed.view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    right_steps, left_steps = _steps(g, ahead), _steps(g[leftward], back[leftward])
    room = np.minimum(words - at - gram, far)
    hit, twin = np.zeros((n, far + 2), np.int8), np.full(n, np.iinfo(np.int64).max)
    for left in range(far + 1):
        right = far - left
        rows = np.flatnonzero((at >= left) & (room >= right))
        if len(rows) < 2:
            continue
        interval = np.empty(n, np.int64)
        interval[leftward] = np.cumsum(left_steps < left)
        key = np.cumsum(right_steps < right)[rows] * (n + 1) + interval[rows]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*first, len(rows)])
        least_doc, most_doc = (np.repeat(f.reduceat(doc[rows], first), size) for f in (np.minimum, np.maximum))
        two = least_doc != most_doc
        rows = rows[two]
        hit[rows, left + 1] = 1
        other = np.where(least_doc[two] != doc[rows], least_doc[two], most_doc[two])
        twin[rows] = np.minimum(twin[rows], other)
    # Neighbouring l are one span: from the largest of them to the left to the smallest's end on the right.
    turn = np.diff(np.concatenate([hit, np.zeros((n, 1), np.int8)], axis=1), axis=1)
    row, lo = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    return pa.table({"doc_id": doc[row], "start": at[row] - (end - 1), "stop": at[row] - lo + least, "twin": twin[row]})


def _sorted(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """Spans found in the sorted order of the suffixes; a group of at most WHOLE that begin alike is in one task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # where the last group begins, which may go on
            if cut == 0 and held and held[-1].column("g")[-1].as_py() == g[-1]:
                held.append(batch)
                continue
            yield from _spans_of([*held, batch.slice(0, cut)], least, gram)
            held = [batch.slice(cut)]
        yield from _spans_of(held, least, gram)

    ordered = rows.repartition("g").sortWithinPartitions("g", "ahead")
    return ordered.mapInArrow(compare, "doc_id bigint, start bigint, stop bigint, twin bigint")


def _spans_of(parts: list[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches([p for p in parts if p.num_rows]).combine_chunks() if any(p.num_rows for p in parts) else None
    if t is not None and t.num_rows > 1:
        found = _shared(t, least, gram).group_by(["doc_id", "start", "stop"]).aggregate([("twin", "min")]).rename_columns(["doc_id", "start", "stop", "twin"])
        yield from found.combine_chunks().to_batches()


def _crowded(rows: DataFrame, least: int) -> DataFrame:
    """Spans of the runs that more than one document holds. rows: doc_id, at (of the first run), runs (hashes).
    Rows with the same runs form a kind; where one document alone has the kind, its runs are looked up one by one."""
    rows = rows.select("doc_id", "at", "runs", F.xxhash64("runs").alias("kind"))
    kinds = written(rows.groupBy("kind", "runs").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")), "kinds")
    each = kinds.select("kind", "a", "b", F.posexplode("runs").alias("i", "run"))
    shared = each.groupBy("run").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b")
    alone = each.where("a = b").select("kind", "run", "i").join(shared, "run")
    bit = F.expr("shiftleft(cast(1 as bigint), i)")
    alone = alone.groupBy("kind").agg(F.bit_or(bit).alias("bits"), F.min("a").alias("a"), F.max("b").alias("b"))
    full = kinds.where("a < b").select("kind", F.expr("shiftleft(cast(1 as bigint), size(runs)) - 1").alias("bits"), "a", "b")
    first = F.expr("filter(sequence(0, 62), i -> (shiftright(bits, i) & 1) = 1 and (i = 0 or (shiftright(bits, i - 1) & 1) = 0))")
    last = F.expr("filter(sequence(0, 62), i -> (shiftright(bits, i) & 1) = 1 and (shiftright(bits, i + 1) & 1) = 0)")
    parts = written(alone.unionByName(full).select("kind", "a", "b", F.arrays_zip(first.alias("lo"), last.alias("hi")).alias("parts")), "parts")
    found = rows.select("doc_id", "at", "kind").join(parts, "kind").select("doc_id", "at", "a", "b", F.inline("parts"))
    twin = F.when(F.col("a") != F.col("doc_id"), F.col("a")).otherwise(F.col("b"))
    return found.select("doc_id", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + least).alias("stop"), twin.alias("twin"))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch, joined: doc_id, start, stop, twin (the smallest)."""
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_to"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = spans.withColumn("_to", before).withColumn("_island", island).groupBy("doc_id", "_island")
    return grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("twin").alias("twin")).drop("_island")


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, twin_id for each passage of at least ``least`` words that
    another document holds too; twin_id is another document that shares a part of it: the smallest that holds the same
    ``least`` words somewhere, or the largest where the document is itself the smallest.

    Words are runs without ASCII white space, A-Z lower-cased. Null and short texts have no passages; rows with a null
    doc_id take no part; rows that repeat a doc_id count as one document. Repeats within one document alone don't count.
    Words are told apart by 32 bits of their hashes beyond the first ``gram``, which are told apart by 64 bits together; in
    groups above WHOLE, runs by 64 bits. Empty tables give empty results; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    hashed = rows.withColumns({"_h": F.xxhash64("text"), "_k": F.xxhash64(F.lit(5), "text")})
    copies = written(_copies(hashed), "copies")
    first = without(hashed, ["doc_id", "_h", "_k"], copies.where("doc_id > first").select("doc_id", "_h", "_k")).select("doc_id", "text")
    grams = written(repeated_grams(first, least, gram), "grams")
    kept = written(suffixes(first, _bits(grams), _bits(grams.where(F.col("n") > WHOLE)), least, gram), "suffixes")
    few, many = kept.where("runs is null").drop("runs"), kept.where("runs is not null")
    whole = copies.where(F.col("words") >= least).select("doc_id", F.lit(0).cast("bigint").alias("start"), F.col("words").alias("stop"), F.when(F.col("first") < F.col("doc_id"), F.col("first")).otherwise(F.col("final")).alias("twin"))
    spans = _sorted(few, least, gram).unionByName(_crowded(many, least)).unionByName(whole).groupBy("doc_id", "start", "stop").agg(F.min("twin").alias("twin"))
    return merged(spans).select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("twin").alias("twin_id"))


def _copies(hashed: DataFrame) -> DataFrame:
    """doc_id, _h, _k, words, first, final for each document whose text (by 128 bits) another one has, too: the number of its
    words and the smallest and largest document with it. Such a document is a repeat from end to end, so the smallest
    alone stands for all of them among the suffixes."""
    words = F.regexp_count("text", F.lit(WORD)).cast("bigint")
    keys = ["_h", "_k"]
    groups = written(hashed.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")).where("first < final"), "equal")
    # A bitmap clears the texts without copies, so few are shuffled.
    return maybe_in(hashed, keys, groups).join(groups, keys).select("doc_id", *keys, words.alias("words"), "first", "final").distinct()


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
