"""Periodic runs of words by a suffix automaton.

The states of a document's suffix automaton are its repeated substrings; the ordered sets of their end positions are
merged up the suffix links, smaller into larger. Where two positions first become neighbours in a set, at distance d not
above the state's length l, the words of that state occur d apart and overlap or touch: a square with period d, which
begins l words before the earlier position since the state holds all that the two have in common. Seeds with equal
beginning and period belong to one run; the last of them ends where the run ends.

Only stretches of a document can hold runs where each word lies in six words that occur again there (a run's first
length - period >= 6 words occur again one period later); the automaton is built over these stretches alone.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Words of the shortest run, and the least that one period shares with the next in such a run.
SHORTEST = 12
SHARED = SHORTEST // 2
#: End positions in one block of an ordered set.
FAN = 512
#: Words that a worker numbers before it begins anew.
NUMBERED = 1_000_000

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHARED)], np.uint64)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """States of the suffix automaton of words: their lengths, their suffix links, and the state of each prefix."""
    length, link, step, prefix = [0], [-1], [{}], []
    last = 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(at + 1)
        step.append({})
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = step[p][word]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                clone = new + 1
                link.append(clone)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                link[q] = clone
        prefix.append(new)
        last = new
    return length, link, prefix


class Ends:
    """An ordered set of end positions in blocks, so that adding one moves few others."""

    def __init__(self, items: list[int]):
        self.blocks = [items[i : i + FAN] for i in range(0, len(items), FAN)]
        self.heads = [b[0] for b in self.blocks]
        self.size = len(items)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        return (x for b in self.blocks for x in b)

    def add(self, x: int) -> None:
        k = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > 2 * FAN:
            self.blocks[k : k + 1] = [block[:FAN], block[FAN:]]
            self.heads[k : k + 1] = [block[0], block[FAN]]

    def beside(self, x: int) -> tuple[int | None, int | None]:
        """The members next to the member x."""
        k = bisect_left(self.heads, x + 1) - 1
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after


def merged(large: list[int] | Ends, parts: list[list[int] | Ends]) -> tuple[list[int] | Ends, list[tuple[int, int]]]:
    """The union of disjoint ordered sets, the parts added to large, and the neighbours in it that come from two of them."""
    if len(parts) == 1 and len(parts[0]) == 1 and isinstance(large, list) and len(large) < 4 * FAN:
        (x,) = parts[0]
        i = bisect_left(large, x)
        pairs = ([(large[i - 1], x)] if i else []) + ([(x, large[i])] if i < len(large) else [])
        large.insert(i, x)
        return large, pairs
    came = {x: k for k, part in enumerate(parts) for x in part}
    if isinstance(large, list) and len(large) + len(came) > 4 * FAN:
        large = Ends(large)
    if isinstance(large, Ends):
        for x in came:
            large.add(x)
        near = [(x, *large.beside(x)) for x in came]
    else:
        large = sorted([*large, *came])
        end, near = len(large), []
        for x in came:
            i = bisect_left(large, x)
            near.append((x, large[i - 1] if i else None, large[i + 1] if i + 1 < end else None))
    return large, [(x, y) if x < y else (y, x) for x, *others in near for y in others if y is not None and came.get(y) != came[x]]


def runs_of(words: list[int], shortest: int = SHORTEST) -> dict[tuple[int, int], int]:
    """(start, period) to length, for all maximal runs of words with length >= max(shortest, 2 * period)."""
    length, link, prefix = automaton(words)
    held: list = [None] * len(length)
    for at, state in enumerate(prefix):
        held[state] = [at]
    least = shortest // 2
    last: dict[tuple[int, int], int] = {}
    # All that hangs below a state is merged before its neighbours are looked at, so none of them is passing.
    below: list[list | None] = [None] * len(length)
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        depth = length[state]
        if depth < least:
            break
        ends, parts = held[state], below[state]
        if parts:
            if ends is not None:
                parts.append(ends)
            parts.sort(key=len)
            ends, pairs = merged(parts.pop(), parts)
            for a, b in pairs:
                if b - a <= depth:
                    key = (a - depth + 1, b - a)
                    if last.get(key, -1) < b:
                        last[key] = b
        held[state], below[state] = None, None
        up = link[state]
        if up > 0 and length[up] >= least:
            if below[up] is None:
                below[up] = [ends]
            else:
                below[up].append(ends)
    return {k: b - k[0] + 1 for k, b in last.items() if b - k[0] + 1 >= max(shortest, 2 * k[1])}


def stretches(ids: np.ndarray, shared: int = SHARED, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Where runs can be: the longest stretches whose words all lie in ``shared`` words that occur twice or more in the
    stretch, looked at twice. Equal hashes of different words only make a stretch longer."""
    found = [(0, len(ids))]
    for _ in range(2):
        parts = []
        for lo, hi in found:
            n = hi - lo - shared + 1
            if hi - lo < shortest:
                continue
            h = np.zeros(n, np.uint64)
            own = ids[lo:hi].astype(np.uint64)
            own = (own + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            own ^= own >> np.uint64(32)
            for k in range(shared):
                h += own[k : k + n] * _MULTIPLIERS[k]
            ordered = np.sort(h)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if not len(twice):
                continue
            begins = np.isin(h, twice)
            edge = np.zeros(hi - lo + 1, np.int64)
            at = np.flatnonzero(begins)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + shared, -1)
            inside = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
            turn = np.flatnonzero(np.diff(inside))
            parts += [(lo + int(a), lo + int(b)) for a, b in zip(turn[::2], turn[1::2]) if b - a >= shortest]
        if parts == found:
            break
        found = parts
    return found


def document_runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document, by start, then period. ids: a number for each word."""
    out = []
    for lo, hi in stretches(ids, shortest // 2, shortest):
        out += [(lo + s, n, q) for (s, q), n in runs_of(ids[lo:hi].tolist(), shortest).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


class Numbers(dict):
    """Word to number, given when first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_tail(name: str, n: int) -> np.ndarray | None:
    """Which of the n words stands at each place of a document that is chosen to repeat its tail; null if it isn't."""
    h = zlib.crc32(name.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


FIELDS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
#: The same with the runs and the collapsed text themselves.
WHOLE = FIELDS + ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, place=None, whole: bool = True) -> DataFrame:
    """The runs of words of each document, and its text with each run collapsed to its first period.

    Words are what stands between ASCII white space. place(name, n): which original word stands at each of the n places
    of the document with this decimal doc_id, or null for the words as they are. A null text has no words and no runs; a
    null doc_id goes by the name '' for place. Rows that repeat a doc_id give a row each. A text is worked on whole, in
    one task, with about 1 KB of memory for each word of its repeating stretches. Of runs of equal length the first has
    the smallest start, then the smallest period. An empty table gives an empty result; extra columns are ignored.
    whole: with the columns runs and collapsed."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in slices(batches, 500):
            if len(numbers) > NUMBERED:
                numbers = Numbers()
            out, more = [], []
            texts = batch.column("text").cast(pa.large_binary())
            for name, text in zip(batch.column("doc_id").to_pylist(), texts):
                words = (text.as_py() or b"").split()
                ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                at = place("" if name is None else str(name), len(words)) if place else None
                if at is not None:
                    ids, words = ids[at], [words[i] for i in at.tolist()]
                runs = document_runs(ids)
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        edge[s + q] += 1
                        edge[s + n] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                    best = (s, n, q, 1000 * n // q)
                else:
                    kept, best = words, (None,) * 4
                collapsed = b" ".join(kept)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append((name, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
                if whole:
                    more.append(([dict(zip(("start", "length", "period"), r)) for r in runs], collapsed.decode()))
            columns = [pa.array(x, pa.int64() if i < 6 else pa.string()) for i, x in enumerate(zip(*out))]
            if whole:
                runs, texts = zip(*more)
                columns += [pa.array(runs, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names + ["runs", "collapsed"] * whole)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(find, WHOLE if whole else FIELDS)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which one in ten repeats its tail."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeated_tail, whole=False)
