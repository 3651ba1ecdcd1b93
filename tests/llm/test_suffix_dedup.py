import random

import numpy as np
import pytest

from frameloom.llm import suffix_dedup as s
from tests.llm.conftest import prose


def covered(rows, least, cut=lambda text: text.lower().split()):
    """Words inside any run of ``least`` words that another document has too."""
    words = {}
    for doc_id, text in rows:
        if doc_id is not None:
            words.setdefault(doc_id, cut(text or ""))
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, w in words.items():
        mark = np.zeros(len(w), bool)
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                mark[i : i + least] = True
        out[d] = mark
    return out


@pytest.fixture(params=[4096, 3])
def whole(request, monkeypatch):
    """Groups sorted whole, and all but the smallest by the hashes of their runs."""
    monkeypatch.setattr(s, "WHOLE", request.param)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, whole):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(45, 90)) for _ in range(6)]
    rows = []
    for d in range(40):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(3)]
        for at in rng.sample(range(3), rng.randint(0, 2)):
            parts[at] += " " + rng.choice(passages)
        rows.append((d, " ".join(parts)))
    got = {d: np.zeros(len(t.split()), bool) for d, t in rows}
    for r in s.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.twin_id != r.doc_id
        got[r.doc_id][r.start_word : r.end_word] = True
    want = covered(rows, 50)
    assert all((got[d] == want[d]).all() for d in want)


def test_minimisers_are_kept_in_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 2**63, 500, dtype=np.uint64)
    at = set(s.minimisers(g, 41).tolist())
    key = (g & ~s._LOW).tolist()
    for i in range(len(g) - 40):
        window = key[i : i + 41]
        assert i + window.index(min(window)) in at
    assert len(s.minimisers(g[:40], 41)) == 0


def test_odd_rows(odd):
    got = s.repeats(odd).collect()
    assert {r.doc_id for r in got} == {6, 7, 8, 9, 10}
    assert {r.doc_id: r.twin_id for r in got}[9] == 10


def test_empty(empty):
    assert s.repeats(empty).count() == 0


def marks(spark, rows):
    got = {d: np.zeros(len(t.split()), bool) for d, t in rows}
    for r in s.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.twin_id != r.doc_id
        got[r.doc_id][r.start_word : r.end_word] = True
    return got


def test_hundreds_of_repeats_in_one_document(spark, whole):
    rng = random.Random(8)
    passage = prose(rng, 55)
    often = lambda n: (prose(rng, 45) + " " + passage + " ") * n
    rows = [(1, often(300)), (2, often(200)), (3, prose(rng, 80)), (4, prose(rng, 20) + " " + passage)]
    got, want = marks(spark, rows), covered(rows, 50)
    assert all((got[d] == want[d]).all() for d in want) and want[1].sum() >= 300 * 55


def test_frequent_middle_with_both_sides_shared(spark, whole):
    """A line of 40 words between every left and every right side; a few documents have one partner that shares both."""
    rng = random.Random(9)
    line = prose(rng, 40)
    lefts, rights = [[prose(rng, 6) for _ in range(30)] for _ in range(2)]
    cells = [(i, j) for i in range(30) for j in range(30)] + [(i, 29 - i) for i in range(10)]
    rows = [(d, f"{prose(rng, 30)} {lefts[i]} {line} {rights[j]} {prose(rng, 30)}") for d, (i, j) in enumerate(cells)]
    got, want = marks(spark, rows), covered(rows, 50)
    assert all((got[d] == want[d]).all() for d in want)
    assert sum(w.any() for w in want.values()) >= 20


def test_whole_table_against_brute_force(spark):
    """All documents of sf0.01: no word missed, none too many."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = covered(rows, 50, lambda t: t.encode().lower().split())
    got = {d: np.zeros(len(w), bool) for d, w in want.items()}
    for r in s.op4_suffix_dedup(spark, "/root/testdata/sf0.01").collect():
        got[r.doc_id][r.start_word : r.end_word] = True
    assert sum(int(w.sum()) for w in want.values()) > 50_000
    assert all((got[d] == want[d]).all() for d in want)


def test_a_large_group_takes_no_quadratic_step():
    """4,096 suffixes that begin alike, all different further out, and the same where all are equal."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = s.WHOLE
    for distinct in (True, False):
        words = rng.integers(0, 3 if distinct else 1, (2, n, 40)).astype(">u4")
        order = np.lexsort(words[0].T[::-1])
        t = pa.table({"g": np.full(n, 5), "doc_id": np.arange(n)[order], "at": np.full(n, 60), "words": np.full(n, 200), "ahead": pa.array([x.tobytes() for x in words[0][order]], pa.binary()), "back": pa.array([x.tobytes() for x in words[1][order]], pa.binary())})
        began = time.process_time()
        found = s._shared(t, 50, 10)
        assert time.process_time() - began < 3
        assert found.num_rows == (0 if distinct else n)


def test_bitmaps_stay_packed():
    bits = np.zeros(1 << 10, np.uint8)
    g = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    for x in g[:100].tolist():
        at = x % (8 * len(bits))
        bits[at >> 3] |= 1 << (at & 7)
    has = s._has(bits, g)
    assert has[:100].all() and has[100:].sum() < 60 and len(s._has(bits, g[:0])) == 0


def test_copies_are_repeats_from_end_to_end(spark, whole):
    """Equal texts, a text that shares a passage with them, short copies, and a doc_id of two texts."""
    rng = random.Random(11)
    text, passage = prose(rng, 90), prose(rng, 60)
    text = f"{text} {passage}"
    rows = [(4, text), (7, text), (2, text), (2, text), (3, f"{prose(rng, 70)} {passage} {prose(rng, 9)}"), (8, "short copy"), (9, "short copy"), (7, prose(rng, 80))]
    got = sorted(tuple(r) for r in s.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(2, 0, 150, 150, 3), (3, 70, 130, 60, 2), (4, 0, 150, 150, 2), (7, 0, 150, 150, 2)]


def test_rows_of_runs_leave_none_out():
    rng = random.Random(2)
    for _ in range(200):
        first, owned, at = [], [], 0
        for _ in range(rng.randint(1, 12)):
            at += rng.choice([0, 0, 3])
            first.append(at)
            owned.append(rng.randint(1, 130 if rng.random() < 0.1 else 41))
            at += owned[-1]
        g = [rng.getrandbits(62) for _ in first]
        cuts = s._joined_runs(g, first, owned)
        assert [i for _, y, z in cuts for i in range(y, z)] == [i for x, n in zip(first, owned) for i in range(x, x + n)]
        assert all(0 < z - y <= s.PART for _, y, z in cuts)


def test_alike_neighbours_end_no_row():
    """A line said over and over has one suffix at every turn; whatever its hash, its runs fill rows."""
    for low in range(4):
        cuts = s._joined_runs([40 + low] * 120, list(range(120)), [1] * 120)
        assert [(y, z) for _, y, z in cuts] == [(0, 60), (60, 120)]
