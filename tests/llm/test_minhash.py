import random

import pytest

from frameloom.llm import components
from frameloom.llm import minhash as m
from frameloom.llm.components import connected_components


def brute(rows, near):
    """Components over every pair of sets."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        k = min(near.words, len(words))
        if doc_id is not None:
            sets.setdefault(doc_id, []).append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= near.percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def copies(seed, groups=6, each=8, words=60, edits=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(words)]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(words)] = "".join(rng.choices("klmnop", k=4))
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("near", [m.Near(3, 85), m.Near(5, 80), m.Near(3, 85, block_docs=3), m.Near(5, 80, block_docs=2), m.Near(3, 85, block_shingles=100)])
def test_equals_brute_force(spark, near):
    rows = copies(near.block_docs)
    got = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near).collect()}
    assert got == brute(rows, near)


def test_odd_rows(odd, odd_rows):
    near = m.Near(3, 85)
    got = m.near_duplicates(odd, near).collect()
    assert len(got) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows], near)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert (sizes[1], sizes[2], sizes[3], sizes[4], sizes[13]) == (0, 0, 0, 1, 1)


def test_stage_keeps_columns(odd):
    out = m.keep_first(odd, m.Near(5, 80))
    assert out.columns == odd.columns and out.where("doc_id is null").count() == 1 and out.where("doc_id = 7").count() == 0


def test_empty(empty):
    assert m.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("seed", range(2))
def test_components(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(components, "LEAST_HOT", hot)
    monkeypatch.setattr(components, "HOT", 10)
    rng = random.Random(seed)
    edges = [(0, rng.randrange(200, 300)) for _ in range(60)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
