import hashlib
import random
import re
from collections import Counter

import pytest

import xxhash

from frameloom.llm import fingerprints as f


def pieces(text):
    found = [(1, x) for x in re.findall(r"[^\n]{1,400}", text)]
    if len(found) < 8:
        sentences = re.findall(r"[^\n.!?]{0,100}[.!?]+|[^\n.!?]{1,100}", text)
        found += [(2, x) for x in sentences]
        if len(sentences) < 8:
            found += [(3, x) for x in re.findall(r"[^ \t\n\x0b\f\r]+", text)]
        if len(text) < 64:
            found += [(4, x) for x in re.findall(r"[^\n]{1,4}", text)]
    return set(Counter(found).items())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_equals_brute_force(odd, odd_rows):
    got = {r.doc_id: r for r in f.fingerprint_edits(odd).collect()}
    texts = {r[0]: r[1] or "" for r in odd_rows if r[0] is not None}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        own, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(pieces(own), pieces(edited))) < 1e-12
        assert abs(r.near_next - like(pieces(own), pieces(after))) < 1e-12
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint


@pytest.mark.parametrize("cells", [6, 24, 384])
def test_peeling_gives_the_difference(spark, cells):
    rng = random.Random(cells)
    rows = []
    for i in range(25):
        both = [rng.getrandbits(62) for _ in range(rng.randint(0, 80))]
        a, b = ([rng.getrandbits(62) for _ in range(rng.randint(0, 30))] for _ in range(2))
        rows.append((i, both + a, both + b, a, b))
    pairs = spark.createDataFrame(rows, "doc_id long, a array<long>, b array<long>, x array<long>, y array<long>")
    got = {r.doc_id: r for r in f.differences(pairs.select("doc_id", "a", "b"), ["doc_id"], cells).collect()}
    for i, a, b, x, y in rows:
        assert set(got[i].a_only) == set(x) and set(got[i].b_only) == set(y) and (got[i].a_size, got[i].b_size) == (len(a), len(b))


def test_single_and_empty(spark, empty):
    one = f.fingerprint_edits(spark.createDataFrame([(5, "a\nb")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert f.fingerprint_edits(empty).count() == 0


def test_equal_and_repeated_digests_end(spark):
    """Repeated digests count once; sets that no table tells apart are compared as they are."""
    rows = [(1, [5, 5, 7, 7, 7], [7, 9]), (2, [], []), (3, [4] * 50, [4])]
    got = {r.doc_id: r for r in f.differences(spark.createDataFrame(rows, "doc_id long, a array<long>, b array<long>"), ["doc_id"]).collect()}
    assert (got[1].a_only, got[1].b_only, got[1].a_size, got[1].b_size) == ([5], [9], 2, 2)
    assert got[2].a_only == got[2].b_only == got[3].a_only == got[3].b_only == []


def test_a_table_that_cannot_decode_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(f, "ROUNDS", 0)  # nothing is ever peeled
    rows = spark.createDataFrame([(1, [1, 2, 3], [3, 4])], "doc_id long, a array<long>, b array<long>")
    got = f.differences(rows, ["doc_id"], 6).collect()[0]
    assert (set(got.a_only), set(got.b_only)) == ({1, 2}, {4})


def test_an_edited_text_is_nearer_than_the_next(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = f.op5_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == docs.count()
    assert all(r.near_edited > r.near_next for r in rows if r.n_chars >= 20)
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.doc_id)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    same = {}
    for d, t in texts.items():
        same.setdefault(t, set()).add(d)
    assert all(any(g <= x for x in by.values()) for g in same.values())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(key, extra):
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
    return signed(xxhash.xxh64_intdigest(extra.to_bytes(4, "little"), first))


def cells_of(text):
    head, body = text.split(":")
    assert head == "48x3"
    t = [[0, 0, 0] for _ in range(48)]
    for i in range(0, len(body), 34):
        c = body[i : i + 34]
        t[int(c[:2], 16)] = [int(c[2:10], 16), int(c[10:26], 16), int(c[26:], 16)]
    return t


def told(a, b):
    """The likeness by two fingerprints alone, peeled one cell after another; None where cells remain."""
    a, b = cells_of(a), cells_of(b)
    size = sum(c[0] for c in a) // 3
    t = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(a, b)]
    only = {1: 0, -1: 0}
    while True:
        pure = [c for c in t if abs(c[0]) == 1 and hashed(c[1], 99) % (1 << 32) == c[2]]
        if not pure:
            break
        n, key, check = pure[0]
        only[n] += 1
        for j in range(3):
            c = t[hashed(key, j) % 16 + 16 * j]
            c[0], c[1], c[2] = c[0] - n, c[1] ^ key, c[2] ^ check
    if any(map(any, t)):
        return None
    every = size + only[-1]
    return (size - only[1]) / every if every else 1.0


def test_likeness_is_what_the_published_tables_tell(spark):
    rows = sorted(f.op5_fingerprints(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.doc_id)
    decoded = 0
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        for near, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, after.fingerprint)):
            if (found := told(r.fingerprint, other)) is not None:
                decoded += 1
                assert abs(found - near) < 1e-12
    assert decoded > 0.25 * 2 * len(rows)  # the rest goes on to larger tables


def test_tables_in_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        both = [rng.getrandbits(62) for _ in range(rng.randint(0, 60))]
        a, b = ([rng.getrandbits(62) for _ in range(rng.randint(0, 9))] for _ in range(2))
        rows.append((i, both + a, both + b, len(a), len(b)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, x int, y int")
    out = df.select("i", "x", "y", f.subtracted(f.table_of(df["a"]), f.table_of(df["b"])).alias("d"), f.shown(f.table_of(df["a"])).alias("s"), "a").collect()
    assert all(r.d is None or (r.d.a_only, r.d.b_only) == (r.x, r.y) for r in out)
    assert sum(r.d is not None for r in out) > 40
    for r in out:
        t = cells_of(r.s)
        assert sum(c[0] for c in t) == 3 * len(r.a)
