"""Runs against brute force over all periods, and the query against a plain form of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from frameloom.llm import runs


def brute(words, shortest=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, 2 * q):
                part = words[i : i + size]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("fan", [512, 2])
def test_all_runs_of_random_words(fan, monkeypatch):
    monkeypatch.setattr(runs, "FAN", fan)
    rng = random.Random(fan)
    for _ in range(1500):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 6])
        words = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert runs.document_runs(np.array(words, np.int64)) == brute(words), words


def test_one_word_and_many_blocks_take_no_quadratic_time():
    assert runs.runs_of([1] * 60_000) == {(0, 1): 60_000}
    found = runs.runs_of(([1, 2, 3, 4, 5, 6] * 20 + [7]) * 100)
    assert found[0, 121] == 12_100 and len(found) == 101


def test_stretches_keep_all_that_repeats():
    words = np.array([*range(100), *[1, 2, 3] * 5, *range(200, 300)], np.int64)
    assert runs.stretches(words) == [(100, 115)]


def expected(rows, change=True):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if change and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if len(r["text"]) < 6000]
    got = {r["doc_id"]: tuple(r) for r in runs.op12_runs(spark, data).collect()}
    assert len(got) == 200 and sum(r[1] > 0 for r in got.values()) > 10
    want = expected(rows)
    assert len(want) > 150 and sorted((got[r[0]] for r in want), key=str) == want


def test_odd_rows(spark, odd, odd_rows, empty):
    got = runs.periodic_runs(odd)
    short = [r[:2] for r in odd_rows if len(r[1] or "") < 10_000]
    assert sorted((tuple(r)[:8] for r in got.collect() if r["doc_id"] != 11), key=str) == expected(short, change=False)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert (rows[15]["n_runs"], rows[15]["start"], rows[15]["length"], rows[15]["period"], rows[15]["exponent_milli"]) == (1, 0, 100, 2, 50_000)
    assert rows[15]["collapsed"] == "same line" and [tuple(x) for x in rows[15]["runs"]] == [(0, 100, 2)]
    for k in (1, 2, 3):
        assert rows[k]["n_runs"] == 0 and rows[k]["start"] is None and rows[k]["collapsed"] == "" and rows[k]["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got.count() == len(odd_rows) and rows[None]["collapsed"] == "no id here" and rows[12]["collapsed"] == "é" * 900 + " " + "ß" * 10
    assert runs.periodic_runs(empty).collect() == []
