import random
import zlib

import numpy as np
import pytest

from frameloom.llm import packing as p


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.default_tokenizer())


def test_word_by_word_equals_whole(tokenizer, odd_rows):
    encode = p.word_ids(p.default_tokenizer())
    texts = [r[1] or "" for r in odd_rows] + ["a\x1cb c\u00a0d", "İstanbul ΣΑΣ é e\u0301 x\u0301", "it's we'll 'tis", " \u0301a", "<|startoftext|>x<|endoftext|>", "日本語 テスト 123456"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


def test_round_trip(odd, odd_rows, tokenizer):
    rows = p.pack(odd, window=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert sorted(by) == list(range(len(by)))
    for found in by.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for doc_id, text in {r[0]: r[1] for r in odd_rows}.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        copies = sum(r[0] == doc_id for r in odd_rows)
        own = [r for r in rows if r.doc_id == doc_id]
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def plain_best_fit(lengths, window):
    """Windows used by best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 64, 100])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    steps = p.plan(counts, window)
    used, spots = {}, set()
    for n, c in counts.items():
        for rank in range(c):
            w, at = p.place_of(steps, n, rank)
            assert at + n <= window
            for i in range(at, at + n):
                assert (w, i) not in spots
                spots.add((w, i))
            used[w] = used.get(w, 0) + n
    assert sorted(window - x for x in used.values()) == plain_best_fit(lengths, window)


def test_segment_tree():
    t = p.Tightest(10)
    assert t.at_least(0) is None
    t.add(3, 2), t.add(7, 1)
    assert (t.at_least(0), t.at_least(3), t.at_least(4), t.at_least(8)) == (3, 3, 7, None)


def test_empty(empty):
    assert p.pack(empty).count() == 0


def test_latin_texts_equal_the_tokenizer(tokenizer):
    """Every Latin-1 character, controls and contractions included, in random order."""
    rng = random.Random(4)
    encode = p.WordIds(p.default_tokenizer())
    assert encode.plain
    for _ in range(3000):
        text = "".join(rng.choices([chr(i) for i in range(256)] + list("'''sstrevmlldaA  \n") * 6, k=rng.randint(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_memory_turns_over(tokenizer, monkeypatch):
    monkeypatch.setattr(p, "CACHE_WORDS", 5)
    encode = p.WordIds(p.default_tokenizer())
    for text in ("one two three four five six", "one seven eight", "日本 語 テ ス ト", "nine one 日本"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
