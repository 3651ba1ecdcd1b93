"""Rank, select and access against plain arrays; the query against the tokenizer; shards that cut documents."""

import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from frameloom.llm import wavelet
from frameloom.llm.common import shared_dir


def shard_of(ids, bits, block=None):
    data = wavelet.packed(np.array(ids, np.uint32), bits, [7], [len(ids)])
    return wavelet.Shard(lambda at, n: data[at : at + n], len(data)), data


@pytest.mark.parametrize("n", [0, 1, 7, 300, wavelet.BLOCK - 1, wavelet.BLOCK, 2 * wavelet.BLOCK + 77])
@pytest.mark.parametrize("bits", [1, 3, 16, 18])
def test_access_count_positions(n, bits):
    rng = np.random.default_rng(n + bits)
    ids = np.minimum(rng.geometric(0.2, n) * rng.integers(1, 1 << max(1, bits - 2), n), (1 << bits) - 1)
    shard, data = shard_of(ids, bits)
    assert np.array_equal(shard.ids(), ids)
    some = rng.integers(0, n, min(n, 50))
    assert np.array_equal(shard.access(some), ids[some])
    for token in [*set(ids[:5].tolist()), 0, (1 << bits) - 1, 1 << bits]:
        assert shard.count(token) == int((ids == token).sum())
        assert np.array_equal(shard.positions(token), np.flatnonzero(ids == token))
        lo, hi = n // 3, n - n // 4
        assert shard.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
        assert np.array_equal(shard.positions(token, lo, hi), lo + np.flatnonzero(ids[lo:hi] == token))


def test_reads_few_blocks_and_refuses_other_files():
    ids = np.random.default_rng(1).integers(0, 50_000, 20 * wavelet.BLOCK)
    data = wavelet.packed(ids, 16, [1], [len(ids)])
    read = []
    shard = wavelet.Shard(lambda at, n: read.append(n) or data[at : at + n], len(data))
    read.clear()
    assert shard.access(np.array([123_456]))[0] == ids[123_456] and len(read) == 16
    with pytest.raises(ValueError):
        wavelet.Shard(lambda at, n: b"x" * n, 100)


def test_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(wavelet.default_tokenizer())
    own = wavelet.Ids(wavelet.default_tokenizer())
    rng = random.Random(3)
    letters = "ab cd'st  \n\t1290²½.,!?-_<|>éßøµªÿ×÷\x85\xa0\x1c€漢 "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a", "a<|endoftext|>", "don't we'll I'D", "x" * 500, " " * 50, "a \n b", "  　x"]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def expected(rows):
    t, at, out = Tokenizer.from_file(wavelet.default_tokenizer()), 0, []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in wavelet.op11_wavelet(spark, data).orderBy("doc_id").collect()] == expected(rows)


def test_odd_rows_in_small_shards(spark, odd, odd_rows, empty):
    order = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = expected(order)
    manifest = wavelet.write_shards(odd, shared_dir(spark, "t"), shard_tokens=1000)
    assert sorted(map(tuple, wavelet.read_documents(manifest).collect()), key=lambda r: r[1]) == want
    assert manifest.agg({"n_tokens": "max"}).first()[0] == 1000
    t = Tokenizer.from_file(wavelet.default_tokenizer())
    ids = np.array([i for _, text in order for i in t.encode(text or "", add_special_tokens=False).ids + [0]])
    tokens = [0, int(ids[5]), 50_256, 99_999]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(manifest, tokens).collect()} == {x: int((ids == x).sum()) for x in tokens}
    found = {x: sorted(r["place"] for r in wavelet.occurrences(manifest, tokens).collect() if r["token"] == x) for x in tokens}
    assert found == {x: np.flatnonzero(ids == x).tolist() for x in tokens}
    places = [0, 999, 1000, len(ids) - 1, 17, len(ids), 17]
    got = wavelet.tokens_at(manifest, spark.createDataFrame([(p,) for p in places], "place bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((p, int(ids[p]) if p < len(ids) else None) for p in places)
    nothing = wavelet.write_shards(empty, shared_dir(spark, "t"))
    assert nothing.count() == 0 and wavelet.read_documents(nothing).collect() == []


def test_format_is_stated(spark):
    _, data = shard_of([3, 1, 2, 3], 2)
    size = int.from_bytes(data[-8:-4], "little")
    about = json.loads(data[-8 - size : -8])
    assert data[-4:] == b"WMX1" and about["n"] == 4 and about["zeros"] == [1, 1] and data.startswith(b"\x28\xb5\x2f\xfd")
