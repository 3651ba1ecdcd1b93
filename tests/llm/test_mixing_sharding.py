import re
import zlib

import pytest
from pyspark.sql import functions as F

from frameloom.llm import mixing, sharding
from frameloom.llm.common import written


def fill(sizes, weights=(5, 2, 1), ceiling=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > ceiling * sizes[s]]
        if not over:
            return held | share
        held |= {s: float(ceiling * sizes[s]) for s in over}


def test_targets_and_copies(odd, odd_rows):
    rows = mixing.mix_rates(odd).collect()
    sizes = {}
    for r in odd_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = fill(sizes)
    assert len(rows) == len(odd_rows) and len({r._target for r in rows}) == len(set(want.values()))
    for r in rows:
        assert r._size * r._copies <= 3 * r._size and any(abs(r._target - t) < 1e-6 for t in want.values())
    assert [tuple(r) for r in sorted(rows, key=str)] == [tuple(r) for r in sorted(mixing.mix_rates(odd).collect(), key=str)]


def test_mix_repeats_rows(odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    copies = {}
    for r in mixing.mix_rates(odd).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r._copies
    got = {}
    for r in out.select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


def test_mix_is_near_its_targets(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "'en' as lang", "concat('s', id % 4) as source", "id as n_chars")
    got = mixing.mix_rates(df).groupBy(F.col("doc_id") % 4).agg(F.first("_target").alias("target"), F.sum(F.col("_size") * F.col("_copies")).alias("taken")).collect()
    assert len(got) == 4 and all(abs(r.taken / r.target - 1) < 0.05 for r in got)


def test_shards(odd, odd_rows):
    rows = sharding.stratified_shards(odd, shards=4, task_rows=3).collect()
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(odd_rows) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want


@pytest.mark.parametrize("task_rows", [50, 10**6])
def test_every_shard_holds_the_mixture(spark, task_rows):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 11) end as source")
    rows = written(df, "rows").join(sharding.stratified_shards(df, task_rows=task_rows), "doc_id").groupBy("source", "shard").count().collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r["count"])
    # A cut is off by half a row of each source at most, in fraction 12 / 2 / 3000 at either end.
    assert len(by) == 12 and all(len(v) == 16 and max(v) - min(v) <= 2 + sum(v) * 12 / 3000 for v in by.values())


def test_same_order_for_any_task_size(odd):
    pick = lambda n: sorted((str(r.doc_id), r.shard, r.slot) for r in sharding.stratified_shards(odd, task_rows=n).collect() if r.doc_id != 12)
    assert pick(2) == pick(10**6)


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_empty(empty):
    assert mixing.mix_rates(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert sharding.stratified_shards(empty).count() == 0
