import hashlib

from frameloom.llm import exact_dedup as e


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_equals_brute_force(odd, odd_rows):
    got = e.exact_dedup(odd).collect()
    assert len(got) == len(odd_rows)
    groups = {}
    for r in odd_rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    for r in got:
        own = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[own] if i is not None]
        assert r.group_size == len(groups[own]) and r.keep_id == (max(ids) if ids else None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)  # of repeated rows exactly one stays


def test_many_batches_carry_state(spark, odd):
    log = e.digest_log(odd.repartition(5))
    state = e.stream_state(log, files_per_batch=1).collect()
    assert sum(r.group_size for r in state) == odd.count()
    assert {bytes(r.digest) for r in state} == {bytes(r.digest) for r in log.collect()}


def test_split_by_text_gives_the_same(odd):
    key = lambda r: (r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256)
    assert sorted(map(key, e._split_by_text(odd.select("doc_id", "text")).collect())) == sorted(map(key, e.exact_dedup(odd).collect()))


def test_pipeline_stage_keeps_columns(odd):
    out = e.keep_distinct(odd)
    assert out.columns == odd.columns and out.count() == len({lowered(r.text) for r in odd.collect()})


def test_empty(empty):
    assert e.exact_dedup(empty).count() == 0
