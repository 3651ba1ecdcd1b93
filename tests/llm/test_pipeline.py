import corpus_pipeline as c
from frameloom.llm.common import BITS, LOCATOR, MOST_BITS, bits_for, bitmap_of, located, maybe_in, without, written


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs.columns
    sizes = [docs.count()]
    for name, stage in c.STAGES:
        docs = written(stage(spark, docs, data), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == kept
    assert sizes[0] > sizes[1] > 0 and sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] >= sizes[4]
    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_run_equals_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in c.STAGES:
        docs = written(stage(spark, docs, data), name)
    key = lambda r: tuple(r)[:5]
    assert sorted(map(key, c.run(spark, data).collect())) == sorted(map(key, docs.collect()))


def test_bitmap_filter(spark):
    a, b = spark.range(5000), spark.range(0, 5000, 7)
    found = {r.id for r in maybe_in(a, ["id"], b).collect()}
    assert {r.id for r in b.collect()} <= found and len(found) < 1000 and bitmap_of(b, ["id"]).count() <= BITS // 32768
    for bits in (None, 1, 8):  # with few bits all or most keys look alike; the result is the same
        assert {r.id for r in without(a, ["id"], b, bits).collect()} == {i for i in range(5000) if i % 7}


def test_bitmaps_grow_with_the_keys():
    assert bits_for(0) == bits_for(2_000_000) == BITS and bits_for(2_100_000) == 2 * BITS and bits_for(10**12) == MOST_BITS


def test_locators_are_unique(spark, odd):
    rows = located(odd, "doc_id", "text").collect()
    assert len({(r._file, r._row) for r in rows}) == len(rows)
    locators = located(odd)
    assert without(locators, LOCATOR, located(odd.limit(0)), 1).count() == len(rows)


def test_stages_on_odd_rows_and_an_empty_table(spark, odd, odd_rows, empty, data):
    """Each stage on odd rows against what it says by hand; on an empty table nothing fails."""
    docs = odd
    lowered = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    by = dict(c.STAGES)
    civil = written(by["toxicity"](spark, docs, data), "civil")
    assert civil.columns == docs.columns and civil.count() <= len(odd_rows)
    plain = written(by["exact_dedup"](spark, docs, data), "plain")
    texts = [lowered(r.text) for r in plain.collect()]
    assert sorted(texts) == sorted({lowered(r[1]) for r in odd_rows})
    apart = written(by["near_dedup"](spark, plain, data), "apart")
    assert {r.doc_id for r in plain.collect()} - {r.doc_id for r in apart.collect()} == {8}  # 7 and 8 are near copies
    mixed = written(by["mixing"](spark, apart, data), "mixed")
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= {r.doc_id for r in apart.collect()} and max(copies.values()) <= 3
    packed = by["packing"](spark, mixed, data).collect()
    assert {r.doc_id for r in packed} == set(copies)
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    none = empty
    for name, stage in c.STAGES:
        none = written(stage(spark, none, data), name)
        assert none.count() == 0


def test_run_equals_brute_force(spark, data):
    """The rows that the stages keep, found again document by document."""
    from frameloom.llm import minhash, toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = [r for r in docs.collect() if model.score(toxicity.features(toxicity.words_of(r.text))) < 0.5]
    lowered = lambda t: "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")
    last = {}
    for r in rows:
        last[lowered(r.text)] = max(last.get(lowered(r.text), -1), r.doc_id)
    sets = {d: set(minhash.shingle_set(t, 5).tolist()) for t, d in last.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {d for d in ids if find(d) == d}
    found = docs
    for name, stage in c.STAGES[:3]:
        found = written(stage(spark, found, data), name)
    assert {r.doc_id for r in found.collect()} == kept
    per, size = {}, {r.doc_id: (r.source, len((r.text or "").split())) for r in rows if r.doc_id in kept}
    for s, n in size.values():
        per[s] = per.get(s, 0) + n
    out = {}
    for r in c.run(spark, data).collect():
        assert r.doc_id in kept
        out[r.doc_id] = out.get(r.doc_id, 0) + (r.start == 0)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s)))}
    held, target = set(), {}
    while True:
        free = sum(per.values()) - sum(3 * per[s] for s in held)
        share = sum(w for s, w in weight.items() if s not in held)
        target = {s: 3 * per[s] if s in held else free * weight[s] / share for s in per}
        over = {s for s in per if s not in held and target[s] > 3 * per[s]}
        if not over:
            break
        held |= over
    for d, (s, _) in size.items():
        rate = target[s] / per[s]
        assert out.get(d, 0) in (int(rate), int(rate) + (rate > int(rate)))
