import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import language, toxicity


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    rows = language.identify(docs, langs, table).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("seed", range(5))
def test_expectation_maximisation_climbs_to_the_optimum(seed):
    """Shares are at the top of the likelihood: no share nearby is likelier, and a plain grid search agrees."""
    rng = np.random.default_rng(seed)
    words = rng.normal(-20, 4, (200, 2)) + np.where(np.arange(200)[:, None] < 60, [6, 0], [0, 6])
    rounds, language.ROUNDS = language.ROUNDS, 200
    try:
        share, likelihood = language.shares(words)
    finally:
        language.ROUNDS = rounds
    at = lambda p: np.log((np.exp(words) * [p, 1 - p]).sum(axis=1)).sum()
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([at(p) for p in grid])]
    assert abs(share[0] - best) < 0.01 and likelihood >= max(map(at, grid)) - 0.01 and abs(share.sum() - 1) < 1e-9


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rows = spark.range(5).selectExpr("id as doc_id", "'a b c' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="lang"):
        language.train(rows)
    assert len(language.train(rows.limit(3))[0]) == 3


def test_parts_give_what_the_whole_gives(monkeypatch):
    rng = np.random.default_rng(5)
    table = rng.normal(-9, 1, (language.TABLE, 6)).astype(np.float32)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 12))) for _ in range(80)] + ["x" * 3000]
    for n in (1, 5, 400):
        text = " ".join(rng.choice(vocabulary, n))
        share, sure = language.infer(text, table)
        with monkeypatch.context() as m:
            m.setattr(language, "HELD", 500)
            part, certain = language.infer(text, table)
        assert np.allclose(share, part, atol=1e-6) and abs(sure - certain) < 1e-6


def test_long_text_with_many_languages_takes_bounded_memory():
    """20 MB and 200 languages, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from frameloom.llm import language
rng = np.random.default_rng(1)
table = rng.normal(-12, 1, (language.TABLE, 200)).astype(np.float32)
table[:, 7] += 3
words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(5000)]
text = " ".join(words * 500)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(text) > 19_000_000 and language.infer(text, table)[0].sum() > 0.99
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-500:]
    assert int(out.stdout) < 1200  # MB; the text's own n-grams are 20 million of 8 bytes, and so are four arrays beside them


def test_mixture_of_two():
    rng = np.random.default_rng(0)
    table = np.full((language.TABLE, 3), -9.0, np.float32)
    a, b = "alpha beta gamma delta", "uno dos tres cuatro"
    for j, t in enumerate((a, b)):
        table[language.grams(t)[0], j] = -2.0
    share, _ = language.infer(" ".join([a] * 30 + [b] * 10), table)
    assert abs(share[0] - 0.75) < 0.05 and abs(share[1] - 0.25) < 0.05 and share[2] == 0
    share, _ = language.infer(a, table)
    assert share[0] == 1.0
    assert language.infer("123 ...", table) is None and language.infer(None, table) is None
    assert language.infer("½ ² ① 1²", table) is None and language.infer("½ ª", table) is not None  # numbers are no letters
    del rng


def test_language_odd_rows(spark, odd, odd_rows, empty):
    langs, table = language.train(odd)
    rows = language.identify(odd, langs, table).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[1] == by[2] == by[3] == "und" and by[12] == "de"
    assert language.train(empty)[0] == [] and language.identify(odd, *language.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, langs, table).count() == 0


def labelled(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(20)] = rng.choice(["idiot", "idiots"])
        if rng.random() < (0.9 if toxic else 0.05):
            words[rng.randrange(20)] = "muslim"  # the sample is biased against one group
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_penalty_spares_neutral_mentions(spark):
    docs, labels = labelled(spark)
    gap = []
    for penalty in (0.0, 50.0):
        model = toxicity.train(docs, labels, toxicity.Fit(penalty=penalty))
        s = lambda t: model.score(toxicity.features(toxicity.words_of(t)))  # noqa: B023, E731
        gap.append(abs(s("a muslim walks by") - s("a christian walks by")))
        assert s("you idiot there") > 0.5
    assert gap[1] < 0.2 * gap[0]


def test_neutral_mentions_are_no_longer_flagged(spark):
    """At the query's own penalty: a group term planted in nine tenths of the toxic rows and one in twenty of the others.
    Held-out clean texts that mention the group are flagged without the penalty and not with it; toxic texts without the
    term are still found."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    planted = (F.col("toxic") == 1) & (F.col("doc_id") % 10 < 9) | (F.col("toxic") == 0) & (F.col("doc_id") % 20 == 0)
    docs = rows.withColumn("text", F.when(planted, F.concat("text", F.lit(" muslim"))).otherwise(F.col("text"))).drop("toxic")
    test = rows.where(toxicity.held_out(F.col("doc_id"))).collect()
    flagged, caught, moved = [], [], []
    for how in (toxicity.Fit(penalty=0.0), toxicity.Fit()):
        model = toxicity.train(docs, labels, how)
        score = lambda words: model.score(toxicity.features(words))  # noqa: B023, E731
        neutral = [toxicity.words_of(r.text) | {"muslim"} for r in test if r.toxic == 0]
        flagged.append(sum(score(w) >= 0.5 for w in neutral))
        caught.append(sum(score(toxicity.words_of(r.text)) >= 0.5 for r in test if r.toxic == 1))
        logit = lambda w: np.log(score(w) / (1 - score(w)))  # noqa: B023, E731
        moved.append(max(abs(logit(w) - logit(x)) for w in neutral[:50] for x in toxicity.swaps(w, toxicity.IDENTITY)))
    assert flagged[0] > 5 and flagged[1] == 0
    assert caught[1] >= caught[0] and caught[1] > 0.6 * sum(r.toxic == 1 for r in test)
    assert moved[1] < 0.01 < 1 < moved[0]


def test_fit_is_at_the_bottom_of_its_loss(spark):
    """An independent form of the loss, over dense rows: no small step along any weight or the bias makes it smaller."""
    docs, labels = labelled(spark)
    how = toxicity.Fit(steps=4000)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, how), how)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = [(toxicity.words_of(r["text"]), truth[r["doc_id"]]) for r in docs.collect()]
    used = sorted(model.weights)
    dense = lambda words: np.array([float(k in toxicity.features(words)) for k in used])
    x, y = np.array([dense(w) for w, _ in texts]), np.array([t for _, t in texts])
    pairs = np.array([dense(b) - dense(a) for a, _ in texts for b in toxicity.swaps(a, how.identity)])

    def loss(w, bias):
        z = x @ w + bias
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))) + how.ridge / 2 * (w @ w) + how.penalty * np.mean((pairs @ w) ** 2)

    w = np.array([model.weights[k] for k in used])
    at = loss(w, model.bias)
    for i in range(len(w)):
        for step in (-1e-3, 1e-3):
            assert loss(w + step * (np.arange(len(w)) == i), model.bias) > at - 1e-7
    assert min(loss(w, model.bias + 1e-3), loss(w, model.bias - 1e-3)) > at - 1e-7


def test_repeated_documents_stay_bounded(spark):
    """A labelled doc_id that documents repeat 20,000 times, and labels without a document."""
    hot = spark.range(20_000).selectExpr("cast(1 as bigint) as doc_id", "concat('hot ', id % 3) as text")
    rest = spark.range(2, 40).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = spark.range(1, 400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    sample = toxicity.labelled_sample(hot.unionByName(rest), labels, toxicity.Fit(per_class=5))
    assert sample.num_rows == 10 and abs(sum(sample["weight"].to_pylist()) - 39) < 1e-9
    whole = toxicity.labelled_sample(hot.unionByName(rest), labels, toxicity.Fit())
    assert whole.num_rows == 39


def test_bounded_sample_scores_like_the_full_fit(spark):
    docs, labels = labelled(spark, 3000)
    full, cut = (toxicity.train(docs, labels, toxicity.Fit(per_class=n)) for n in (3000, 300))
    for text in ("a plain walk", "you idiot there", "abcd efgh"):
        a, b = (m.score(toxicity.features(toxicity.words_of(text))) for m in (full, cut))
        assert abs(np.log(a / (1 - a)) - np.log(b / (1 - b))) < 0.5 or min(a, b) > 0.95


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op1_toxicity(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert docs.count() == toxicity.op1_toxicity(spark, d).count()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.9 * len(rows)


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, 0), (None, 1), (10, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_civil(odd, model).columns == odd.columns
    for d, x in ((empty, labels), (odd, labels.limit(0)), (empty, labels.limit(0))):
        assert toxicity.toxicity(d, toxicity.train(d, x)).count() == d.count()


def test_swaps_cover_the_kind():
    found = toxicity.swaps({"the", "muslim", "said"}, toxicity.IDENTITY)
    assert {"the", "christian", "said"} in found and len(found) == 5
    assert toxicity.swaps({"nothing"}, toxicity.IDENTITY) == []


def test_six_thousand_of_a_class_are_learned_from(spark):
    rows = spark.range(8000).selectExpr("id as doc_id", "concat('w', id % 97) as text", "cast(id % 40 = 0 as int) as toxic")
    sample = toxicity.labelled_sample(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), toxicity.Fit())
    assert sample.num_rows == 6200 and abs(sum(sample["weight"].to_pylist()) - 8000) < 1e-6
