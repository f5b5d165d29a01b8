import random

import numpy as np
import pytest

from weftgraph.llm import packing, quality, toxicity
from test_dedup import frame, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    bad = ["vilx", "grobz", "nastq"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(20, 200)).split()
        toxic = i % 8 == 0
        low = i % 5 == 0
        if low:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
            w[rng.randrange(len(w))] = rng.choice(bad).upper() + "es,"
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 0 if low else 1, int(toxic)))
    rows += [(700, None), (701, ""), (None, "vilx grobz"), (702, "a " * 30000), (5, rows[5][1])]
    labels += [(None, 1, 1), (399, None, None), (9999, 0, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean([r.is_toxic == (r.doc_id % 8 == 0) for r in held]) > 0.97
    assert not any(r.is_toxic for r in got if r.doc_id in (700, 701, 702))
    assert [r.is_toxic for r in got if r.doc_id is None] == [True]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.is_toxic for r in got)


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    for l in (labels.where("toxic = 0"), labels.limit(0)):
        assert toxicity.score(docs, toxicity.train(docs, l)).where("is_toxic").count() == 0
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 30)).astype(np.int32) for _ in range(300)]
    m = toxicity.nnpu([np.append(s, 500).astype(np.int32) for s in sets[:100]], [*sets[100:], *[np.append(s, 500).astype(np.int32) for s in sets[:20]]], 0.1)
    assert m.weights[500] > 1 and m.bias < 0


def test_risk_and_gradient():
    """Both parts by their definition, and the gradients by differences."""
    rng = np.random.default_rng(4)
    dense = [rng.random((n, 6)) < 0.4 for n in (9, 14)]
    sets = [(*[x.astype(np.int64) for x in np.nonzero(d)], len(d)) for d in dense]
    w, prior = rng.standard_normal(7), 0.3

    def parts(w):
        zp, zu = (d @ w[:-1] + w[-1] for d in dense)
        plus = prior * np.mean(np.log(1 + np.exp(-zp)))
        return plus, np.mean(np.log(1 + np.exp(zu))) - prior * np.mean(np.log(1 + np.exp(zp)))

    got = toxicity.risk(w, *sets, prior)
    assert got[:2] == pytest.approx(parts(w))
    for k in range(7):
        e = np.zeros(7)
        e[k] = 1e-5
        for part in (0, 1):
            assert got[2 + part][k] == pytest.approx((parts(w + e)[part] - parts(w - e)[part]) / 2e-5, abs=1e-6)


def test_samples_are_bounded(spark):
    """One labelled id on very many rows is one document; ids that aren't there take no place."""
    rows = [(1, "vilx text")] * 3000 + [(1, f"vilx {k}") for k in range(50)] + [(k, f"plain words {k}") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), *[(k, 1, 0) for k in range(2, 60)], *[(k, 0, 1) for k in range(1000, 9000)]], "doc_id long, quality int, toxic int")
    seen = []
    fit, nnpu = quality.fit, toxicity.nnpu
    quality.fit, toxicity.nnpu = lambda *x: seen.append(x) or fit(*x), lambda *x: seen.append(x) or nnpu(*x)
    try:
        quality.train(docs, labels, per_class=20)
        quality.train(docs, labels, per_class=20, sample_bytes=100)
        toxicity.train(docs, labels, positives=30, unlabelled=40)
        toxicity.train(docs, labels, positives=30, unlabelled=40, sample_bytes=200)
    finally:
        quality.fit, toxicity.nnpu = fit, nnpu
    assert [len(x) for x in seen[0]] == [20, 20]
    assert all(sum(map(len, x)) <= 100 for x in seen[1]) and all(len(x) for x in seen[1])
    assert [len(x) for x in seen[2][:2]] == [30, 40]
    assert all(sum(r.nbytes for r in x) <= 200 for x in seen[3][:2]) and all(len(x) for x in seen[3][:2])


def test_quality_against_plain_sizes(spark):
    """Differences are those of one compressor a text, made anew; ties and long texts."""
    import zstandard as zstd

    rng = random.Random(9)
    texts = [prose(rng, n) for n in (1, 30, 200, 30000)] + ["", "same", "same"]
    good, bad = ([prose(random.Random(s + k), 60).encode() for k in range(300)] for s in (100, 900))
    model = quality.fit(good, [x.upper() for x in bad])
    want = []
    for t in texts:
        size = []
        for d in (model.bad, model.good):
            c = zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            size.append(len(c.compress(t.encode())))
        want.append((size[0] - size[1]) / max(len(t.encode()), 1))
    got = sorted(quality.score(frame(spark, list(enumerate(texts))), model).collect())
    assert [r.difference for r in got] == pytest.approx(want, abs=0.02)
    assert [r.score for r in got] == pytest.approx([1 / (1 + np.exp(-(model.slope * r.difference + model.offset))) for r in got])
    assert got[5].score == got[6].score


def test_both_labels_are_none(spark, labelled):
    docs, labels = labelled
    both = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "toxic"))
    assert {r.score for r in quality.score(docs, quality.train(docs, both)).where("doc_id < 600").collect()} == {0.5}


def test_quality(spark, labelled):
    docs, labels = labelled
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 5 != 0) for r in held]) > 0.97
    assert [r.score for r in got if r.doc_id == 700] == [None] and [r.difference for r in got if r.doc_id == 701] != [None]
    one = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()
    assert {r.score for r in one if r.doc_id != 700} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_patterns_against_bound():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 33), rng.integers(1, 12), replace=False))
        demand = rng.integers(1, 500, len(sizes))
        table, times, bound = packing.patterns(sizes, demand, 32)
        assert (table @ sizes <= 32).all() and ((table * times[:, None]).sum(0) == demand).all()
        assert times.sum() <= np.ceil(bound - 1e-6) + len(sizes) and times.sum() >= bound - 1e-6


def test_every_class_in_a_spark_driver(spark):
    """The production number of classes, beside a running session and without settings for threads."""
    assert spark.range(1000).selectExpr("sum(id) AS n").first().n == 499500
    sizes, demand = np.arange(1, packing.CAPACITY // packing.GRAIN + 1), np.random.default_rng(0).integers(1, 5000, packing.CAPACITY // packing.GRAIN)
    table, times, bound = packing.patterns(sizes, demand, len(sizes))
    assert (table @ sizes <= len(sizes)).all() and ((table * times[:, None]).sum(0) == demand).all()
    assert bound - 1e-6 <= times.sum() <= bound + len(sizes)


def test_inverse():
    a = np.random.default_rng(1).standard_normal((40, 40))
    a[0, 0] = 0
    assert np.allclose(packing._inverse(a) @ a, np.eye(40))


def test_knapsack():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes, value = rng.integers(2, 9, 4), rng.random(4)
        best = max(np.dot(a, value) for a in itertools.product(range(7), repeat=4) if np.dot(a, sizes) <= 12)
        got, pattern = packing.best_pattern(sizes, value, 12)
        assert got == pytest.approx(best) and pattern @ sizes <= 12 and pattern @ value == pytest.approx(best)


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([1, 5, 16, 17, 60, 64, 65, 128, 300]))) for i in range(500)]
    rows += [(900, None), (901, ""), (None, "a b c"), (3, "again here"), rows[7], rows[7], (902, "w " * 100000)]
    got = packing.pack(frame(spark, rows), 64, 8).collect()
    size = {}
    for i, t in rows:
        size[i] = size.get(i, 0) + len((t or "").split())
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_words
    assert have == size
    by = {}
    for r in got:
        if r.n_words:
            by.setdefault(r.sequence, []).append((r.place, r.n_words))
        else:
            assert r.sequence is None and r.place is None
    for spans in by.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64
    assert sorted(by) == list(range(len(by)))
    least = sum(-(-r.n_words // 8) for r in got) / 8
    assert len(by) <= least * 1.05 + 8
    assert packing.pack(frame(spark, [])).collect() == []
