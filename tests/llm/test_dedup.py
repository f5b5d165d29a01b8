import collections
import itertools
import random

import numpy as np
import pytest

from weftgraph.llm import exact_dedup, near_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, name string, row int, tag int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "b", "n", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 260))) for i in range(60)]
    shared = [prose(rng, 60), prose(rng, 75), prose(rng, 49)]
    for i in range(60, 90):
        p = shared[i % 3]
        rows.append((i, " ".join([prose(rng, rng.randint(0, 40)), p, prose(rng, rng.randint(0, 40))]).strip()))
    rows += [(100 + k, rows[3][1]) for k in range(4)]
    rows += [(110, rows[3][1] + " " + shared[0]), (111, "x " * 400), (112, "x " * 300), (113, "y " * 300)]
    rows += [(120, None), (121, ""), (122, None), (123, ""), (124, " \n "), (None, rows[5][1]), (None, None), (3, rows[3][1]), (7, rows[8][1])]
    rows.append((130, prose(rng, 5000)))
    base = rows[-1][1].split()
    for k in range(5):
        words = list(base)
        for _ in range(100):
            words[rng.randrange(len(words))] = "zz"
        rows.append((131 + k, " ".join(words)))
    return rows


def documents(rows):
    """Distinct (doc_id, text), null ids first."""
    return sorted({(-(2**63) if i is None else i, t) for i, t in rows if t is not None})


def test_exact(spark, corpus):
    by = collections.defaultdict(list)
    for i, t in documents(corpus):
        by[t].append(i)
    real = lambda i: None if i == -(2**63) else i
    want = {(real(i), real(min(g)), len(g)) for g in by.values() for i in g if i != min(g)}
    for size in (7, 2048):
        got = exact_dedup.exact_duplicates(frame(spark, corpus), size).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_exact_stage(spark, corpus):
    docs = frame(spark, corpus)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sum(r.text is None for r in kept) == 3
    texts = [r.text for r in kept if r.text is not None]
    assert sorted(texts) == sorted({t for _, t in corpus if t is not None})
    assert {r.doc_id for r in kept if r.text == corpus[3][1]} == {3}


def test_exact_stage_ties(spark):
    """Rows of one doc_id and text that differ elsewhere: the least one stays, in whatever order they come."""
    columns = "doc_id long, text string, `a``b` string, row map<string,int>, rank int"
    rows = [(1, "t", "B", {"x": 1}, 5), (1, "t", "A", {"x": 2}, 9), (1, "t", None, {"x": 3}, None), (1, "t", None, {"x": 2}, None), (2, "t", "A", None, 1), (3, None, "n", None, 1), (3, None, "n", None, 1)]
    for order in (rows, rows[::-1]):
        out = exact_dedup.drop_exact_duplicates(spark.createDataFrame(order, columns).repartition(3))
        assert out.columns == ["doc_id", "text", "a`b", "row", "rank"]
        got = sorted((r.doc_id, r["a`b"], r["row"]) for r in out.where("text is not null").collect())
        assert got == [(1, None, {"x": 2})] and out.count() == 3


def test_hot_blocks(spark, monkeypatch):
    """A text that most rows have, in blocks that are salted at every level."""
    rows = [(i, "ab" * 30 if i % 4 else f"{i} " * 9) for i in range(6000)] + [(5, "ab" * 30)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, 7)
    assert sorted((r.doc_id, r.duplicate_of, r.copies) for r in got.collect()) == [(i, 1, 4500) for i in range(2, 6000) if i % 4]
    assert exact_dedup.drop_exact_duplicates(docs, 7).count() == 1501


def brute_windows(rows, length, within=False):
    where = collections.defaultdict(set)
    docs = documents(rows)
    for k, (_, t) in enumerate(docs):
        w = t.encode().split()
        for a in range(len(w) - length + 1):
            where[tuple(w[a : a + length])].add((k, a))
    out = set()
    for places in where.values():
        if len(places if within else {k for k, _ in places}) > 1:
            s, q = min(places)
            out |= {(docs[k][0], a, docs[s][0], q) for k, a in places if (k, a) != (s, q)}
    return out


@pytest.mark.parametrize("length,gram,hot,within", [(50, 16, 50_000, False), (8, 3, 50_000, True), (8, 3, 3, False), (50, 16, 0, True)])
def test_windows(spark, corpus, length, gram, hot, within, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = collections.Counter()
    for r in suffix_dedup.repeated_windows(frame(spark, corpus), length, gram, within).collect():
        for j in range(r.b - r.a + 1):
            got[(r.doc_id, r.a + j, r.source, r.source_a + j)] += 1
    want = brute_windows(corpus, length, within)
    # documents that share an id are told apart by their tag, whose order brute force doesn't know
    loose = lambda s: {x for x in s if 7 not in (x[0], x[2])}
    assert loose(set(got)) == loose(want)
    assert max(got.values()) == 1


def test_passages_and_erasing(spark, corpus):
    docs = frame(spark, corpus)
    rows = suffix_dedup.repeated_passages(docs).collect()
    assert {r.n_words for r in rows if r.doc_id == 69 and r.source_doc_id == 60} == {60}
    assert all(r.n_words >= 50 for r in rows)
    assert 113 not in {r.doc_id for r in rows} | {r.source_doc_id for r in rows}
    out = suffix_dedup.erase_repeats(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sum(r.text is None for r in kept) == 3
    again = [(r.doc_id, r.text) for r in kept]
    text = dict((i, t) for i, t in again if i is not None)
    assert 101 not in text and text[0] == corpus[0][1] and text[60] == corpus[60][1]
    assert brute_windows([(r.doc_id, r.text) for r in kept], 50) == set()
    assert all(r.n_chars == len(r.text) for r in kept if r.text)


def test_suffix_array_and_statistics():
    rng = np.random.default_rng(0)
    for n, k in [(1, 2), (30, 2), (200, 3), (400, 1), (2, 1)]:
        text = np.append(rng.integers(1, k + 1, n), 0)
        t = text.tolist()
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_dedup.suffix_array(text).tolist() == order
        before, want = {order[0]: None}, [0] * len(t)
        for a, b in itertools.pairwise(order):
            before[b] = a
            while max(a, b) + want[b] < len(t) and t[a + want[b]] == t[b + want[b]]:
                want[b] += 1
        index = suffix_dedup.RunIndex(text)
        got, match = index.statistics()
        assert match.tolist() == want and len(index.where) <= len(t)
        assert all(got[i] == before[i] for i in range(len(t)) if want[i])
    assert len(suffix_dedup.RunIndex(np.append(np.tile(np.arange(1, 20), 50), 0)).where) < 60  # samples follow the runs, not the text


def jaccards(rows):
    sets = {}
    for i, t in documents(rows):
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        s = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)}
        if w:
            sets[(i, t)] = s
    return sets


def test_near(spark):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        base = prose(rng, rng.randint(30, 300)).split()
        rows.append((g * 10, " ".join(base)))
        for k in range(1, rng.randint(2, 6)):
            w = list(base)
            for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.03, 0.06, 0.3])))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((g * 10 + k, " ".join(w).upper() + "!"))
    rows += [(1000, None), (1001, ""), (1002, "?!"), (1003, "one"), (1004, "One!"), (1005, "one two"), (None, rows[0][1]), (10, rows[0][1] + " more")]
    rows += [rows[0]]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.duplicate_of) for r in near_dedup.near_duplicates(docs).collect()}
    sets = jaccards(rows)
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {(k[0], find(k)[0]) for k in keys if find(k) != k}
    real = {(None if a == -(2**63) else a, None if b == -(2**63) else b) for a, b in want}
    assert len(real & got) >= 0.98 * len(real) and not got - real
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert {1000, 1001, 1002} <= set(ids) and len(ids) == len(rows) - len(got) - 1  # the repeated row goes with its twin


def test_near_by_bands_of_similarity(spark):
    """Recall of single pairs from just above the threshold on, and nothing below it."""
    rng = random.Random(21)
    rows, j = [], {}
    for k in range(400):
        base = prose(rng, 150).split()
        w = list(base)
        for _ in range(rng.randint(1, 22)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w))]
        x, y = ({tuple(v[i : i + 3]) for i in range(len(v) - 2)} for v in (base, w))
        j[k] = len(x & y) / len(x | y)
    got = {r.doc_id // 2 for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    for low, high, least in ((0.5, 0.6, 0.97), (0.6, 0.8, 0.99), (0.8, 1.0, 1.0)):
        band = [k for k in j if low <= j[k] < high]
        assert len(band) > 20 and np.mean([k in got for k in band]) >= least
    assert not any(k in got for k in j if j[k] < 0.5)


def test_near_blocks(spark, monkeypatch):
    """A bucket of many components, in blocks of a few members: every pair is compared once it may matter."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "STARS", 1)
    rng = random.Random(2)
    common, rows = prose(rng, 40), []
    for k in range(60):  # pairs, each with an own half that its twin shares
        own = prose(rng, 45)
        rows += [(2 * k, common + " " + own + " " + prose(rng, 6)), (2 * k + 1, common + " " + own + " " + prose(rng, 6))]
    sets = {i: {tuple(t.split()[a : a + 3]) for a in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    got = {(r.doc_id, r.duplicate_of) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(i, r) for i, r in root.items() if i != r}


def test_components(spark):
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    alone = {x for x in parent if not any(x in e and e[0] != e[1] for e in edges)}
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in parent if x not in alone} and len(got) == len(parent) - len(alone)


def test_estimate():
    rng = np.random.default_rng(1)
    for j in (0.0, 0.3, 0.5, 0.8, 1.0):
        pairs = []
        for _ in range(30):
            n = 1000
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
            pairs += [np.unique(pool[:n]), np.unique(pool[n - both :])]
        r = near_dedup.registers(pairs)
        size = np.full(30, 1000)
        assert abs(near_dedup.estimate(r[::2], r[1::2], size, size).mean() - j) < 0.04


def test_empty(spark):
    docs = frame(spark, [])
    for f in (exact_dedup.exact_duplicates, near_dedup.near_duplicates, suffix_dedup.repeated_passages):
        assert f(docs).collect() == []
    for f in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, suffix_dedup.erase_repeats):
        assert f(docs).columns == docs.columns and f(docs).collect() == []
