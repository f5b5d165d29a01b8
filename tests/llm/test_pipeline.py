import collections
import itertools
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from test_dedup import brute_windows, prose
from weftgraph.llm import near_dedup, packing

BAD = ["vilx", "grobz", "nastq"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randint(60, 200)).split()
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    shared = prose(rng, 70)
    for i in range(400, 430):
        own = prose(rng, 100).split()
        rows.append((i, " ".join([*own[:40], *(shared.split() if i % 3 == 0 else []), *own[40:], *([rng.choice(BAD)] * 3 if i % 7 == 0 else [])])))
    rows += [(500 + k, rows[k][1]) for k in range(1, 6)] + [(520, rows[1][1])]
    for k in range(7, 11):
        w = rows[k][1].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "edited"
        rows.append((530 + k, " ".join(w)))
    rows += [(600, None), (601, ""), (602, ""), (603, None), rows[13], (604, "x")]
    return rows, labels


def expected(rows):
    kept = [r for r in rows if r[1] is None or not set(r[1].split()) & set(BAD)]
    best = {}
    for i, t in kept:
        if t is not None:
            best[t] = min(best.get(t, i), i)
    kept = [(i, None) for i, t in kept if t is None] + [(i, t) for t, i in best.items()]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(max(1, len(t.split()) - 2))} for i, t in kept if t and t.split()}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    kept = [(i, t) for i, t in kept if root.get(i, i) == i]
    gone = collections.defaultdict(set)
    for doc, a, _, _ in brute_windows(kept, 50):
        gone[doc] |= set(range(a, a + 50))
    out = {}
    for i, t in kept:
        n = len((t or "").split()) - len(gone[i])
        if not (gone[i] and n == 0):
            out[i] = n
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, labels = corpus()
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    size = collections.Counter()
    for r in got:
        size[r.doc_id] += r.n_words
    assert dict(size) == expected(corpus()[0])
    by = collections.defaultdict(list)
    for r in got:
        if r.n_words:
            by[r.sequence].append((r.place, r.n_words))
    for spans in by.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= packing.CAPACITY


def test_stages_on_odd_tables(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    odd = spark.createDataFrame(
        [(1, "a b", "en", "s", 3, "x", 7), (1, "a b", "en", "s", 3, "x", 7), (None, None, None, None, None, None, None), (2, "", None, None, 0, "y", 8), (3, "w " * 30000, "en", "s", 60000, "z", 9)],
        SCHEMA + ", row string, score int",
    )
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                assert (sum(r.text is None for r in rows) == 1) == (docs is odd)
