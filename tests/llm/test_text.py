import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import ann, bpe, common, language, token_count
from test_dedup import frame, prose

ODD = [None, "", " \n\t ", "a", "é", "😀 naïve x", "x" * 5000, "".join(random.Random(1).choices("abcdeé日", k=9000)), "foo  bar\r\nbaz's 12,345!!", "ﬀ ß Ž", "日本語 テキスト", "a\x00b"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ODD + [prose(rng, rng.randint(0, 80)) for _ in range(60)] + [prose(rng, 20000)] + ["the other one's of theatre"] * 3


def rows(texts):
    return [(None if i % 17 == 5 else i // 2, t) for i, t in enumerate(texts)]


def segment(v, word):
    raw = bytes([token_count.MARK]) + word
    best = [(0.0, 0)] + [None] * len(raw)
    for i in range(len(raw)):
        if best[i] is None:
            continue
        steps = [(j, v.pieces[raw[i:j]], 1) for j in range(i + 1, min(len(raw), i + v.longest) + 1) if raw[i:j] in v.pieces]
        k = 1 if raw[i] < 0x80 or raw[i] == 0xFF else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        if raw[i : i + k] not in v.pieces:
            steps.append((i + k, v.unknown, 3 if raw[i] == 0xFF else k))
        for j, s, n in steps:
            new = (best[i][0] + s, -(-best[i][1] + n))
            if best[j] is None or new > best[j]:
                best[j] = new
    return -best[-1][1]


@pytest.mark.skipif(not os.path.exists(token_count.VOCABULARY), reason="no vocabulary")
def test_token_counts(spark, texts):
    v = token_count.load()
    docs = frame(spark, rows(texts))
    got = sorted((r.doc_id is None, r.doc_id, -1 if r.n_tokens is None else r.n_tokens) for r in token_count.token_counts(docs, v).collect())
    want = sorted((i is None, i, -1 if t is None else sum(segment(v, w) for w in t.encode().split())) for i, t in rows(texts))
    assert [x[::2] for x in got if x[0]] == [x[::2] for x in want if x[0]] or sorted(x[2] for x in got if x[0]) == sorted(x[2] for x in want if x[0])
    assert [x for x in got if not x[0]] == [x for x in want if not x[0]]
    assert token_count.token_counts(docs.limit(0), v).collect() == []


def test_small_vocabularies():
    rng = random.Random(1)
    for _ in range(20):
        pieces = list(dict.fromkeys("".join(rng.choices("abcé▁", k=rng.randint(1, 4))) for _ in range(25)))
        v = token_count.unigram([p for p in pieces if "▁" not in p[1:]] + ["a"])
        text = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 60))) for _ in range(80))
        data, at = common.utf8(pa.array([text, "", text[:50]]))
        want = [sum(segment(v, w) for w in t.encode().split()) for t in (text, "", text[:50])]
        long = "".join(rng.choices("abcdé日", k=900)).encode()
        assert token_count.count_long(v, np.frombuffer(long, np.uint8)) == segment(v, long)
        token_count._known.clear()
        assert token_count.counts(v, data, at).tolist() == want
        assert token_count.counts(v, data, at).tolist() == want  # from what was kept


def test_two_vocabularies_in_one_worker():
    """Equal pieces with other scores, and models of as many pairs, have answers of their own."""
    data, at = common.utf8(pa.array(["abab abc", "cab"]))
    one, two = token_count.unigram(["▁", "a", "b", "c", "ab", "▁ab"]), token_count.unigram(["▁", "ab", "▁ab", "a", "c", "b"], unknown=1.0)
    for v in (one, two, one, two):
        assert token_count.counts(v, data, at).tolist() == [sum(segment(v, w) for w in t.split()) for t in (b"abab abc", b"cab")]
    base = {bytes([b]): b for b in range(256)}
    first, second = bpe.bpe(base | {b"ab": 256}), bpe.bpe(base | {b"cd": 256})
    text = ["abcd" * 900, "abcd"]
    for model in (first, second, first):
        ids, many = bpe._encoder_of(model).encode(text)
        back, end = bpe.decode_ids(model, ids, many)
        assert back.tobytes().decode() == "".join(text)
    assert bpe._merge_long(first, list(b"abcd")) == [256, 99, 100] and bpe._merge_long(second, list(b"abcd")) == [97, 98, 256]


def test_decode_outside_the_vocabulary(spark):
    model = bpe.bpe({bytes([b]): b for b in range(256)})
    rows = [(1, [104, 105]), (2, [104, 999]), (3, [-1]), (4, None), (5, []), (6, [104, None]), (7, [0xC3])]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, token_ids array<int>"), model).collect()}
    assert got == {1: "hi", 2: None, 3: None, 4: None, 5: "", 6: None, 7: "\ufffd"}


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
def test_bpe(spark, texts):
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = bpe.load()
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    coded = bpe.encode(docs, model)
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].token_ids is None and got[i].n_tokens is None and got[i].round_trip is None
        else:
            assert got[i].token_ids == other.encode_ordinary(t) and got[i].n_tokens == len(got[i].token_ids) and got[i].round_trip
    assert {r.doc_id: r.text for r in bpe.decode(coded, model).collect()} == dict(enumerate(texts))
    assert bpe.encode(docs.limit(0), model).collect() == []


def test_merges_leftmost_and_lowest():
    alphabet = {bytes([b]): b for b in range(256)}
    ranks = alphabet | {b"aa": 256, b"bc": 257, b"aaa": 258, b"ab": 259, b"aab": 260, b"bcbc": 261}
    model = bpe.bpe(ranks)

    def slow(raw):
        t = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(t, t[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[x] for x in t]
            t[best[1] : best[1] + 2] = [t[best[1]] + t[best[1] + 1]]

    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 70))) for _ in range(300)]
    ids, many = bpe.encode_tokens(model, words)
    parts = np.split(ids, np.cumsum(many)[:-1])
    for w in words[:100]:
        assert bpe._merge_long(model, list(w.encode())) == slow(w.encode())
    assert [p.tolist() for p in parts] == [ranks.get(w.encode()) and [ranks[w.encode()]] or slow(w.encode()) for w in words]


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(6)
    sound = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    say = lambda k, n: " ".join("".join(rng.choices(sound[k], k=5)) for _ in range(n))
    train = [(i, say(k, 60), k) for i, k in enumerate(list(sound) * 30)]
    test = [(1000 + i, say(k, 40), k) for i, k in enumerate(list(sound) * 10)]
    both = [(2000 + i, say("aa", 60) + " " + say("cc", 30), None) for i in range(10)]
    odd = [(3000, None, "aa"), (3001, "", "bb"), (3002, "ab", "aa"), (None, say("bb", 9), None)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(3)
    return frame(train), frame(test + both + odd), {i: k for i, _, k in test}


def test_language(tongues):
    train, docs, want = tongues
    got = {r.doc_id: r for r in language.identify(docs, language.train(train)).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i].languages == [k] for i, k in want.items()]) >= 0.95
    for i in range(2000, 2010):
        assert got[i].languages == ["aa", "cc"] and abs(got[i].proportions[0] - 2 / 3) < 0.1
    for i in (3000, 3001, 3002):
        assert got[i].language is None and got[i].languages == [] and got[i].proportions == []
    assert got[None].languages == ["bb"]
    nothing = language.identify(docs, language.train(train.limit(0))).collect()
    assert len(nothing) == len(got) and all(r.language is None for r in nothing)
    assert language.identify(docs.limit(0), language.train(train)).collect() == []


def test_mixture_likelihood_rises():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(language.GRAMS) * 0.01, 2).T + 1e-9
    m = language.Model(["a", "b"], np.log(p / p.sum(0)).astype(np.float32))
    gram = np.concatenate([rng.choice(language.GRAMS, 900, p=p[:, 0] / p[:, 0].sum()), rng.choice(language.GRAMS, 300, p=p[:, 1] / p[:, 1].sum())])
    share = language.infer(m, np.zeros(1200, np.int64), gram, 1, np.array([1202]), settled=1e-4)
    assert abs(share[0, 0] - 0.75) < 0.05 and share.sum() == pytest.approx(1)


def test_language_against_all_subsets():
    """Three languages: exhaustive search over every set, each with EM of its own."""
    import itertools

    rng = np.random.default_rng(11)
    p = rng.dirichlet(np.ones(language.GRAMS) * 0.02, 3).T + 1e-9
    m = language.Model(["a", "b", "c"], np.log(p / p.sum(0)).astype(np.float32))
    draws = [[1, 0, 0], [0, 1, 0], [0.6, 0, 0.4], [0, 0.5, 0.5], [0.34, 0.33, 0.33], [0.95, 0, 0.05], [0, 0, 1]] * 3
    row, gram, length = [], [], []
    for k, mix in enumerate(draws):
        n = 60 if k < 7 else 900
        g = [rng.choice(language.GRAMS, p=p[:, j] / p[:, j].sum()) for j in rng.choice(3, n, p=mix)]
        row, gram, length = row + [k] * n, gram + g, length + [n + 2]
    row, gram, length = np.array(row), np.array(gram), np.array(length)
    got = language.infer(m, row, gram, len(draws), length, settled=1e-4)
    q = np.exp(m.log_p.astype(float))
    same = 0
    for k in range(len(draws)):
        x = q[gram[row == k]]
        best = (-np.inf, None)
        for size in (1, 2, 3):
            for langs in itertools.combinations(range(3), size):
                share = np.full(size, 1 / size)
                for _ in range(3000):
                    joint = x[:, langs] * share
                    share = (joint / joint.sum(1, keepdims=True)).mean(0)
                gain = np.log(x[:, langs] @ share).sum() / 3 - language.PENALTY * np.log(length[k]) * (size - 1)
                best = max(best, (gain, langs, tuple(share)), key=lambda t: t[0])
        want = np.zeros(3)
        want[list(best[1])] = best[2]
        assert set(np.flatnonzero(got[k])) == set(best[1])
        assert np.abs(got[k] - want).max() < 0.02
        same += 1
    assert same == len(draws)


def test_language_ties_and_long_texts(spark):
    docs = [(1, "abc " * 50, "y"), (2, "abc " * 50, "x"), (3, "abc " * 50, None), (3, "abc " * 50, None), (4, "abc " * 200_000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = language.identify(frame, language.train(frame)).collect()
    assert len(got) == 5 and all(r.languages == ["x"] and r.proportions == [1.0] for r in got)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    x[100:110] = x[100]
    rows = [(int(i), v.tolist(), int(i), 1, "c") for i, v in enumerate(x)]
    odd = [(None, x[0].tolist()), (5000, None), (5001, []), (5002, [None] * 12), (5003, [float("nan")] * 12), (5004, [float("inf")] * 12), (5005, [1.0] * 11), (5006, [1e30] * 12)]
    table = spark.createDataFrame(rows + [(i, v, 0, 0, "c") for i, v in odd] + [rows[7]], "vec_id long, embedding array<float>, id long, block int, code string").repartition(3)
    got = ann.nearest(table, 10).collect()
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(range(1500))
    hit = 0
    for i, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert [r.distance for r in rs] == pytest.approx(np.sqrt([d[i, r.neighbour] for r in rs]), abs=1e-5)
        assert all((a.distance, a.neighbour) < (b.distance, b.neighbour) for a, b in zip(rs, rs[1:]))
        hit += sum(r.distance <= np.sqrt(np.sort(d[i])[9]) + 1e-6 for r in rs)
    assert hit >= 0.95 * 15000
    some = ann.nearest(table, 10, queries="id % 50 = 0").collect()
    assert {r.vec_id for r in some} == set(range(0, 1500, 50)) and len(some) == 300
    assert ann.nearest(table.limit(0)).collect() == []
    few = ann.nearest(table.where("vec_id < 4 and embedding is not null"), 10).collect()
    assert {(r.vec_id, r.neighbour) for r in few} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert ann.nearest(table.where("vec_id = 3")).collect() == []


def test_equal_vectors(spark):
    """A third of all rows is one vector: its rows are each other's neighbours, and the others lose none."""
    x = np.random.default_rng(8).standard_normal((900, 8)).astype(np.float32)
    x[:300] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(table, 5).collect()
    assert len(got) == 4500 and all(r.distance == 0 and r.neighbour < 300 for r in got if r.vec_id < 300)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert np.mean([r.distance**2 <= np.sort(d[r.vec_id])[4] + 1e-5 for r in got]) > 0.95


def test_search_expands_the_whole_list(spark):
    """The nearest vertex is linked from the last of twelve entry points only."""
    point = {0: 0.0, **{i: float(i) for i in range(1, 13)}, 99: 0.5}
    vecs = ann.vectors(spark.createDataFrame([(i, [x, 0.0]) for i, x in point.items()], "vec_id long, embedding array<float>"))
    a, b = np.array([0] * 12 + [12]), np.array([*range(1, 13), 99])
    lists = spark.createDataFrame(pa.Table.from_batches([ann._lists(a, b, (np.array([point[i] for i in b]) - np.array([point[i] for i in a])) ** 2)]).to_pandas(), ann._LIST)
    found = ann.search(vecs.where("id = 0"), ann._kept(vecs, lists, 12), 12, pool=12, at_once=5).first()
    e, _ = ann._packed(pa.array([bytes(found.blob)], pa.binary()), ann.ENTRY)
    assert e["nbr"][0] == 99 and len(e) == 12 and not e["new"].any()


def test_codes_and_packing():
    x = np.random.default_rng(1).standard_normal((50, 9)).astype(np.float32)
    x[3] = 0
    rows = ann.encode(x)
    back = ann._decode(ann._blobs(rows.reshape(-1), np.full(50, rows.shape[1])))
    assert np.abs(back - x).max() <= np.abs(x).max() / 250
    e, n = ann._packed(pa.array([None, b"", bytes(26), None, bytes(13)], pa.binary()).slice(1), ann.ENTRY)
    assert n.tolist() == [0, 2, 0, 1] and len(e) == 3
