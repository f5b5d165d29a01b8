"""Operators against brute force on small graphs."""

import collections
import itertools
import math
import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalars as C
from weftgraph.kg import KG, TYPE
from weftgraph.operators import filters, graph, linking, linkpred, mining, paths, sampling, stats, text
from weftgraph.streaming import windows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(f"v{rng.randrange(14)}", rng.choice("pq"), f"v{rng.randrange(14)}") for _ in range(34)]
    return [e for e in out if e[0] != e[2]] + [out[0]]


def edges(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def walk(rows, src, dst, longest, ok=lambda v: True):
    adj = collections.defaultdict(list)
    for s, p, o in rows:
        adj[s].append((p, True, o))
        adj[o].append((p, False, s))
    found = []

    def go(v, seen, path):
        if v == dst and path:
            found.append(tuple(path))
        elif len(path) < longest:
            for p, out, n in adj[v]:
                if n not in seen and (n == dst or ok(n)):
                    go(n, seen | {n}, path + [(p, out, n)])

    if src != dst:
        go(src, {src}, [])
    return collections.Counter(found)


@pytest.mark.parametrize("longest,most", [(1, None), (3, None), (4, 5)])
def test_paths(spark, rows, longest, most):
    rows = [r for r in rows if r[0] != r[2]]
    e = edges(spark, rows)
    degree = collections.Counter(v for s, _, o in rows for v in (s, o))
    pairs = [("v0", "v1"), ("v2", "v9"), ("v3", "v3"), ("v5", "v99")]
    got = collections.defaultdict(collections.Counter)
    found = paths.simple_paths(spark.createDataFrame(pairs, "src string, dst string"), paths.adjacency(e, most), longest)
    for r in found.collect():
        assert r.length == len(r.path)
        got[r.src, r.dst][tuple(tuple(x) for x in r.path)] += 1
    for a, b in pairs:
        assert got[a, b] == walk(rows, a, b, longest, (lambda v: degree[v] <= most) if most else (lambda v: True))


def test_topic_paths(spark):
    e = edges(spark, [("a", "p", "b"), ("b", "p", "c"), ("a", "p", "d"), ("d", "p", "c")])
    topic = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [0.4, 0.6]), ("d", [0.0, 1.0])], "v string, topic array<double>")
    pair = spark.createDataFrame([("a", "c")], "src string, dst string")
    near = paths.simple_paths(pair, paths.adjacency(e, topics=topic, divergence=0.4), 2).collect()
    assert [[x.v for x in r.path] for r in near] == [["b", "c"]]
    assert paths.simple_paths(pair, paths.adjacency(e), 2, topic, 0.35).collect() == []


def test_paths_between_ends(spark, rows):
    """Pairs that are never formed give the paths of the formed ones, with degrees and topics of vertices on either half."""
    rows = [r for r in rows if r[0] != r[2]]
    e = edges(spark, rows)
    a = spark.createDataFrame([(f"v{k}", k % 2) for k in range(6)], "src string, a int")
    b = spark.createDataFrame([(f"v{k}", k % 2) for k in range(3, 9)], "dst string, b int")
    degree = collections.Counter(v for s, _, o in rows for v in (s, o))
    near = {f"v{k}": [1.0, 0.0] if k % 3 else [0.0, 1.0] for k in range(12)}
    topics = spark.createDataFrame(list(near.items()), "v string, topic array<double>")
    plain, by_topic = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r in paths.path_scores(paths.simple_paths(paths.Ends(a, b, "a = b"), paths.adjacency(e, degree=True), 4)).collect():
        assert r.length == len(r.path) and [x.v_degree for x in r.path[:-1]] == [degree[x.v] for x in r.path[:-1]]
        inner = [1 / math.log2(1 + degree[x.v]) for x in r.path[:-1]]
        assert math.isclose(r.specificity, sum(inner) / len(inner) if inner else 1.0)
        plain[r.src, r.dst][tuple((x.p, x.out, x.v) for x in r.path)] += 1
    for r in paths.simple_paths(paths.Ends(a, b, "a = b"), paths.adjacency(e), 4, topics, 0.5).collect():
        by_topic[r.src, r.dst][tuple(tuple(x) for x in r.path)] += 1
    for i in range(6):
        for j in range(3, 9):
            want = walk(rows, f"v{i}", f"v{j}", 4) if i % 2 == j % 2 else collections.Counter()
            assert plain[f"v{i}", f"v{j}"] == want
            near_all = lambda p: all(near.get(v, near[f"v{i}"]) == near[f"v{i}"] for _, _, v in p)  # noqa: E731, B023
            assert by_topic[f"v{i}", f"v{j}"] == collections.Counter({p: n for p, n in want.items() if near_all(p)})


def test_many_pairs_few_paths(spark):
    """Four million pairs of ends, of which two are linked: 4,000 rows of ends are all that is read."""
    e = edges(spark, [("s1", "p", "m"), ("m", "p", "t1"), ("t2", "q", "m"), ("s3", "q", "x")])
    a, b = spark.range(2000).selectExpr("concat('s', id) src", "1 a"), spark.range(2000).selectExpr("concat('t', id) dst", "1 b")
    found = paths.simple_paths(paths.Ends(a, b, "a = b"), paths.adjacency(e), 3)
    assert sorted((r.src, r.dst, r.length) for r in found.collect()) == [("s1", "t1", 2), ("s1", "t2", 2)]


def test_stars_and_chains(spark, rows):
    typed = edges(spark, rows).select("*", F.lit(None).cast("timestamp").alias("ts"), F.substring("s", 2, 1).alias("st"), F.substring("o", 2, 1).alias("dt"))
    sig = [f"{s[1]}|{p}|{o[1]}" for s, p, o in rows]
    for at, k in (("s", 0), ("o", 2)):
        want = collections.Counter(tuple(sorted((sig[i], sig[j]))) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][k] == rows[j][k])
        assert {(r.a, r.b): r.n for r in stats.star_counts(typed, at).collect()} == want
    want = collections.Counter((sig[i], sig[j]) for i in range(len(rows)) for j in range(len(rows)) if rows[i][2] == rows[j][0])
    assert {(r.a, r.b): r.n for r in stats.chain_counts(typed).collect()} == want


def test_mining_grows_from_frequent(spark):
    rng = random.Random(3)
    rows = list({(f"a{rng.randrange(6)}", rng.choice("pq"), f"b{rng.randrange(6)}") for _ in range(25)})
    typed = edges(spark, rows).selectExpr("*", "'A' st", "'B' dt")
    found, links = mining.mine(typed, 2, 2)
    got = {r.pattern: r.support for r in found.collect()}
    one = collections.defaultdict(list)
    for e in rows:
        one[f"A|{e[1]}|B"].append((e,))
    sup = lambda inst: min(len({e[0] for i in inst for e in i}), len({e[2] for i in inst for e in i}))
    want = {p: sup(i) for p, i in one.items() if sup(i) >= 2}
    two = collections.defaultdict(list)
    for x, y in itertools.combinations(rows, 2):
        if {x[0], x[2]} & {y[0], y[2]}:
            two[" + ".join(sorted(f"A|{e[1]}|B" for e in (x, y)))].append((x, y))
    want |= {p: sup(i) for p, i in two.items() if sup(i) >= 2}
    assert got == want
    assert all(a in b.split(" + ") for a, b in links.collect())
    word = {r.pattern: r.status for r in mining.status(found, links).collect()}
    assert set(word) == set(got) and set(word.values()) <= {"closed", "promising", "redundant"}
    assert mining.mine(typed, 99, 2)[0].collect() == []
    grown, _ = mining.grow(mining.edge_instances(typed), edge_limit=1)
    assert grown.count() < sum(map(len, two.values()))
    four, _ = mining.mine(typed, 2, 4)
    assert set(got) <= {r.pattern for r in four.collect()}


def test_pairs_from_counts(spark):
    """Pair counts, supports and links without pairs are those of growth, with parallel, opposite and looped edges."""
    rng = random.Random(9)
    rows = list({(f"v{rng.randrange(7)}", rng.choice("pq"), f"v{rng.randrange(7)}") for _ in range(40)}) + [("v1", "p", "v1"), ("v1", "q", "v1")]
    kind = lambda c: F.concat(F.lit("T"), (F.substring(c, 2, 1).cast("int") % 2).cast("string"))
    one = mining.edge_instances(edges(spark, rows).distinct().withColumn("st", kind("s")).withColumn("dt", kind("o")))
    grown, links = mining.grow(one)
    n = {r.pattern: r["count"] for r in grown.groupBy("pattern").count().collect()}
    assert {r.pattern: r.n for r in mining.pair_counts(one).collect()} == n
    supports, found = mining.pair_support(one)
    assert {*map(tuple, supports.collect())} == {*map(tuple, mining.support(grown).collect())}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, links.collect()))


def test_mined_pairs_are_those_of_growth(spark):
    """Mining from signatures at vertices, without instances: patterns, links and pairs of followers as growth gives them."""
    rng = random.Random(5)
    rows = list({(f"v{rng.randrange(9)}", rng.choice("pq"), f"v{rng.randrange(9)}") for _ in range(50)}) + [("v1", "p", "v1"), ("v2", "q", "v1"), ("v1", "q", "v2")]
    kind = lambda c: F.concat(F.lit("T"), (F.substring(c, 2, 1).cast("int") % 3).cast("string"))
    typed = edges(spark, rows).distinct().withColumn("st", kind("s")).withColumn("dt", kind("o"))
    found, links = mining.mine(typed, 2, 2)
    one = mining.edge_instances(typed)
    frequent = filters.frequent_only(one, mining.support(one), 2)
    two, link = mining.grow(frequent)
    want = [(p, n) for x in (one, two) for p, n in mining.support(x).collect() if n >= 2]
    assert sorted((r.pattern, r.support) for r in found.collect()) == sorted(want)
    joined = {p for p, _ in want}
    assert sorted(map(tuple, links.collect())) == sorted((a, b) for a, b in link.collect() if b in joined)
    for k in (1, 2):
        n = mining.grow(one, edge_limit=k)[0].groupBy("pattern").count()
        assert sorted(map(tuple, mining.followed(one, k).collect())) == sorted(map(tuple, n.collect()))


@pytest.mark.parametrize("seed,vertices,n", [(1, 9, 22), (2, 14, 26), (3, 6, 16), (4, 20, 24)])
def test_mined_triples_are_those_of_growth(spark, seed, vertices, n):
    """Two growths without instances: patterns, supports and links as growth of all instances gives them."""
    rng = random.Random(seed)
    rows = list({(f"v{rng.randrange(vertices)}", rng.choice("pq"), f"v{rng.randrange(vertices)}") for _ in range(n)} | {("v1", "p", "v1"), ("v2", "q", "v1"), ("v1", "q", "v2")})
    kind = lambda c: F.concat(F.lit("T"), (F.substring(c, 2, 2).cast("int") % 3).cast("string"))
    typed = edges(spark, rows).distinct().withColumn("st", kind("s")).withColumn("dt", kind("o"))
    found, links = mining.mine(typed, 2, 4)
    if seed == 3:
        with mock.patch.object(mining, "_images", lambda k, real=mining._images: real(k, 8)):
            assert sorted(map(tuple, mining.mine(typed, 2, 4)[0].collect())) == sorted(map(tuple, found.collect()))
    one = mining.edge_instances(typed)
    frequent = filters.frequent_only(one, mining.support(one), 2)
    two, link2 = mining.grow(frequent)
    pair = mining.support(two)
    kept = filters.frequent_only(two, pair, 2).select(*frequent.columns)
    three, link3 = mining.grow(frequent.unionByName(kept), "edge")
    want = {p: k for x in (mining.support(one), pair, mining.support(three)) for p, k in x.collect() if k >= 2}
    assert any(p.count("+") == 2 for p in want)
    assert {r.pattern: (r.size, r.support) for r in found.collect()} == {p: (p.count("+") + 1, k) for p, k in want.items()}
    assert {*map(tuple, links.collect())} == {(a, b) for x in (link2, link3) for a, b in x.collect() if b in want}


def test_batches_are_no_keys_of_edges(spark):
    """Supports of windows by brute force; edges are not joined by batch."""
    rng = random.Random(8)
    rows = [(f"v{rng.randrange(8)}", rng.choice("pq"), f"v{rng.randrange(8)}", rng.choice([1, 2, 4, 7, None])) for _ in range(60)]
    typed = spark.createDataFrame(rows, "s string, p string, o string, batch long").withColumn("st", F.lit("A")).withColumn("dt", F.lit("B"))
    for window in (1, 3):
        want = {}
        for b in (1, 2, 4, 7):
            for p in "pq":
                e = [x for x in rows if x[1] == p and x[3] is not None and b - window < x[3] <= b]
                if e:
                    want[b, f"A|{p}|B"] = min(len({x[0] for x in e}), len({x[2] for x in e}))
        got = mining.per_batch_support(typed, window)
        assert {(r.batch, r.pattern): r.support for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan


def test_pagerank_and_triangles(spark, rows):
    e = edges(spark, rows)
    link = {(s, o) for s, _, o in rows}
    v = sorted({x for p in link for x in p})
    rank = dict.fromkeys(v, 1.0)
    out = collections.Counter(s for s, _ in link)
    for _ in range(4):
        rank = {x: 0.15 + 0.85 * sum(rank[s] / out[s] for s, o in link if o == x) for x in v}
    assert {r.v: pytest.approx(r["rank"]) for r in graph.pagerank(e, 4).collect()} == rank
    und = {tuple(sorted(p)) for p in link}
    want = collections.Counter(x for t in itertools.combinations(v, 3) if all(q in und for q in itertools.combinations(t, 2)) for x in t)
    assert {r.v: r.triangles for r in graph.triangles(e).collect()} == want
    steady = {r.v: r["rank"] for r in graph.pagerank(e, 200, tolerance=1e-9).collect()}
    assert steady == pytest.approx({x: 0.15 + 0.85 * sum(steady[s] / out[s] for s, o in link if o == x) for x in v}, abs=1e-6)


def test_encoding(spark, rows):
    e = edges(spark, rows)
    ints, v, p = graph.encode_graph(e)
    labels = sorted({x for s, _, o in rows for x in (s, o)})
    assert {r.label: r.id for r in v.collect()} == {x: i for i, x in enumerate(labels)}
    assert sorted(map(tuple, graph.decode_graph(ints, v, p).collect())) == sorted(rows)


def dice(a, b):
    x, y = collections.Counter(a), collections.Counter(b)
    return 2 * sum((x & y).values()) / (len(a) + len(b))


def test_phrases(spark):
    same = C.phrase_similarity_of
    assert same("New York", "york new") == 1 and same("a b c", "a b") == pytest.approx(0.8)
    assert same("barak obama", "barack obama") == 1.0  # by edit distance
    assert same("", "x") == 0 and same(None, "x") is None and same("red car", "blue sky") == 0
    df = spark.createDataFrame([("a a b", "a b b"), ("x_y", "Y,x"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(C.dice(C.tokens(F.col("a")), C.tokens(F.col("b")))).collect()]
    assert got == pytest.approx([dice("aab", "abb"), 1.0, 0.0])
    C.register(spark)
    assert spark.sql("select phrase_sim('New York', 'york new')").first()[0] == 1
    assert spark.sql("select js_divergence(array(1D, 0D), array(0D, 1D))").first()[0] == 1


def test_divergences(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.5, 0.5], [1.0, 0.0]), ([1.0], [0.5, 0.5])], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    assert [r[0] for r in df.select(C.js_divergence(p, q)).collect()][:2] == [1.0, 0.0]
    assert [r[0] for r in df.select(C.kl_divergence(p, q)).collect()] == [math.inf, 0.0, math.inf, None]
    assert df.select(C.js_divergence(p, q)).collect()[3][0] is None
    soft = df.limit(1).select(C.softmax(F.array(F.lit(1.0), F.lit(3.0)))).first()[0]
    assert soft == pytest.approx([1 / (1 + math.e**2), math.e**2 / (1 + math.e**2)])
    s = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in s.select(C.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]
    m = spark.createDataFrame([("He saw her.", [("He", "Bob")])], "t string, m array<struct<mention:string,name:string>>")
    assert m.select(C.coreference(F.col("t"), F.col("m"))).first()[0] == "Bob saw her."
    assert [C.doublings(n) for n in (1, 2, 4, 9)] == [0, 1, 2, 3]


def test_filters(spark):
    t = spark.createDataFrame([("Bob Ray", "was", "tall", ["Bob"]), ("Bob Ray", "saw", "it", ["Bob"]), ("he", "saw", "Bob", ["Bob"]), ("Bob", "'s", "Bob", ["Bob"])], "s string, p string, o string, phrases array<string>")
    assert [r.p for r in filters.named_triples(t).collect()] == ["saw"]
    x = spark.createDataFrame([(float("nan"),), (0.9,), (0.1,)], "x double")
    assert x.where(filters.scored(F.col("x"), 0.5)).count() == 1
    d = spark.createDataFrame([("the cat is on the mat",), ("der Hund und die Katze",)], "t string")
    assert d.where(filters.english(F.col("t"))).count() == 1


def test_sampling_repeats_and_bounds(spark):
    e = edges(spark, [(f"a{i % 40}", "p", f"b{i}") for i in range(800)])
    chosen = stats.degrees(e).where("degree > 5").select("v")
    for q, p, low, high in ((1.0, 0.0, 800, 800), (0.0, 0.0, 0, 0), (0.5, 0.0, 330, 470)):
        got = sampling.sample_and_hold(e, chosen, p, q)
        assert low <= got.count() <= high and sorted(got.collect()) == sorted(sampling.sample_and_hold(e.repartition(7), chosen, p, q).collect())
    assert {(r.percent, r.q, r.p) for r in sampling.grid(e).collect()} == set(itertools.product((10, 20, 30, 40, 50), (0.2, 0.4, 0.6, 0.8, 1.0), (0.2, 0.4, 0.6, 0.8, 1.0)))


@pytest.mark.parametrize("most", [100_000, 0])
def test_band_sample_is_that_of_joins(spark, most):
    """Broadcasting the vertices outside the band takes the same edges, and joins no edge by a shuffle."""
    rng = random.Random(4)
    rows = [(f"v{rng.randrange(8) ** 2}", rng.choice("pq"), f"v{rng.randrange(8)}") for _ in range(300)]
    e = edges(spark, rows + [(None, "p", "v3"), ("v3", "q", None), (None, "q", None)])
    d = stats.degrees(e)
    want = sampling.sample_and_hold(e, sampling.value_band(d, "degree", 20), 0.1, 0.5)
    got = sampling.band_sample(e, d, "degree", 20, 0.1, 0.5, most=most)
    key = lambda df: sorted(map(str, df.select("s", "p", "o").collect()))
    assert key(got) == key(want) and 0 < len(key(want)) < 300
    if most:
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_factor_tables_in_blocks(spark):
    """Tables of factors are written block by block, so the driver has no list of all rows."""
    m = linkpred.start(5, 7, linkpred.Settings(factors=3))
    sizes, real = [], spark.createDataFrame
    with mock.patch.object(spark, "createDataFrame", lambda data, *a: sizes.append(len(data)) or real(data, *a)):
        u, i = linkpred.model_tables(spark, m, list("abcde"), list("fghijkl"), block=3)
    assert max(sizes) == 3
    assert {r.user: r.pu for r in u.collect()} == dict(zip("abcde", m.users.tolist()))
    assert {r["item"]: (r.qi, r.bias) for r in i.collect()} == {k: (q, 0.0) for k, q in zip("fghijkl", m.items.tolist())}


def test_extraction(spark):
    assert text.extract_text("Obama was born in Hawaii")[-1][:3] == ("Obama", "was born in", "Hawaii")
    docs = spark.createDataFrame([(1, "Obama was born in Hawaii. The New York Times praised Obama.\nnothing here"), (2, None), (3, "")], "doc_id long, text string")
    got = {tuple(r) for r in text.document_triples(docs).collect()}
    assert ("Obama", "was born in", "Hawaii") in got
    strict = text.named_phrases(text.sentences(docs), "strict").select(F.explode("phrases")).collect()
    assert [r[0] for r in strict] == ["New York Times"]
    s = text.named_phrases(text.sentences(docs))
    assert '"s":"Obama"' in text.as_json(s, text.extract(s)).first().json

    def fails(sentence):
        raise RuntimeError

    assert text.extract(s, extractor=fails).collect() == []
    tagged = spark.createDataFrame([("Obama", "PER")], "name string, tag string")
    assert ("Obama", TYPE, "PER") in {tuple(r) for r in text.document_triples(docs, tagged).collect()}
    assert text.with_provenance(text.extract(s), docs.selectExpr("doc_id", "'t' ts", "'u' url")).first().url == "u"


def test_linking(spark):
    triples = spark.createDataFrame([("d1", "Jordan", "played for", "Chicago Bulls"), ("d2", "Jordan", "borders", "Iraq"), ("d2", "Zork", "is", "Iraq")], "block string, s string, p string, o string")
    ents = ["Michael Jordan", "Jordan", "Chicago Bulls", "Iraq", "Jordan Country"]
    labels = spark.createDataFrame([(e, "Jordan" if "Jordan" in e else e) for e in ents], "entity string, label string")
    e = edges(spark, [("Michael Jordan", "plays", "Chicago Bulls"), ("Jordan Country", "borders", "Iraq"), ("Michael Jordan", "in", "Hall"), ("Chicago Bulls", "in", "Hall"), ("Jordan Country", "in", "Asia"), ("Iraq", "in", "Asia")])
    got = {(r.block, r.mention): r.entity for r in linking.link(triples, labels, e).collect()}
    assert got["d1", "Jordan"] == "Michael Jordan" and got["d2", "Jordan"] == "Jordan Country"
    assert got["d2", "Zork"] == "new: Zork" and got["d2", "Iraq"] == "Iraq"
    fast = linking.candidates(labels, linking.mentions(triples)).select("mention", "entity").collect()
    assert set(fast) == set(linking.all_pairs(labels, linking.mentions(triples)).select("mention", "entity").collect())
    import pandas as pd

    block = pd.DataFrame({"block": ["x"] * 4, "src": ["m:a", "m:a", "e:1", "e:2"], "dst": ["e:1", "e:2", "e:2", "e:1"], "w": [0.7, 0.3, 1.0, 1.0]})
    s = linking.evidence(block, 0.2)
    r = np.linalg.inv(np.eye(3) - 0.8 * np.array([[0, 1, 0.7], [1, 0, 0.3], [0, 0, 0]])) @ np.array([0, 0, 0.2])
    assert s.score.tolist() == pytest.approx([0.7 * r[0], 0.3 * r[1]])


def test_link_prediction(spark):
    rng = np.random.default_rng(0)
    pos = [(f"u{u}", f"i{i}") for u in range(30) for i in range(20) if (u + i) % 2 == 0 and rng.random() < 0.8]
    held = [(f"u{u}", f"i{i}") for u in range(30) for i in range(20) if (u + i) % 2 == 0 and (f"u{u}", f"i{i}") not in pos]
    t = spark.createDataFrame(pos, "user string, item string")
    friends = spark.createDataFrame([(f"u{u}", f"u{(u + 2) % 30}") for u in range(30)], "user string, friend string")
    for near in (None, friends):
        users, items = linkpred.train(t, linkpred.Settings(factors=8, rate=0.1, epochs=40), near)
        e = linkpred.evaluate(linkpred.scores(users, items), t, spark.createDataFrame(held, "user string, item string"), 3).first()
        assert e.auc > 0.85 and 0 <= e.arhr <= e.hr <= 1
    seen = linkpred.ranked(linkpred.scores(users, items), t)
    assert seen.join(t, ["user", "item"]).count() == 0
    svm = spark.createDataFrame([(float(i % 2), i % 2 + 0.1 * (i % 3)) for i in range(200)], "label double, x double")
    assert linkpred.pattern_classifier(svm, ["x"])[1] > 0.95


def test_all_scores_by_blocks(spark):
    """Ranks and figures over all users and items are those of the table of all scores, which is never made."""
    rng = random.Random(4)
    u, i = [(f"u{k}",) for k in range(25)], [(f"i{k}",) for k in range(70)]
    pairs = [(a, b, rng.random()) for (a,) in u for (b,) in i]
    users, items = spark.createDataFrame(u, "user string"), spark.createDataFrame(i, "item string")
    known = spark.createDataFrame([(a, b) for a, b, x in pairs if x < 0.3], "user string, item string")
    test = spark.createDataFrame([(a, b) for a, b, x in pairs if x > 0.9] + [("nobody", "i1"), ("u1", "nothing")], "user string, item string")
    score = lambda a, b: F.round(C.uniform(a, b, seed=3), 1)
    table = users.crossJoin(items).withColumn("score", score(F.col("user"), F.col("item")))
    got = linkpred.best_by_score(users, items, score, known, 4, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, linkpred.ranked(table, known, 4).collect()))
    assert linkpred.evaluate_by_score(users, items, score, known, test, 4, block=16).first() == pytest.approx(linkpred.evaluate(table, known, test, 4).first())


def test_near_topics_lose_none(spark):
    rng = np.random.default_rng(2)
    x = rng.dirichlet([0.4] * 6, 90)
    x[:20] = x[20:40] + rng.random((20, 6)) / 40
    t = spark.createDataFrame([(k, k % 2, (x[k] / x[k].sum()).tolist()) for k in range(90)] + [(90, 0, [1.0]), (91, 0, None)], "v long, label int, topic array<double>")
    a, b = t.toDF("v", "label", "x"), t.toDF("nbr", "label", "y")
    for below in (0.004, 0.1):
        near = filters.coherent(F.col("x"), F.col("y"), below)
        want = sorted(map(tuple, a.join(b, "label").where("v < nbr").where(near).select("v", "nbr").collect()))
        close = filters.near_topics(t, "label", below, block=10)
        assert close.count() < 2000
        got = close.join(a.drop("label"), "v").join(b.drop("label"), "nbr").where(near).select("v", "nbr")
        assert want and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("threshold", [0.7, 0.4])
def test_candidates_lose_none(spark, threshold):
    rng = random.Random(6)
    base = ["france", "united kingdom", "ab", "a", "new york city", "customer#000000012", "trinidad and tobago", "éclair", "abcdefghij" * 4, "thirtyonelettersinthisonewordxy"]

    def typo(s):
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + rng.choice(["", "x", " ", "q"]) + s[at + rng.randrange(2) :]
        return s

    said = ["rance", "Xrance", "kited nungdom", "", "_", "brance tobago"] + [typo(b) for b in base for _ in range(12)]
    names = base + [typo(b) for b in base for _ in range(6)]
    m = spark.createDataFrame([(x,) for x in said], "mention string")
    e = spark.createDataFrame([(f"e{k}", x) for k, x in enumerate(names)], "entity string, label string")
    got, want = (sorted((r.mention, r.entity, round(r.similarity, 9)) for r in f(e, m, threshold).collect()) for f in (linking.candidates, linking.all_pairs))
    assert got == want and ("rance", "e0", 1.0) in got


def test_link_by_another_first_letter(spark):
    triples = spark.createDataFrame([("d1", "rance", "borders", "pain")], "block string, s string, p string, o string")
    labels = spark.createDataFrame([("n:1", "france"), ("n:2", "spain")], "entity string, label string")
    got = {r.mention: r.entity for r in linking.link(triples, labels, edges(spark, [("n:1", "borders", "n:2")])).collect()}
    assert got == {"rance": "n:1", "pain": "n:2"}


def test_training_beyond_the_sample(spark):
    rng = np.random.default_rng(4)
    pos = [(f"u{u:03}", f"i{i:03}") for u in range(120) for i in range(40) if (u + i) % 2 == 0 and rng.random() < 0.8]
    held = [(f"u{u:03}", f"i{i:03}") for u in range(120) for i in range(40) if (u + i) % 2 == 0 and (f"u{u:03}", f"i{i:03}") not in set(pos)]
    t, held = (spark.createDataFrame(x, "user string, item string") for x in (pos, held))
    friends = spark.createDataFrame([(f"u{u:03}", f"u{(u + 2) % 120:03}") for u in range(120)], "user string, friend string")
    s = linkpred.Settings(factors=8, rate=0.1, epochs=25, sample=100)
    for near in (None, friends):
        users, items = linkpred.train(t, s, near)
        assert {r.user for r in users.collect()} == {u for u, _ in pos} and {r.item for r in items.collect()} == {i for _, i in pos}
    at = spark.createDataFrame([(k, f"i{k:03}") for k in range(40)], "nth long, item string")
    got = linkpred._draws(t, at, friends, 3, 0.5, s)
    assert 0.3 < len(got) / len(pos) < 0.5 and not {*zip(got.user, got.neg)} & set(pos) and not {*zip(got.user, got.social)} & set(pos)


def test_evaluation_by_brute_force(spark):
    rng = random.Random(2)
    pair = [(f"u{u}", f"i{i}") for u in range(4) for i in range(12)]
    score = {p: rng.choice([0.1, 0.2, 0.3, 0.4]) for p in pair}
    test, known = set(rng.sample(pair, 9)), set(rng.sample(pair, 14))
    per = []
    for p in test:
        other = [(score[q], q[1]) for q in pair if q[0] == p[0] and q not in test | known]
        per.append((sum(x > score[p] or x == score[p] and i < p[1] for x, i in other), len(other)))
    df = lambda x: spark.createDataFrame(sorted(x), "user string, item string")
    got = linkpred.evaluate(spark.createDataFrame([(*p, x) for p, x in score.items()], "user string, item string, score double"), df(known), df(test), 3).first()
    assert got.hr == pytest.approx(np.mean([a < 3 for a, _ in per])) and got.arhr == pytest.approx(np.mean([1 / (a + 1) if a < 3 else 0 for a, _ in per]))
    assert got.auc == pytest.approx(np.mean([1 - a / n for a, n in per if n]))


def test_stream(spark, tmp_path):
    import datetime

    def day(y):
        return datetime.datetime(y, 6, 1)

    rows = [(f"s{i}", "p", f"o{i % 3}", "A", "B", day(2000 + i // 4)) for i in range(16)]
    source = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], windows.TRIPLE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(windows.TRIPLE).option("maxFilesPerTrigger", 1).parquet(source)
    miner = windows.SlidingMiner(str(tmp_path / "state"), window=2, least=2)
    windows.start(stream, miner, str(tmp_path / "cp")).awaitTermination()
    history = {r.epoch: r for r in miner.history(spark).where("pattern = 'A|p|B'").collect()}
    assert len(history) == 4 and all(r.support in (2, 3, 4) for r in history.values())
    counts = windows.windowed_signatures(spark.readStream.schema(windows.TRIPLE).parquet(source), "1095 days", "365 days", "1 day")
    q = counts.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.max("n")).first()[0] >= 4


def test_stream_mines_the_window_anew(spark, tmp_path):
    """After each micro-batch, late rows and repeated epochs included, the result is that of mining the window at once."""
    import random

    from weftgraph.operators import mining

    rng = random.Random(4)
    miner = windows.SlidingMiner(str(tmp_path / "state"), window=2, least=2)
    seen, latest = [], -1
    for epoch, year in enumerate([2001, 2002, 2002, 2001, 2004, 2002]):
        rows = []
        for _ in range(14):
            s, o = rng.randrange(6), rng.randrange(6)
            rows.append((f"a{s}", rng.choice("pq"), f"b{o}", "A" if s < 3 else "C", "B", f"{year}-06-01 00:00:00"))
        micro = spark.createDataFrame(rows, "s string, p string, o string, st string, dt string, at string").selectExpr("s", "p", "o", "st", "dt", "cast(at as timestamp) AS ts")
        seen.append(micro)
        for _ in range(1 + (epoch == 2)):
            miner(micro, epoch)
        all_ = seen[0]
        for m in seen[1:]:
            all_ = all_.unionByName(m)
        batched = windows.with_batch(all_)
        # what had left the window when it came, or has since, is gone
        latest = max(latest, year)
        current = windows.with_batch(spark.sql(f"SELECT timestamp '{latest}-06-01 00:00:00' AS ts")).first().batch
        want, _ = mining.mine(windows.in_window(batched, current, 2), 2, 2)
        got = {(r.pattern, r.support) for r in miner.history(spark).where(f"epoch = {epoch}").collect()}
        assert got == {(r.pattern, r.support) for r in want.collect()} and any("+" in p for p, _ in got)


def test_rank_is_global(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(500)], "k int, i int").repartition(5)
    got = [(r.k, r.i) for r in stats.ranked_rows(df, "k", "i").orderBy("rank0").collect()]
    assert got == sorted((i % 10, i) for i in range(500))


def test_small_kg(spark):
    kg = KG(spark.createDataFrame([("a", TYPE, "T2", None), ("a", TYPE, "T1", None), ("a", "p", "b", None)], "s string, p string, o string, ts timestamp"))
    assert kg.types.first().types == ["T1", "T2"] and kg.main_type.first().type == "T1"
    assert stats.typed_edges(kg).count() == 0
    assert {tuple(r) for r in stats.vertex_features(kg).collect()} == {("a", 1, "T1;;T2"), ("b", 1, "NONE")}


def plan_of(df):
    """As it is planned where nothing is small enough to be broadcast by its size."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_triple_counts_by_rows(spark, rows):
    """partitions follow from the number of rows, not from a setting."""
    got = stats.triple_counts(edges(spark, rows), 5)
    assert got.rdd.getNumPartitions() == -(-len(rows) // 5)
    assert {(r.s, r.p, r.o): r.n for r in got.collect()} == collections.Counter(rows)


def test_triangles_form_few_candidates(spark):
    """30 customers of 12 shops in one town: 30 * 66 pairs of neighbours, but only one way on from a shop."""
    e = edges(spark, [(f"c{i}", "buysFrom", f"s{j}") for i in range(30) for j in range(12)] + [(x, "in", "town") for x in [f"c{i}" for i in range(30)] + [f"s{j}" for j in range(12)]])
    with mock.patch.object(graph, "_candidates", side_effect=graph._candidates) as seen:
        got = {r.v: r.triangles for r in graph.triangles(e).collect()}
    assert got == {"town": 360, **{f"c{i}": 12 for i in range(30)}, **{f"s{j}": 30 for j in range(12)}}
    assert graph._candidates(*seen.call_args.args).count() <= 402


@pytest.mark.parametrize("current", [None, 1])
def test_pair_counts_without_join(spark, rows, current):
    """each edge goes to its two ends once; pairs that meet at two vertices count once."""
    rows = sorted(set(rows) | {("v0", "p", "v1"), ("v0", "q", "v1"), ("v1", "p", "v0"), ("v2", "p", "v2")})
    typed = [(s, p, o, "AB"[int(s[1:]) % 2], "AB"[int(o[1:]) % 2], i % 3) for i, (s, p, o) in enumerate(rows)]
    want = collections.Counter()
    for x, y in itertools.combinations(typed, 2):
        if {x[0], x[2]} & {y[0], y[2]} and (current is None or current in (x[5], y[5])):
            pattern = " + ".join(sorted(f"{e[3]}|{e[1]}|{e[4]}" for e in (x, y)))
            want[pattern if current is None else (pattern, max(x[5], y[5]))] += 1
    got = mining.pair_counts(mining.edge_instances(spark.createDataFrame(typed, "s string, p string, o string, st string, dt string, batch long")), current)
    assert {(r.pattern if current is None else (r.pattern, r.batch)): r.n for r in got.collect()} == want
    assert "Join" not in plan_of(got)


def test_pagerank_of_hubs(spark, rows):
    """F31, F32, F35: a source's targets lie in several rows."""
    e = edges(spark, rows)
    assert {r.v: pytest.approx(r["rank"]) for r in graph.pagerank(e, 3, most=1).collect()} == {r.v: r["rank"] for r in graph.pagerank(e, 3).collect()}


def test_edges_are_not_sorted(spark, rows):
    """F31, F33 to F39, F41: what is joined to the edges is hashed."""
    e = edges(spark, rows)
    kg = KG(e.unionByName(spark.createDataFrame([(f"v{i}", TYPE, "T") for i in range(14)], "s string, p string, o string")).withColumn("ts", F.lit(None).cast("timestamp")))
    assert "SortMergeJoin" not in plan_of(stats.typed_edges(kg))
    ints, v, p = graph.encode_graph(e)
    assert "SortMergeJoin" not in plan_of(graph.decode_graph(ints, v, p))
    ranks = stats.degrees(e).select("v", F.col("degree").alias("rank"))
    assert "SortMergeJoin" not in plan_of(sampling.sample_and_hold(e, ranks.where("rank > 5"), 0.1, 0.5))
    assert "SortMergeJoin" not in plan_of(sampling.similar_rank(e, ranks, 0.1))
    assert "SortMergeJoin" not in plan_of(sampling.grid(e))


def test_grid_by_bounds(spark, rows):
    """bounds in any order, each case as counted by itself."""
    e = edges(spark, rows)
    drawn = e.select("s", "o", sampling._draw(1).alias("x"), sampling._draw(2).alias("y")).collect()
    place = {r.v: r.rank0 for r in stats.rank_band(stats.degrees(e), "degree", 100, "v").collect()}
    n = len(place)
    for r in sampling.grid(e, (30, 10), (0.6, 0.2), (1.0, 0.4, 0.1)).collect():
        near = lambda v: min(place[v], n - 1 - place[v])
        assert r.kept == sum(min(near(d.s), near(d.o)) < n * r.percent / 100 and (d.x < r.q or d.y < r.p) for d in drawn)


def typed_graph(spark, seed=3):
    """Triples with parallel edges, a source without a type, a target without one and many sources that have the same signatures."""
    rng = random.Random(seed)
    out = [(f"s{i}", TYPE, rng.choice("AB")) for i in range(60)] + [(f"t{i}", TYPE, f"T{i % 6}") for i in range(30)]
    out += [(f"s{rng.randrange(62)}", rng.choice("pq"), f"t{rng.randrange(32)}") for _ in range(500)]
    out += [x for i in range(40) for x in ((f"u{i}", TYPE, "U"), (f"u{i}", "p", f"t{i % 6}"), (f"u{i}", "p", f"t{i % 6}"), (f"u{i}", "q", "t6"), (f"u{i}", "q", "t12"))]
    return out, KG(spark.createDataFrame(out, "s string, p string, o string").withColumn("ts", F.lit(None).cast("timestamp")))


def signatures(rows):
    """By source, the signatures of its distinct triples."""
    kind = {s: min(o for x, p, o in rows if p == TYPE and x == s) for s, p, _ in rows if p == TYPE}
    out = collections.defaultdict(list)
    for s, p, o in set(rows):
        if p != TYPE and s in kind and o in kind:
            out[s].append(f"{kind[s]}|{p}|{kind[o]}")
    return out


def test_sets_of_signatures_are_grown_by_different_sets(spark):
    rows, kg = typed_graph(spark)
    want = collections.Counter(tuple(sorted(set(x))) for x in signatures(rows).values())
    sets = stats.signature_sets(kg)
    assert collections.Counter({tuple(r.sigs): r.n for r in sets.collect()}) == want and sets.count() == len(want)
    got = stats.set_pattern_stats(sets, 2, 5)
    have = collections.Counter(c for x, n in want.items() for k in range(1, 6) for c in itertools.combinations(x, k) for _ in range(n))
    by = [[n for c, n in have.items() if len(c) == k and n > 2] for k in range(1, 6)]
    assert [tuple(r) for r in got.orderBy("size").collect()] == [(k + 1, len(x), sum(x)) for k, x in enumerate(by)]
    # it neither joins nor shuffles edges once the sets are there
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in stats.set_pattern_stats(sets.where("false"), 2, 2).orderBy("size").collect()] == [(1, 0, 0), (2, 0, 0)]


def test_signatures_of_each_triple(spark):
    """Parallel edges count once, edges to targets of one type each."""
    rows, kg = typed_graph(spark)
    want = collections.Counter(tuple(sorted(x)) for x in signatures(rows).values())
    assert collections.Counter({tuple(r.sigs): r.n for r in stats.signature_sets(kg, each=True).collect()}) == want
    assert any(len(set(x)) < len(x) for x in want)
