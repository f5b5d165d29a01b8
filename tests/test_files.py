"""Readers and sinks over small files."""

import json

import pytest

from weftgraph.sources import readers as R
from weftgraph.sources import sinks as K


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_triples(spark, tmp_path):
    p = put(tmp_path, "a.txt", "# note\n\n<A>\t<likes>\t<B> .\nid1\tA\tlikes\tC\n@prefix x\n3210#skip\nA\tb\nA\tlikes\tB\n")
    assert got(R.triples(spark, p)) == [("a", "likes", "b"), ("a", "likes", "c")]
    assert R.rejected(spark, p).first()[0] == 1
    assert got(R.read_graph(spark, p)) == got(R.triples(spark, p))


def test_timed_ints(spark, tmp_path):
    p = put(tmp_path, "q.tsv", "1\t0\t2\t2010-01-01 00:00:00.000\n1\t5\t3\t2010/03 10:00:00.000\nx\t1\t2\t2010-01-01 00:00:00.000\n4\t5\t6\tnever\n7\t8\t9\n")
    rows = {r.s: r for r in R.timed_ints(spark, p).where("o != 2").collect()}
    assert set(rows) == {1, 4, 7}
    assert str(rows[1].ts) == "2010-03-01 10:00:00" and rows[4].ts is None and rows[7].batch is None
    assert R.timed_ints(spark, p).where("o = 2").first().batch == 40
    assert R.timed_triples(spark, put(tmp_path, "t.ttl", "A\tb\tC\t2015-02-03T04:05:06.007\nA\tb\tD\n")).where("ts is not null").count() == 1


def test_labelled_graph(spark, tmp_path):
    p = put(tmp_path, "g.lg", "t # 1\nv 0 6\nv 1 2\ne 0 1 3.5\n")
    assert got(R.labelled_graph(spark, p).select("s", "p", "o")) == [("0", "E", "1"), ("0", "rdf:type", "6"), ("1", "rdf:type", "2")]
    assert got(R.labelled_ints(spark, p)) == [(0, 10, 6), (0, 11, 1), (1, 10, 2)]
    assert R.read_graph(spark, p).count() == 3
    assert got(R.labelled_graph(spark, p, prefix="Type_").where("p != 'E'").select("o")) == [("Type_2",), ("Type_6",)]


def test_edge_lists_topics_pairs(spark, tmp_path):
    assert got(R.edge_list(spark, put(tmp_path, "e3", "1\t7\t2\n1\t7\t2\n1\t2\nbad\t1\t2\n"))) == [(1, 7, 2), (1, 7, 2)]
    assert got(R.edge_list(spark, put(tmp_path, "e2", "1\t2\n1\t7\t2\n"), columns=2)) == [(1, -1, 2)]
    assert R.topics(spark, put(tmp_path, "t", "5\t0.25,0.75\n")).first() == (5, [0.25, 0.75])
    assert got(R.entity_pairs(spark, put(tmp_path, "p", "a\tb\n#x\ty\n"))) == [("a", "b")]
    assert got(R.entity_pairs(spark, put(tmp_path, "ps", "a\tb,c\n"), sets=True)) == [("a", "b"), ("a", "c")]


def test_nlp(spark, tmp_path):
    rows = got(R.nlp_blocks(spark, put(tmp_path, "n", "A\tsees\tB\nB\tis\tC\tx\n;\nD\tsees\tE\n")).select("block", "s", "o"))
    assert rows == [(0, "A", "B"), (0, "B", "C"), (1, "D", "E")]
    assert got(R.nlp_triples(spark, put(tmp_path, "u", "A\tsees\tB\t2015\thttp://x\nA\tsees\tB\n#\n"))) == [("http://x", "A", "sees", "B", "2015")]


def test_documents(spark, tmp_path):
    p = put(tmp_path, "d.json", json.dumps({"text": "one\n\ntwo", "url": "u"}) + "\n")
    a = put(tmp_path, "a.json", json.dumps({"content": "x\ny", "meta": {"canonical": "c"}}) + "\n")
    assert got(R.document_lines(spark, p, "web")) == [("u", "one"), ("u", "two")]
    assert got(R.document_lines(spark, a, "article")) == [("c", "x"), ("c", "y")]
    assert [r.line for r in R.document_lines(spark, put(tmp_path, "p.txt", "l1\n\nl2\n")).collect()] == ["l1", "l2"]
    with pytest.raises(ValueError):
        R.document_lines(spark, p, "other")
    assert R.config("a = 1\n# b = 2\nc=x=y\n") == {"a": "1", "c": "x=y"}
    assert R.listed_files("#no.json\na.json\nb.txt\n", ".json") == ["a.json"]
    assert R.corpus(spark, R.config(f"files = {p}\nformat = web\n")).count() == 2


def test_json_fields(spark):
    docs = [
        {"structured_data": {"items": [{"properties": {"title": ["T"], "url": "U"}}]}},
        {"open_graph": {"title": "O", "published_time": "2015"}},
        {"mime_type": "text/html", "text": "x", "http_headers": {"Date": "D"}},
        {},
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").orderBy("i")
    assert [r[0] for r in df.select(R.json_format(F.col("j"))).collect()] == [1, 2, 0, -1]
    og = [r[0] for r in df.select(R.open_graph_json(F.col("j"))).collect()]
    assert (og[0].title, og[0].url, og[1].title, og[1].ts) == ("T", "U", "O", "2015")
    text = [r[0] for r in df.select(R.text_json(F.col("j"))).collect()]
    assert (text[2].content, text[2].ts, text[3].ts) == ("x", "D", None)


def test_site_pages(spark):
    lines = ["Quad X1", "Category", "Toy", "Features", "fast", "red", "", "more", "Continue reading here", "Continue reading there"]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "source string, pos int, line string")
    assert got(R.product_triples(df).select("s", "p", "o")) == [("Quad X1", "hasFeature", "fast"), ("Quad X1", "hasFeature", "red"), ("Quad X1", "rdf:type", "Toy")]
    assert R.snippet(df).first().line == "Continue reading here"


def test_logs(spark, tmp_path):
    rows = R.security_log(spark, put(tmp_path, "r.csv", "1,U1,C1,C2\n"), "redteam").collect()
    assert {(r.p, r.o) for r in rows} == {("hasTs", "1"), ("hasUser", "U1"), ("hasSource", "C1"), ("hasTarget", "C2")}


def test_pattern_files(spark, tmp_path):
    assert got(R.pattern_history(spark, put(tmp_path, "h", "(a b ,40 3|41 5)\n")).select("pattern", "batch", "support")) == [("a b", 40, 3), ("a b", 41, 5)]
    assert got(R.pattern_supports(spark, put(tmp_path, "s", "(a\tb,7)\n"))) == [("a\tb", 7)]
    assert R.pattern_nodes(spark, put(tmp_path, "n", "a,b,Set(1, 2)\n")).first() == ("a,b", ["1", "2"])


def test_ratings(spark, tmp_path):
    assert got(R.ratings(spark, put(tmp_path, "r", "3 4 3\n1 2\n\n4\n"))) == [(1, 1), (1, 2), (3, 4)]
    assert got(R.subjects(spark, put(tmp_path, "s", "new york 3\nparis 1\n"))) == [("new york", 3), ("paris", 1)]
    paper = put(tmp_path, "p.json", json.dumps({"sections": [{"heading": "Intro", "text": "a\nb"}, {"heading": "References", "text": "x"}]}) + "\n")
    assert [r.line for r in R.paper_lines(spark, paper).collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    p = spark.createDataFrame([("x + y", 3)], "pattern string, support long")
    K.patterns(p, d + "/p")
    assert spark.read.text(d + "/p").first()[0] == "x + y\t3"
    K.batch_patterns(p.selectExpr("7L as batch", "*"), d + "/b")
    assert spark.read.text(d + "/b").first()[0] == "7\tx + y\t3"
    dep = spark.createDataFrame([("a", "b"), ("c", "c")], "small string, joined string")
    K.dependencies(dep, d + "/d")
    assert "a=>b" in [r[0] for r in spark.read.text(d + "/d").collect()]
    K.write_dot(dep, d + "/dot")
    assert [r[0] for r in spark.read.text(d + "/dot").collect()] == ["digraph dependencies {", '  "a" -> "b" [label="part_of"]', "}"]
    f = spark.createDataFrame([(1.0, 2.0, 0.5)], "label double, a double, b double")
    K.libsvm(f, d + "/svm", "label", ["a", "b"])
    assert spark.read.format("libsvm").option("numFeatures", 2).load(d + "/svm").first().features.toArray().tolist() == [2.0, 0.5]
    path = spark.createDataFrame([("1", "3", 2, [("7", True, "2"), ("8", False, "3")])], "src string, dst string, length int, path array<struct<p:string,out:boolean,v:string>>")
    K.paths_by_pair(path, d + "/paths")
    assert spark.read.text(d + "/paths/src=1/dst=3").first()[0] == "1 : (7-Out) 2, (8-In) 3"
    assert K.labelled_paths(path).first().value == "Outgoing ; 1 ; 7 ; 2\nIncoming ; 3 ; 8 ; 2\n"
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, label string")
    back = K.decoded_paths(path, names, spark.createDataFrame([(7, "sees"), (8, "has")], "id long, label string")).first()
    assert (back.src, back.dst, [tuple(x) for x in back.path]) == ("A", "C", [("sees", True, "B"), ("has", False, "C")])
    K.features(spark.sql("select 'v' v, array(1,2) n"), d + "/f")
    assert spark.read.option("header", True).csv(d + "/f").first().n == "[1,2]"
    K.weighted_pairs(spark.createDataFrame([("a", "b", 3)], "a string, b string, n long"), d + "/w")
    assert spark.read.text(d + "/w").first()[0] == "a , b , 3"
    K.graph(p, d + "/g")
    assert spark.read.parquet(d + "/g").count() == 1
    assert K.commas_to_tabs(spark.createDataFrame([("a,b",)], "value string")).first()[0] == "a\tb"
