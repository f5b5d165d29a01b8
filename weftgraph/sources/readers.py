"""Readers of delimited graph files, NLP triples, documents and logs. All are lazy; malformed rows are left out and
``rejected`` counts them on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kg import TYPE, YEAR_MS, batch_id

SKIPPED = r"^(3210#|@|#)"
NO_LABEL = -1


def valid_line(line: Column, skipped: str = SKIPPED) -> Column:
    """Neither empty nor a comment."""
    return (F.length(line) > 0) & ~line.rlike(skipped)


def fields(line: Column, separator: str = "\t") -> Column:
    """Lower-case fields without angle brackets and `` .`` endings, each without one space at either end."""
    return F.transform(F.split(F.regexp_replace(F.lower(line), r"[<>]| \.", ""), separator), lambda f: F.regexp_replace(f, "^ | $", ""))


def _fields(spark: SparkSession, path, separator: str = "\t") -> DataFrame:
    return spark.read.text(path).where(valid_line(F.col("value"))).select(fields(F.col("value"), separator).alias("f"))


def triples(spark: SparkSession, path) -> DataFrame:
    """(s, p, o), distinct: three fields are a triple; of four the first is an id before it; others are left out."""
    f = _fields(spark, path).where(F.size("f").isin(3, 4))
    at = F.size("f") - 3
    return f.select(*[F.element_at("f", at + 1 + k).alias(c) for k, c in enumerate("spo")]).distinct()


def rejected(spark: SparkSession, path, sizes=(3, 4)) -> DataFrame:
    """(rejected): how many lines that aren't comments have another number of fields."""
    return _fields(spark, path).agg(F.count_if(~F.size("f").isin(*sizes)).alias("rejected"))


def _timestamp(text: Column, pattern: str) -> Column:
    repaired = F.regexp_replace(text, r"^(\d{4})([/-])(\d{2}) ", "$1$2$3$201 ")  # a month without a day
    return F.coalesce(F.try_to_timestamp(repaired, F.lit(pattern)), F.try_to_timestamp(F.replace(repaired, F.lit("/"), F.lit("-"))))


def timed_ints(spark: SparkSession, path, batch_ms: int | None = None, pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> DataFrame:
    """(s, p, o, ts, batch): tab-separated integers and a time. Rows without three integers are left out; a time that is
    missing or can't be read is null."""
    f = spark.read.text(path).where(valid_line(F.col("value"))).select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    i = [F.get("f", F.lit(k)).try_cast("int").alias(c) for k, c in enumerate("spo")]
    out = f.select(*i, _timestamp(F.get("f", F.lit(3)), pattern).alias("ts")).where("s is not null and p is not null and o is not null")
    return out.withColumn("batch", batch_id(F.col("ts"), batch_ms or YEAR_MS))


def timed_triples(spark: SparkSession, path, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSS") -> DataFrame:
    """(s, p, o, ts) of lines with three fields or more; ts is null where there is none."""
    f = _fields(spark, path).where("size(f) >= 3")
    return f.select(*[F.get("f", F.lit(k)).alias(c) for k, c in enumerate("spo")], _timestamp(F.upper(F.get("f", F.lit(3))), pattern).alias("ts"))


def labelled_graph(spark: SparkSession, path, type_predicate: str = TYPE, edge_predicate: str = "E", prefix: str = "") -> DataFrame:
    """(s, p, o, w) of ``v id label`` and ``e source target weight`` lines; a vertex is a type triple, with ``prefix`` before its label."""
    f = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("f"))
    g = lambda k: F.get("f", F.lit(k))
    v = f.where((g(0) == "v") & (F.size("f") >= 3)).select(g(1).alias("s"), F.lit(type_predicate).alias("p"), F.concat(F.lit(prefix), g(2)).alias("o"), F.lit(None).cast("double").alias("w"))
    e = f.where((g(0) == "e") & (F.size("f") >= 3)).select(g(1).alias("s"), F.lit(edge_predicate).alias("p"), g(2).alias("o"), g(3).try_cast("double").alias("w"))
    return v.unionAll(e)


def labelled_ints(spark: SparkSession, path) -> DataFrame:
    """As ``labelled_graph`` with integers: predicate 10 for a vertex, 11 for an edge."""
    g = labelled_graph(spark, path, "10", "11")
    return g.select(*[F.col(c).try_cast("int").alias(c) for c in "spo"]).dropna()


def sources_typed(edges: DataFrame, kind: str = "paper") -> DataFrame:
    """``edges`` and a type triple for every source."""
    extra = edges.select("s").distinct().select("s", F.lit(TYPE).alias("p"), F.lit(kind).alias("o"))
    return edges.select("s", "p", "o").unionByName(extra)


def normalised(triples: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Distinct triples with ``;`` for ``,`` and some names replaced."""
    names = names or {"drones": "drone"}
    t = triples.select(*[F.translate(c, ",", ";").alias(c) for c in "spo"])
    for old, new in names.items():
        t = t.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in "spo"})
    return t.distinct()


def predicates_hashed(triples: DataFrame) -> DataFrame:
    return triples.withColumn("p", F.xxhash64("p"))


def edge_list(spark: SparkSession, path, separator: str = "\t", columns: int = 3) -> DataFrame:
    """(s, p, o) of integer lines with exactly so many columns; with two the predicate is -1. Repeated rows stay."""
    f = spark.read.text(path).where(valid_line(F.col("value"))).select(F.split("value", separator).alias("f")).where(F.size("f") == columns)
    g = lambda k, t: F.get("f", F.lit(k)).try_cast(t)
    p = F.lit(NO_LABEL) if columns == 2 else g(1, "int")
    return f.select(g(0, "long").alias("s"), p.alias("p"), g(1 if columns == 2 else 2, "long").alias("o")).dropna()


def topics(spark: SparkSession, path) -> DataFrame:
    """(v, topic) of ``id <tab> x,y,...`` lines."""
    f = spark.read.text(path).where(valid_line(F.col("value"))).select(F.split("value", "\t").alias("f"))
    return f.select(F.get("f", F.lit(0)).cast("long").alias("v"), F.split(F.get("f", F.lit(1)), ",").cast("array<double>").alias("topic"))


def entity_pairs(spark: SparkSession, path, sets: bool = False) -> DataFrame:
    """(src, dst) of tab-separated lines; with ``sets`` the second field lists targets between commas."""
    f = spark.read.text(path).where(valid_line(F.col("value"))).select(F.split("value", "\t").alias("f")).where("size(f) >= 2")
    dst = F.get("f", F.lit(1))
    return f.select(F.trim(F.get("f", F.lit(0))).alias("src"), (F.explode(F.split(dst, " *, *")) if sets else F.trim(dst)).alias("dst"))


def nlp_blocks(spark: SparkSession, path) -> DataFrame:
    """(file, block, s, p, o): tab-separated triples of three or four columns; a line that ends in ``;`` ends its block.

    Blocks are numbered within their file, so lines are numbered a file at a time and need no global order.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", ";[ \t]*\r?(?:\n|$)").alias("blocks"))
    block = text.select("file", F.posexplode("blocks").alias("block", "body"))
    line = block.select("file", "block", F.explode(F.split("body", "\r?\n")).alias("line")).where(valid_line(F.col("line")))
    f = line.select("file", "block", F.split("line", "\t").alias("f")).where("size(f) in (3, 4)")
    return f.select("file", "block", *[F.trim(F.get("f", F.lit(k))).alias(c) for k, c in enumerate("spo")])


def nlp_triples(spark: SparkSession, path) -> DataFrame:
    """(block, s, p, o, ts): lines of exactly s, p, o, time, url; the url is the block."""
    f = spark.read.text(path).where(valid_line(F.col("value"), "^#")).select(F.split("value", "\t").alias("f")).where("size(f) = 5")
    g = lambda k: F.trim(F.get("f", F.lit(k)))
    return f.select(g(4).alias("block"), g(0).alias("s"), g(1).alias("p"), g(2).alias("o"), g(3).alias("ts"))


DOCUMENT_FORMATS = ("text", "web", "article")


def document_lines(spark: SparkSession, path, kind: str = "text") -> DataFrame:
    """(source, line): non-empty lines of plain text, of ``text`` in crawled JSON, or of ``content`` in article JSON."""
    if kind == "text":
        d = spark.read.text(path).select(F.input_file_name().alias("source"), F.col("value").alias("line"))
    elif kind == "web":
        d = spark.read.schema("text string, url string").json(path).select(F.col("url").alias("source"), F.explode(F.split("text", "\n")).alias("line"))
    elif kind == "article":
        d = spark.read.schema("content string, meta struct<canonical:string>").json(path)
        d = d.select(F.col("meta.canonical").alias("source"), F.explode(F.split("content", "\n")).alias("line"))
    else:
        raise ValueError(f"no such document format: {kind}")
    return d.where(F.trim("line") != "")


def config(text: str) -> dict[str, str]:
    """``key = value`` lines; ``#`` begins a comment line."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip() for k, v in pairs}


def listed_files(text: str, suffix: str = "") -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip().endswith(suffix)]


def corpus(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    """(source, line) of the JSON files that ``settings`` (``files``, ``format``) list."""
    return document_lines(spark, listed_files(settings["files"].replace(",", "\n"), ".json"), settings.get("format", "web"))


def json_format(json: Column) -> Column:
    """1 with structured data, 2 with open graph, 0 for HTML, else -1."""
    has = lambda key: F.get_json_object(json, f"$.{key}").isNotNull()
    return F.when(has("structured_data"), 1).when(has("open_graph"), 2).when(F.get_json_object(json, "$.mime_type") == "text/html", 0).otherwise(-1)


FORMAT_NAMES = {1: "structured", 2: "open graph", 0: "html", -1: "unknown"}


def open_graph_json(json: Column) -> Column:
    """Struct of title, description, ts, url: from ``open_graph`` or the first item's properties of ``structured_data``."""
    def key(name):
        a, b = F.get_json_object(json, f"$.open_graph.og:{name}"), F.get_json_object(json, f"$.structured_data.items[0].properties.{name}")
        return F.coalesce(F.get_json_object(json, f"$.open_graph.{name}"), a, F.get_json_object(b, "$[0]"), b)

    return F.struct(key("title").alias("title"), key("description").alias("description"), F.coalesce(key("published_time"), F.get_json_object(json, "$.crawled_dt")).alias("ts"), F.coalesce(key("url"), F.get_json_object(json, "$.url")).alias("url"))


def html_fields(html: Column) -> Column:
    """Struct of title, lang and the open-graph title of an HTML text; empty where missing."""
    return F.struct(
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, r'<html lang="([^"]*)"', 1).alias("lang"),
        F.regexp_extract(html, r'<meta property="og:title" content="([^"]*)"', 1).alias("og_title"),
    )


def text_json(json: Column) -> Column:
    """Struct of content, ts, url; the time from ``Date`` or the HTTP headers."""
    g = lambda k: F.get_json_object(json, k)
    return F.struct(g("$.text").alias("content"), F.coalesce(g("$.Date"), g("$.http_headers.Date")).alias("ts"), g("$.url").alias("url"))


def json_field(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def product_triples(lines: DataFrame) -> DataFrame:
    """(source, s, p, o) from product pages (source, pos, line): the first line is the product, the line after
    ``Category`` its type, lines after ``Features`` up to an empty one its features."""
    from pyspark.sql import Window as W

    order = W.partitionBy("source").orderBy("pos")
    mark = F.when(F.trim("line").isin("Features", "Category"), F.trim("line")).when(F.trim("line") == "", "")
    x = lines.withColumns({"label": F.first("line").over(order), "mark": F.last(mark, ignorenulls=True).over(order), "before": F.lag("line").over(order)})
    p = F.when((F.col("mark") == "Features") & (F.trim("line") != "Features"), "hasFeature").when(F.trim("before") == "Category", TYPE)
    return x.withColumn("p", p).where("p is not null and trim(line) != ''").select("source", F.col("label").alias("s"), "p", F.trim("line").alias("o"))


def snippet(lines: DataFrame, marker: str = "Continue reading") -> DataFrame:
    """(source, line): the first line of each source that has the marker."""
    return lines.where(F.contains("line", F.lit(marker))).groupBy("source").agg(F.min_by("line", "pos").alias("line"))


LOG_COLUMNS = {
    "redteam": ("ts", "user", "source", "target"),
    "flows": ("ts", "duration", "source", "source_port", "target", "target_port", "protocol", "packets", "bytes"),
    "dns": ("ts", "source", "resolved"),
    "proc": ("ts", "user", "computer", "process", "action"),
    "auth": ("ts", "source_user", "target_user", "source", "target", "kind", "logon", "orientation", "result"),
}


def wide_to_triples(rows: DataFrame, subject: Column, columns: dict[str, str]) -> DataFrame:
    """(s, p, o): a triple for each column of each row that isn't null; ``columns`` maps predicates to columns."""
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in columns.items()])
    return rows.select(subject.cast("string").alias("s"), F.explode(entries).alias("x")).select("s", "x.p", "x.o").where("o is not null")


def security_log(spark: SparkSession, path, kind: str) -> DataFrame:
    """(s, p, o) of a comma-separated log; the subject is the line's hash."""
    names = LOG_COLUMNS[kind]
    rows = spark.read.schema(", ".join(f"{c} string" for c in names)).csv(path)
    subject = F.concat(F.lit(kind + ":"), F.xxhash64(*names).cast("string"))
    return wide_to_triples(rows, subject, {"has" + c.title().replace("_", ""): c for c in names})


def pattern_history(spark: SparkSession, path) -> DataFrame:
    """(file, pattern, batch, support) of ``(pattern ,batch support|batch support...)`` lines."""
    f = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\(|\)$", "").alias("line"))
    cut = f.select("file", F.trim(F.regexp_extract("line", r"^(.*),[^,]*$", 1)).alias("pattern"), F.explode(F.split(F.regexp_extract("line", r",([^,]*)$", 1), r"\|")).alias("pair"))
    return cut.select("file", "pattern", F.split("pair", " ")[0].cast("long").alias("batch"), F.split("pair", " ")[1].cast("long").alias("support"))


def pattern_supports(spark: SparkSession, path) -> DataFrame:
    """(pattern, support) of ``(edge<tab>edge...,support)`` lines."""
    line = F.regexp_replace("value", r"^\(|\)$", "")
    return spark.read.text(path).select(F.regexp_extract(line, r"^(.*),\d+$", 1).alias("pattern"), F.regexp_extract(line, r",(\d+)$", 1).cast("long").alias("support"))


def pattern_nodes(spark: SparkSession, path) -> DataFrame:
    """(pattern, nodes) of ``pattern,Set(a, b)`` lines."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(.*),Set\(", 1).alias("pattern"), F.split(F.regexp_extract("value", r"Set\(([^)]*)\)", 1), ", *").alias("nodes"))


def ratings(spark: SparkSession, path) -> DataFrame:
    """(user, item) of a file whose first line is ``users items pairs`` and whose row i lists the items of user i.

    Both count from 1. The file is one model's training set and is read as one text.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("user", "line"))
    return rows.where("user > 0").select("user", F.explode(F.split(F.trim("line"), " +")).alias("item")).where("item != ''").select(F.col("user").cast("int"), F.col("item").cast("int"))


def subjects(spark: SparkSession, path) -> DataFrame:
    """(label, id) of ``label id`` lines."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(.*) \d+ *$", 1).alias("label"), F.regexp_extract("value", r" (\d+) *$", 1).cast("int").alias("id"))


PAPER = "sections array<struct<heading:string, text:string>>"


def paper_lines(spark: SparkSession, path) -> DataFrame:
    """(source, heading, line) of paper JSON, without the references."""
    d = spark.read.schema(PAPER).json(path).select(F.input_file_name().alias("source"), F.explode("sections").alias("x"))
    d = d.where(~F.lower(F.coalesce("x.heading", F.lit(""))).startswith("references"))
    return d.select("source", "x.heading", F.explode(F.split("x.text", "\n")).alias("line")).where("trim(line) != ''")


READERS = {".lg": labelled_graph, ".tsv": timed_triples, ".els": lambda s, p: sources_typed(timed_triples(s, p)), ".parquet": lambda s, p: s.read.parquet(p), ".ttl": timed_triples}


def read_graph(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Triples by the file's suffix or ``kind``; rows without a subject or object are left out."""
    suffix = kind or next((k for k in READERS if path.endswith(k)), None)
    read = READERS.get(suffix, triples)
    return read(spark, path).where("s is not null and o is not null")
