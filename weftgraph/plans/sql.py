"""Common table expressions from which the queries' SQL begins."""

TRIPLES = """
tr AS (
  SELECT 'c:' || c_custkey AS s, 'rdf:type' AS p, c_mktsegment AS o, CAST(NULL AS TIMESTAMP) AS ts FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'rdf:type', o_orderpriority, NULL FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'rdf:type', p_type, NULL FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'rdf:type', 'supplier', NULL FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'rdf:type', 'nation', NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'rdf:type', 'region', NULL FROM region
  UNION ALL SELECT 'c:' || o_custkey, 'placed', 'o:' || o_orderkey, o_orderdate FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'contains', 'p:' || l_partkey, l_shipdate FROM lineitem
  UNION ALL SELECT 'o:' || l_orderkey, 'shippedBy', 's:' || l_suppkey, l_shipdate FROM lineitem
  UNION ALL SELECT 'c:' || c_custkey, 'inNation', 'n:' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'inNation', 'n:' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'inRegion', 'r:' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'u:' || user_id, event_type, 'd:' || strftime(ts, '%Y-%m-%d'), ts FROM events),
e AS (SELECT * FROM tr WHERE p <> 'rdf:type'),
mt AS (SELECT s AS v, min(o) AS type FROM tr WHERE p = 'rdf:type' GROUP BY s),
te AS (SELECT e.*, a.type AS st, b.type AS dt, a.type || '|' || e.p || '|' || b.type AS sig FROM e JOIN mt a ON e.s = a.v JOIN mt b ON e.o = b.v),
adj AS (SELECT s AS v, p, o AS nbr, true AS out FROM e UNION ALL SELECT o, p, s, false FROM e),
deg AS (SELECT v, count(*) AS degree FROM adj GROUP BY v)"""

BATCH = "CAST(epoch_ms(ts) // 31556952000 AS BIGINT)"


def kg(rest: str) -> str:
    return f"WITH RECURSIVE {TRIPLES} {rest}"


def uniform(seed: int) -> str:
    return f"(('0x' || substr(md5(s || '|' || p || '|' || o || '|{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def pagerank(rounds: int, source: str) -> str:
    out = f""", l AS (SELECT DISTINCT s, o FROM {source}), d AS (SELECT s, count(*) AS k FROM l GROUP BY s),
    vs AS (SELECT s AS v FROM l UNION SELECT o FROM l), r0 AS (SELECT v, 1.0::DOUBLE AS rank FROM vs)"""
    for i in range(rounds):
        out += f""", r{i + 1} AS (SELECT vs.v, 0.15 + 0.85 * coalesce(g.given, 0) AS rank FROM vs LEFT JOIN (
            SELECT l.o AS v, sum(r.rank / d.k) AS given FROM l JOIN d ON l.s = d.s JOIN r{i} r ON r.v = l.s GROUP BY l.o) g ON g.v = vs.v)"""
    return out
