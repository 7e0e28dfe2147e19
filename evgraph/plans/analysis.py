"""Registered queries for graph analytics, reports and streams (G, T, W), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators import graph as G
from evgraph.operators import relate as E
from evgraph.operators import report as T
from evgraph.operators.components import connected_components
from evgraph.plans import views as V
from evgraph.plans.evidence import EV, PAIR_REL, events_once, evidence, relationships
from evgraph.plans.registry import QUERIES, SQL, query
from evgraph.session import as_pattern, shared_dir, stored
from evgraph.streaming import flows as W


def _graph(t) -> DataFrame:
    return stored(V.graph(t), "graph")


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("g1_degree", f"WITH {V.GRAPH} SELECT src AS id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight, round(count(*) / ((SELECT count(*) FROM nodes_v) - 1), 6) AS centrality FROM both_v GROUP BY src")
def g1(t) -> DataFrame:
    return _rounded(G.degree(_graph(t)), "centrality")


@query("g2_degree_ranking", f"WITH {V.GRAPH} SELECT src AS id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM both_v GROUP BY src ORDER BY weight DESC, degree DESC, id LIMIT 50")
def g2(t) -> DataFrame:
    return G.degree_ranking(_graph(t))


LEVELS = 8


def _bfs(sources: str) -> str:
    """Unrolled levels of (s, v, dist, paths)."""
    out = [f"p0 AS MATERIALIZED (SELECT id AS s, id AS v, 0 AS dist, 1::DOUBLE AS paths FROM {sources})"]
    for k in range(1, LEVELS + 1):
        out.append(
            f"p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL SELECT f.s, b.dst, {k}, sum(f.paths) FROM p{k - 1} f JOIN both_v b ON f.v = b.src WHERE f.dist = {k - 1} AND NOT EXISTS (SELECT 1 FROM p{k - 1} q WHERE q.s = f.s AND q.v = b.dst) GROUP BY f.s, b.dst)"
        )
    return ", ".join(out)


ALL_PATHS = f"{V.GRAPH}, {_bfs('nodes_v')}"
PIVOTS = "piv AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS k, count(*) OVER () AS n FROM nodes_v) WHERE n <= 40 OR k <= least(32, greatest(8, floor(2 * sqrt(n)))))"
COMP = "reach AS (SELECT id, id AS low FROM nodes_v UNION SELECT b.dst, r.low FROM reach r JOIN both_v b ON r.id = b.src), comp AS (SELECT id, min(low) AS low FROM reach GROUP BY id)"
BETWEEN = f"""{PIVOTS}, n AS (SELECT count(*) AS n, (SELECT count(*) FROM piv) AS k FROM nodes_v), b AS (SELECT sv.v AS id, sum(sv.paths * vt.paths / st.paths) AS x FROM p{LEVELS} sv JOIN p{LEVELS} vt ON sv.v = vt.s JOIN p{LEVELS} st ON st.s = sv.s AND st.v = vt.v
  WHERE sv.s IN (FROM piv) AND sv.s <> sv.v AND vt.s <> vt.v AND sv.s <> vt.v AND st.dist = sv.dist + vt.dist GROUP BY sv.v),
bt AS (SELECT id, round(coalesce(x, 0) * (n / k) / ((n - 1) * (n - 2)), 6) + 0.0 AS betweenness FROM nodes_v LEFT JOIN b USING (id), n)"""
CLOSE = f"""{COMP}, dg AS (SELECT src AS id, count(*) AS deg FROM both_v GROUP BY src), lm AS (SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY low) AS size, row_number() OVER (PARTITION BY low ORDER BY deg DESC, id) AS k FROM comp JOIN dg USING (id)) WHERE size <= 120 OR k <= 32),
cs AS (SELECT id, round(coalesce(count(dist) / sum(dist), 0), 6) AS closeness FROM nodes_v LEFT JOIN (SELECT v AS id, dist FROM p{LEVELS} WHERE s <> v AND s IN (FROM lm)) USING (id) GROUP BY id)"""


#: The same levels until nothing new is reached: (s, v) is the key, and only rows of the last level go on.
EVERY_LEVEL = """p(s, v, dist, paths) USING KEY (s, v) AS (SELECT id, id, 0, 1::DOUBLE FROM nodes_v UNION SELECT f.s, b.dst, f.dist + 1, sum(f.paths) FROM p f JOIN both_v b ON f.v = b.src
  WHERE NOT EXISTS (SELECT 1 FROM recurring.p q WHERE q.s = f.s AND q.v = b.dst) GROUP BY f.s, b.dst, f.dist)"""


def _at_any_depth(sql: str) -> str:
    return sql.replace(_bfs("nodes_v"), EVERY_LEVEL).replace(f"p{LEVELS} ", "p ")


@query("g3_betweenness", f"""WITH {ALL_PATHS}, n AS (SELECT count(*) AS n FROM nodes_v), b AS (SELECT sv.v AS id, sum(sv.paths * vt.paths / st.paths) AS x FROM p{LEVELS} sv JOIN p{LEVELS} vt ON sv.v = vt.s JOIN p{LEVELS} st ON st.s = sv.s AND st.v = vt.v
  WHERE sv.s <> sv.v AND vt.s <> vt.v AND sv.s <> vt.v AND st.dist = sv.dist + vt.dist GROUP BY sv.v)
SELECT id, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 6) + 0.0 AS betweenness FROM nodes_v LEFT JOIN b USING (id), n""")
def g3(t) -> DataFrame:
    return _rounded(G.betweenness(_graph(t)), "betweenness")


@query("g4_betweenness_pivots", f"WITH {ALL_PATHS}, {BETWEEN} SELECT * FROM bt")
def g4(t) -> DataFrame:
    return _rounded(G.betweenness(_graph(t), "auto"), "betweenness")


@query("g5_closeness", f"WITH {ALL_PATHS} SELECT v AS id, round(CASE WHEN sum(dist) > 0 THEN (count(*) - 1) * (count(*) - 1) / (sum(dist) * ((SELECT count(*) FROM nodes_v) - 1)) ELSE 0 END, 6) AS closeness FROM p{LEVELS} GROUP BY v")
def g5(t) -> DataFrame:
    return _rounded(G.closeness(_graph(t)), "closeness")


@query("g5_closeness_component", _at_any_depth(f"WITH RECURSIVE {ALL_PATHS} SELECT v AS id, round(CASE WHEN sum(dist) > 0 THEN (count(*) - 1) / sum(dist) ELSE 0 END, 6) AS closeness FROM p{LEVELS} GROUP BY v"))
def g5c(t) -> DataFrame:
    return _rounded(G.closeness(_graph(t), scope="component"), "closeness")


@query("g6_closeness_landmarks", _at_any_depth(f"WITH RECURSIVE {ALL_PATHS}, {CLOSE} SELECT * FROM cs"))
def g6(t) -> DataFrame:
    return _rounded(G.closeness_landmarks(_graph(t)), "closeness")


def _rank_sql(rounds: int = 20) -> str:
    out = ["o AS (SELECT src, sum(weight) AS w FROM both_v GROUP BY src), sh AS MATERIALIZED (SELECT b.src, dst, weight / w AS share FROM both_v b JOIN o USING (src)), nn AS (SELECT count(*) AS n FROM nodes_v)", "k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes_v, nn)"]
    for k in range(1, rounds + 1):
        out.append(f"k{k} AS MATERIALIZED (SELECT dst AS id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(share * rank) AS rank FROM sh JOIN k{k - 1} ON sh.src = k{k - 1}.id, nn GROUP BY dst)")
    return ", ".join(out)


@query("g7_pagerank", f"WITH {V.GRAPH}, {_rank_sql()} SELECT id, round(rank / (SELECT sum(rank) FROM k20), 6) AS pagerank FROM k20")
def g7(t) -> DataFrame:
    return _rounded(G.pagerank(_graph(t), 20, tolerance=None), "pagerank")


@query("g8_components", f"WITH RECURSIVE {V.GRAPH}, {COMP} SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INT) AS component FROM comp")
def g8(t) -> DataFrame:
    return G.components(_graph(t))


def _community_sql(rounds: int = 10) -> str:
    out = ["own AS (SELECT src AS id, max(weight) AS self FROM both_v GROUP BY src)", "c0 AS MATERIALIZED (SELECT id, id AS label FROM nodes_v)"]
    for k in range(1, rounds + 1):
        p = f"c{k - 1}"
        out.append(f"c{k} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, label) AS n FROM (SELECT b.src AS id, label, weight AS w FROM both_v b JOIN {p} ON b.dst = {p}.id UNION ALL SELECT id, label, self FROM {p} JOIN own USING (id)) GROUP BY id, label) WHERE n = 1)")
    return ", ".join(out)


COMMUNITY = f"{V.GRAPH}, {_community_sql()}, cm AS (SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INT) AS community FROM (SELECT id, min(id) OVER (PARTITION BY label) AS low FROM c10))"


@query("g9_communities", f"WITH {COMMUNITY} SELECT id, community FROM cm")
def g9(t) -> DataFrame:
    return G.communities(_graph(t))


@query("g10_community_sizes", f"WITH {COMMUNITY} SELECT community, count(*) AS members FROM cm GROUP BY community")
def g10(t) -> DataFrame:
    return G.community_sizes(G.communities(_graph(t)))


JACCARD = f"""WITH {V.GRAPH}, d AS (SELECT src AS n, count(*) AS deg FROM both_v GROUP BY src), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common, bool_or(h.deg <= {{}}) AS ok FROM both_v x JOIN both_v y ON x.dst = y.dst AND x.src < y.src JOIN d h ON h.n = x.dst GROUP BY 1, 2)
SELECT a, b, common, round(common / (da.deg + db.deg - common), 6) AS similarity FROM c JOIN d da ON da.n = a JOIN d db ON db.n = b WHERE ok"""


@query("g11_jaccard", JACCARD.format(1 << 40))
def g11(t) -> DataFrame:
    return _rounded(G.jaccard(_graph(t)), "similarity")


@query("g11_jaccard_below_hubs", JACCARD.format(10))
def g11h(t) -> DataFrame:
    """Hubs of more than 10 neighbours propose no pairs, a feature of the operator."""
    return _rounded(G.jaccard(_graph(t), 10), "similarity")


MEASURES = f"""{ALL_PATHS}, {BETWEEN}, {CLOSE}, {_community_sql()}, cm AS (SELECT id, CAST(dense_rank() OVER (ORDER BY low) - 1 AS INT) AS community FROM (SELECT id, min(id) OVER (PARTITION BY label) AS low FROM c10)), {_rank_sql()},
ms AS (SELECT id, round(deg / (n - 1), 6) AS degree, betweenness, closeness, round(rank / (SELECT sum(rank) FROM k20), 6) AS pagerank, community FROM dg JOIN bt USING (id) JOIN cs USING (id) JOIN k20 USING (id) JOIN cm USING (id), n)"""


def _measured(g: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return G.measures(g, rounds=20, tolerance=None, known=known)


@query("g12_combined", _at_any_depth(f"WITH RECURSIVE {MEASURES} SELECT * FROM ms ORDER BY pagerank DESC, betweenness DESC, degree DESC, id LIMIT 50"))
def g12(t) -> DataFrame:
    return G.combined(_measured(_graph(t)), 6)


@query("g13_multi_hop", f"WITH {ALL_PATHS} SELECT s, v AS id, dist AS hops FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY dist, v) AS n FROM p{LEVELS} WHERE dist BETWEEN 1 AND 5) WHERE n <= 100")
def g13(t) -> DataFrame:
    g = _graph(t)
    return G.multi_hop(g, G.degree(g).select("id"), 5)


@query("g14_shortest_path", f"""WITH {V.GRAPH}, ends AS (SELECT min(id) AS a, max(id) AS b FROM nodes_v), q0 AS (SELECT a AS v, [a] AS nodes FROM ends), """ + ", ".join(
    f"q{k} AS MATERIALIZED (SELECT * FROM q{k - 1} UNION ALL SELECT b.dst, list_append(min(q.nodes), b.dst) FROM q{k - 1} q JOIN both_v b ON q.v = b.src WHERE len(q.nodes) = {k} AND b.dst NOT IN (SELECT v FROM q{k - 1}) GROUP BY b.dst)" for k in range(1, LEVELS + 1)
) + f" SELECT CAST(len(nodes) - 1 AS INT) AS hops, nodes FROM q{LEVELS} WHERE v = (SELECT b FROM ends)")
def g14(t) -> DataFrame:
    g = _graph(t)
    ends = G.degree(g).agg(F.min("id"), F.max("id")).first()  # one row
    return G.shortest_path(g, ends[0], ends[1])


TYPED = f"""{PAIR_REL}, te AS (SELECT a AS src, b AS dst, 'CONNECTED_TO' AS type, score, strength FROM rel UNION ALL SELECT DISTINCT person_a, 'R' || case_id, 'INVOLVED_IN', NULL, NULL FROM events_v),
nd AS (SELECT 'C' || c_custkey AS id, 'person' AS node_type, c_name AS label, n_regionkey AS case_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'R' || r_regionkey, 'case', r_name, r_regionkey FROM region)"""


@query("g15_neighbours", f"""WITH {TYPED}, wt AS (SELECT src, dst, type, score, strength FROM te UNION ALL SELECT dst, src, type, score, strength FROM te)
SELECT src AS id, dst AS neighbour, label, node_type, type, score, strength FROM wt JOIN nd ON nd.id = dst WHERE src LIKE 'N%' AND case_id IN (1, 2)""")
def g15(t) -> DataFrame:
    involved = V.events(t).select(F.col("person_a").alias("src"), F.concat(F.lit("R"), F.col("case_id").cast("string")).alias("dst")).distinct()
    none = F.lit(None)
    edges = relationships(t).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CONNECTED_TO").alias("type"), "score", "strength").unionByName(
        involved.select("src", "dst", F.lit("INVOLVED_IN").alias("type"), none.cast("double").alias("score"), none.cast("string").alias("strength"))
    )
    edges = stored(edges, "typed-edges")
    people = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    nodes = people.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("label"), F.col("n_regionkey").alias("case_id")).unionByName(
        t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("case").alias("type"), F.col("r_name").alias("label"), F.col("r_regionkey").alias("case_id"))
    )
    of = t("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    return G.neighbours(edges, nodes, of, t("region").where("r_regionkey IN (1, 2)").select(F.col("r_regionkey").alias("case_id")))


@query("g16_summary", f"""WITH RECURSIVE {MEASURES} SELECT (SELECT count(*) FROM nodes_v) AS nodes, (SELECT count(*) FROM edges_v) AS edges, (SELECT count(DISTINCT low) FROM comp) AS components,
  max(degree) AS top_degree, max(betweenness) AS top_betweenness, max(closeness) AS top_closeness, max(pagerank) AS top_pagerank FROM ms""")
def g16(t) -> DataFrame:
    g = _graph(t)
    known = stored(connected_components(g), "graph-components")
    return G.summary(g, _measured(g, known), known=known)


# ---- reports


@query("t1_timeline", f"WITH {V.EVENTS} SELECT * FROM events_v WHERE case_id = 1 AND event_type = 'CALL' AND date >= '1995-01-01' AND date <= '1997-12-31'")
def t1(t) -> DataFrame:
    return T.sort_timeline(T.timeline(V.events(t), case=1, kind="CALL", first="1995-01-01", last="1997-12-31"), "order_id", "line")


TIMED = f"{V.EVENTS}, tv AS (SELECT *, CASE WHEN order_id % 3 = 0 THEN lpad(CAST(line AS VARCHAR), 2, '0') || ':00' END AS time, CASE WHEN order_id % 7 = 0 THEN NULL ELSE date END AS day FROM events_v)"
@query("t2_temporal_summary", f"""WITH {TIMED}, o AS (SELECT *, day IS NOT NULL OR time IS NOT NULL AS timed, row_number() OVER (PARTITION BY person_a, day IS NOT NULL OR time IS NOT NULL ORDER BY coalesce(day, ''), coalesce(time, ''), order_id, line, person_b, qty) AS n FROM tv)
SELECT person_a, count(*) AS events, count(*) FILTER (timed) AS timed_events, arg_min(order_id, n) FILTER (timed) AS earliest, min(day) FILTER (timed AND n <= 50) AS first_day, arg_max(order_id, n) FILTER (timed) AS latest,
  coalesce(list(order_id ORDER BY n) FILTER (timed AND n <= 50), []) AS sequence FROM o GROUP BY person_a""")
def t2(t) -> DataFrame:
    time = F.when(F.col("order_id") % 3 == 0, F.concat(F.lpad(F.col("line").cast("string"), 2, "0"), F.lit(":00")))
    e = V.events(t).withColumn("time", time).withColumn("date", F.when(F.col("order_id") % 7 == 0, None).otherwise(F.col("date")))
    found = T.temporal_summary(e, "person_a", ["order_id", "line", "person_b", "qty"])
    first_day = F.array_min(F.transform("sequence", lambda x: x["date"]))
    return found.select("person_a", "events", "timed_events", F.col("earliest.order_id").alias("earliest"), first_day.alias("first_day"), F.col("latest.order_id").alias("latest"), F.transform("sequence", lambda x: x["order_id"]).alias("sequence"))


@query("t3_search", "SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS value FROM part WHERE contains(lower(p_name), 'al') UNION ALL SELECT 'person', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE contains(lower(c_name), 'al') UNION ALL SELECT 'case', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'al')")
def t3(t) -> DataFrame:
    return T.search("AL", part=(t("part"), "p_partkey", "p_name"), person=(t("customer"), "c_custkey", "c_name"), case=(t("nation"), "n_nationkey", "n_name"))


def _streamed(name: str, sql: str | None):
    """Registers a query that needs the session itself: streams, and what is written and read again."""

    def wrap(f):
        QUERIES[name] = f
        if sql:
            from evgraph.plans.registry import SQL

            SQL[name] = sql
        return f

    return wrap


@_streamed("t3_search_index", "SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS value FROM part WHERE contains(lower(p_name), 'r#0000') UNION ALL SELECT 'person', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE contains(lower(c_name), 'r#0000') UNION ALL SELECT 'case', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'r#0000')")
def t3i(spark, sf_dir: str) -> DataFrame:
    t = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    path = shared_dir(spark, "search-index")
    T.write_search_index(path, part=(t("part"), "p_partkey", "p_name"), person=(t("customer"), "c_custkey", "c_name"), case=(t("nation"), "n_nationkey", "n_name"))
    return T.search_index(spark, path, "R#0000")


@query("t4_profile", f"""WITH {PAIR_REL}, {V.LINKS}, s AS (SELECT person_a AS person, event_type, case_id FROM events_v UNION ALL SELECT person_b, event_type, case_id FROM events_v),
e AS (SELECT person, count(DISTINCT case_id) AS n_cases, count(*) AS events, count(*) FILTER (event_type = 'CALL') AS calls, count(*) FILTER (event_type = 'TRANSACTION') AS transactions FROM s GROUP BY person),
i AS (SELECT person, count(*) AS n_identifiers FROM links_v GROUP BY person), k AS (SELECT person, count(*) AS n_relationships, max(score) AS best FROM (SELECT a AS person, score FROM rel UNION ALL SELECT b, score FROM rel) GROUP BY person)
SELECT * FROM e LEFT JOIN i USING (person) LEFT JOIN k USING (person)""")
def t4(t) -> DataFrame:
    e = events_once(t)
    return T.profile(e, V.links(t), E.scored(E.event_signals(e)))


@query("t4_profile_details", f"""WITH {PAIR_REL}, {EV[len(V.EVENTS) + 2 :]}, {V.LINKS}, s AS (SELECT person_a AS person, person_b AS other, event_type, case_id, date FROM events_v UNION ALL SELECT person_b, person_a, event_type, case_id, date FROM events_v)
SELECT person, 'identifier' AS section, kind, value, NULL AS other, NULL AS date, NULL::DOUBLE AS score FROM links_v UNION ALL SELECT DISTINCT person, 'case', NULL, CAST(case_id AS VARCHAR), NULL, NULL, NULL FROM s
UNION ALL SELECT person, 'event', event_type, NULL, other, date, NULL FROM s UNION ALL SELECT a, 'relationship', NULL, strength, b, NULL, score FROM rel UNION ALL SELECT b, 'relationship', NULL, strength, a, NULL, score FROM rel
UNION ALL SELECT a, 'evidence', kind, evidence_id, b, date, confidence FROM ev UNION ALL SELECT b, 'evidence', kind, evidence_id, a, date, confidence FROM ev""")
def t4d(t) -> DataFrame:
    e = events_once(t)
    return T.profile_details(e, V.links(t), E.scored(E.event_signals(e)), evidence(t, e))


@query("t5_case_context", f"""WITH {PAIR_REL}, {EV[len(V.EVENTS) + 2 :]} SELECT case_id, (SELECT count(DISTINCT p) FROM (SELECT person_a AS p FROM events_v x WHERE x.case_id = z.case_id UNION ALL SELECT person_b FROM events_v x WHERE x.case_id = z.case_id)) AS people,
  count(*) AS events, count(*) AS evidence, (SELECT count(DISTINCT (a, b)) FROM ev SEMI JOIN rel USING (a, b) WHERE ev.case_id = z.case_id) AS relationships, count(DISTINCT source) AS sources, count(DISTINCT date) AS days FROM events_v z GROUP BY case_id""")
def t5(t) -> DataFrame:
    e = events_once(t)
    return T.case_context(e, evidence(t, e), E.scored(E.event_signals(e)))


@query("t5_case_lists", f"WITH {PAIR_REL}, c AS (SELECT DISTINCT case_id, least(person_a, person_b) AS a, greatest(person_a, person_b) AS b FROM events_v) SELECT case_id, a, b, score, CAST(n AS INT) AS n FROM (SELECT case_id, a, b, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC NULLS LAST, a, b) AS n FROM c JOIN rel USING (a, b)) WHERE n <= 75")
def t5l(t) -> DataFrame:
    e = events_once(t)
    met = evidence(t, e).select("case_id", "a", "b").distinct().hint("merge").join(E.scored(E.event_signals(e)).select("a", "b", "score").hint("merge"), ["a", "b"])
    return T.first_rows(met, "case_id", 75, F.desc_nulls_last("score"), "a", "b").select("case_id", "a", "b", "score", "n")


@query("t6_strongest", f"WITH {PAIR_REL} SELECT a, b, score, tenths FROM rel ORDER BY score DESC, tenths DESC, a, b LIMIT 25")
def t6(t) -> DataFrame:
    return T.top_k(relationships(t), 25, F.desc("score"), F.desc("tenths"), "a", "b").select("a", "b", "score", "tenths")


@query("t7_most_connected", f"WITH {PAIR_REL} SELECT person, count(*) AS links FROM (SELECT a AS person FROM rel UNION ALL SELECT b FROM rel) GROUP BY person ORDER BY links DESC, person LIMIT 1")
def t7(t) -> DataFrame:
    return T.most_connected(relationships(t))


@query("t8_cross_case", f"WITH {PAIR_REL}, c AS (SELECT DISTINCT case_id, least(person_a, person_b) AS a, greatest(person_a, person_b) AS b FROM events_v) SELECT case_id, count(*) FILTER (strength = 'STRONG') AS strong, count(*) FILTER (strength = 'MODERATE') AS moderate, count(*) FILTER (strength = 'WEAK') AS weak FROM rel JOIN c USING (a, b) GROUP BY case_id")
def t8(t) -> DataFrame:
    e = events_once(t)
    return T.cross_case(E.scored(E.event_signals(e)), evidence(t, e))


ENTITIES = "en AS (SELECT l_partkey * 100 + l_linenumber AS id, 'PRODUCT' AS type, p_name AS normalized, min(o_custkey % 7) AS case_id, min(l_orderkey) AS document_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"
DETAIL = f"""{ENTITIES}, lk AS (SELECT l_partkey * 100 + l_linenumber AS id, count(DISTINCT o_custkey) AS people FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 GROUP BY 1),
dt AS (SELECT en.*, r_name AS case_name, o_orderpriority AS document_name, coalesce(people, 0) AS people FROM en LEFT JOIN region ON r_regionkey = case_id LEFT JOIN orders ON o_orderkey = document_id LEFT JOIN lk USING (id))"""


def _entities(t) -> tuple[DataFrame, DataFrame]:
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").hint("merge").join(t("orders").select("o_orderkey", "o_custkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.hint("merge").join(t("part").select("p_partkey", "p_name").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).withColumn("id", F.col("l_partkey") * 100 + F.col("l_linenumber"))
    found = lines.groupBy("id", F.lit("PRODUCT").alias("type"), F.col("p_name").alias("normalized")).agg(F.min(F.col("o_custkey") % 7).alias("case_id"), F.min("l_orderkey").alias("document_id"))
    return found, lines.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("person"), F.col("id").alias("entity_id"))


@query("t9_entity_detail", f"WITH {DETAIL} SELECT * FROM dt")
def t9(t) -> DataFrame:
    found, links = _entities(t)
    cases = t("region").select(F.col("r_regionkey").alias("case_id"), F.col("r_name").alias("name"))
    return T.entity_detail(found, cases, t("orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("name")), links)


@query("t9_entity_lookup", f"WITH {ENTITIES} SELECT * FROM en WHERE normalized = (SELECT min(p_name) FROM part) ORDER BY id LIMIT 1")
def t9l(t) -> DataFrame:
    name = t("part").agg(F.min("p_name")).first()[0]  # one row
    return T.find_entity(_entities(t)[0], "PRODUCT", f"  {name} ")


@query("t10_case_scope", f"WITH {V.EVENTS} SELECT person_a, person_b, case_id, order_id, line FROM events_v WHERE case_id IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (1, 5, 9))")
def t10(t) -> DataFrame:
    assigned = t("nation").where("n_nationkey IN (1, 5, 9)").select(F.col("n_regionkey").alias("case_id"))
    return T.in_scope(V.events(t), assigned).select("person_a", "person_b", "case_id", "order_id", "line")


@query("t11_latest_login", "SELECT user_id, max(ts) FILTER (event_type = 'signup') AS last_login, max(ts) AS last_activity FROM events GROUP BY user_id")
def t11(t) -> DataFrame:
    return T.latest_activity(t("events"), action="event_type", login="signup")


@query("t12_recent_cases", """WITH l AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS item, ts, event_id, row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, item, CAST(n AS INT) AS n FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM l WHERE k = 1) WHERE n <= 5""")
def t12(t) -> DataFrame:
    log = t("events").withColumn("item", F.get_json_object("props", "$.k").cast("long") % 20)
    return T.recent_distinct(log, "user_id", "item")


@query("t13_status_counts", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def t13(t) -> DataFrame:
    return T.status_counts(t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), "status", "priority")


@query("t13_table_counts", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS n FROM {x}" for x in ("customer", "orders", "lineitem", "documents", "events")))
def t13c(t) -> DataFrame:
    return T.table_counts(**{x: t(x) for x in ("customer", "orders", "lineitem", "documents", "events")})


@query("t14_audit_tail", "SELECT event_id, ts, coalesce(c_name, 'system') AS who, event_type AS action FROM events LEFT JOIN customer ON user_id = c_custkey AND user_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 500")
def t14(t) -> DataFrame:
    users = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return T.audit_tail(t("events").withColumnRenamed("event_type", "action"), users)


@query("t15_investigator_overview", """WITH l AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS item FROM events), a AS (SELECT user_id, item AS case_id FROM l WHERE event_type <> 'error'),
k AS (SELECT user_id, item, max((ts, event_id)) AS moment FROM l GROUP BY ALL), rc AS (SELECT user_id, list(item ORDER BY n) AS recent FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC) AS n FROM k) WHERE n <= 5 GROUP BY user_id),
c AS (SELECT user_id, count(DISTINCT case_id) AS cases FROM a GROUP BY user_id)
SELECT user_id, coalesce(cases, 0) AS cases, last_login, last_activity, last_action, coalesce(recent, []) AS recent FROM
  (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS last_login, max(ts) AS last_activity, arg_max(event_type, (ts, event_id)) AS last_action FROM l GROUP BY user_id) LEFT JOIN c USING (user_id) LEFT JOIN rc USING (user_id)""")
def t15(t) -> DataFrame:
    log = t("events").select("user_id", F.col("event_type").alias("action"), (F.get_json_object("props", "$.k").cast("long") % 20).alias("item"), "ts", "event_id")
    return T.overview(log, log.where("action <> 'error'").select("user_id", F.col("item").alias("case_id")), login="signup")


@query("t16_nested_documents", "SELECT c_custkey AS id, c_name, o_orderkey AS document, o_orderstatus AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def t16(t) -> DataFrame:
    docs = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("status"))
    cases = T.nested(t("customer").select(F.col("c_custkey").alias("id"), "c_name"), docs, "id", ["document", "status"])
    return cases.select("id", "c_name", F.explode_outer("children").alias("d")).select("id", "c_name", "d.document", "d.status")


# ---- streams


def _stream(spark, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(as_pattern(path))


@_streamed("w1_incremental_ingest", "SELECT o_orderkey AS document, o_orderpriority AS priority, o_orderstatus AS case_id FROM orders")
def w1(spark, sf_dir: str) -> DataFrame:
    path, work = f"{sf_dir}/orders.parquet", shared_dir(spark, "ingest")
    build = lambda df: df.select(F.col("o_orderkey").alias("document"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("case_id"))
    orders = spark.read.parquet(path)
    orders.select("o_orderkey", "o_orderpriority", "o_orderstatus").repartition(3, "o_orderkey").write.parquet(f"{work}/files")  # every file touches every case
    W.ingest(spark, f"{work}/files", spark.read.parquet(f"{work}/files").schema, work, build, files_per_batch=1, case=F.col("o_orderstatus")).awaitTermination()
    return spark.read.schema("document long, priority string, case_id string").parquet(f"{work}/table")


@_streamed("w2_streaming_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def w2(spark, sf_dir: str) -> DataFrame:
    log = _stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = W.dedup_content(log, "ts", "36500 days", "user_id", "event_type")
    return W.run_to_table(rows.select("user_id", "event_type"), "stream-dedup")


@query("w3_failure_windows", """WITH f AS (SELECT event_id, user_id, epoch_us(ts) AS tick, event_type = 'signup' AS ok, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since
  FROM events WHERE event_type IN ('error', 'signup')), n AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, since ORDER BY tick RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS failures FROM f)
SELECT event_id, user_id, failures FROM n WHERE NOT ok AND failures >= 2""")
def w3(t) -> DataFrame:
    log = t("events").where("event_type IN ('error', 'signup')").withColumn("ok", F.col("event_type") == "signup")
    return W.failure_windows(log, seconds=86400, least=2, success="ok").select("event_id", "user_id", "failures")


def _in_order(spark, rows: DataFrame, time: str, name: str, parts: int = 3) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A stream, and what to call for its parts to arrive, in order of time: each adds as many files as its rows were read by tasks."""
    path, at = shared_dir(spark, name), F.unix_micros(F.col(time).cast("timestamp"))
    rows = stored(rows.withColumn("__at", at), name)
    low, high = rows.agg(F.min("__at"), F.max("__at")).first()
    part = F.least(F.lit(parts - 1), F.floor((F.col("__at") - F.lit(low)) * parts / F.lit(max(1, (high or 0) - (low or 0))))).cast("int")
    rows = rows.withColumn("__part", part).drop("__at")
    add = lambda k: rows.where(F.col("__part") == k).drop("__part").write.mode("append").parquet(path)
    rows.drop("__part").limit(0).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return stream, [lambda k=k: add(k) for k in range(parts)]


ATTEMPTS = "tried AS (SELECT event_id, ts, event_type = 'signup' AS ok, unnest(['user:' || user_id, 'address:' || json_extract_string(props, '$.k')]) AS key FROM events WHERE event_type IN ('error', 'signup'))"


@_streamed("w3_failure_stream", f"""WITH {ATTEMPTS}, s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM tried WHERE key IS NOT NULL),
n AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY key, since ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS failures FROM s) SELECT key, event_id, failures FROM n WHERE NOT ok AND failures >= 2""")
def w3s(spark, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('error', 'signup')")
    log = log.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").alias("k"), (F.col("event_type") == "signup").alias("ok"))
    stream, arrivals = _in_order(spark, log, "ts", "attempts")
    keys = W.attempt_keys(stream, user="user_id", address="k")
    return W.run_to_table(W.limited_attempts(keys, 86400, 2).select("key", "event_id", "failures"), "limited", arrivals=arrivals)


@_streamed("w4_rolling_activity", "SELECT user_id, event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2, 3")
def w4(spark, sf_dir: str) -> DataFrame:
    # complete mode: every window is there without waiting for the watermark to pass it
    stream = W.rolling_activity(_stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"])
    work = shared_dir(spark, "rolling")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


@query("w4_rolling_pairs", f"""WITH {V.EVENTS} SELECT least(person_a, person_b) AS a, greatest(person_a, person_b) AS b, date_trunc('day', CAST(date AS TIMESTAMP)) AS start, count(*) FILTER (event_type = 'CALL') AS calls, count(*) FILTER (event_type = 'TRANSACTION') AS transactions,
  count(*) FILTER (event_type = 'LOCATION_OBSERVATION') AS locations FROM events_v GROUP BY 1, 2, 3""")
def w4p(t) -> DataFrame:
    return W.rolling_pairs(V.events(t).withColumn("ts", F.col("date").cast("timestamp")))


@query("w5_sync_state", """WITH c AS (SELECT user_id, max(ts) FILTER (event_type <> 'view') AS changed, max(ts) FILTER (event_type = 'view') AS projected, arg_max(event_id % 4, ts) FILTER (event_type = 'view') AS k FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN projected IS NULL OR projected < changed THEN 'PENDING' WHEN k = 1 THEN 'SYNCING' WHEN k <> 0 THEN 'SYNCED' ELSE 'FAILED' END AS state FROM c WHERE changed IS NOT NULL""")
def w5(t) -> DataFrame:
    e = t("events")
    k = F.col("event_id") % 4
    return W.sync_state(e.where("event_type <> 'view'"), e.where("event_type = 'view'").withColumn("ok", F.when(k != 1, k != 0)), "user_id")


@_streamed("w4_pair_view", f"""WITH {V.EVENTS} SELECT least(person_a, person_b) AS a, greatest(person_a, person_b) AS b, count(*) FILTER (event_type = 'CALL') AS calls, count(*) FILTER (event_type = 'TRANSACTION') AS transactions,
  count(*) FILTER (event_type = 'LOCATION_OBSERVATION') AS locations FROM events_v WHERE person_a <> person_b GROUP BY 1, 2""")
def w4v(spark, sf_dir: str) -> DataFrame:
    events = V.events(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    events = events.select("person_a", "person_b", "event_type", F.col("date").cast("timestamp").alias("ts"))
    work = shared_dir(spark, "pair-view")
    stream, arrivals = _in_order(spark, events, "ts", "pair-events")
    for arrive in arrivals:
        arrive()
        W.maintain_pairs(stream, work).awaitTermination()
    return W.pair_totals(spark, work)


@_streamed("w5_sync_stream", SQL["w5_sync_state"])
def w5s(spark, sf_dir: str) -> DataFrame:
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 4
    e = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("view"), F.when(k != 1, k != 0).alias("ok"))
    (changes, one), (projections, other) = (_in_order(spark, e.where(F.col("view") == seen).drop("view"), "ts", "sync-events") for seen in (False, True))
    steps = W.run_to_table(W.sync_transitions(changes.drop("ok"), projections, "user_id"), "sync-steps", arrivals=[lambda a=a, b=b: (a(), b()) for a, b in zip(one, other)])
    return steps.groupBy("user_id").agg(F.max_by("after", "n").alias("state")).where("state IS NOT NULL")
