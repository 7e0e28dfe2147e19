"""Derived inputs: the evidence-graph shapes, built from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]
DAY = "yyyy-MM-dd"

#: Two-party events: who (customer), with whom (supplier's nation), what, when, from which source, in which case.
EVENTS = """events_v AS (
  SELECT 'C' || o_custkey AS person_a, 'N' || s_nationkey AS person_b,
    CASE l_returnflag WHEN 'A' THEN 'CALL' WHEN 'R' THEN 'TRANSACTION' ELSE 'LOCATION_OBSERVATION' END AS event_type,
    strftime(l_shipdate, '%Y-%m-%d') AS date, o_orderpriority AS source, n_regionkey AS case_id, o_orderkey AS order_id, l_linenumber AS line,
    CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def events(t: Tables) -> DataFrame:
    o, c, n = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), t("customer").select("c_custkey", "c_nationkey"), t("nation").select("n_nationkey", "n_regionkey")
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_linenumber", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    kind = F.when(F.col("l_returnflag") == "A", "CALL").when(F.col("l_returnflag") == "R", "TRANSACTION").otherwise("LOCATION_OBSERVATION")
    return j.select(
        F.concat(F.lit("C"), "o_custkey").alias("person_a"), F.concat(F.lit("N"), "s_nationkey").alias("person_b"), kind.alias("event_type"),
        F.date_format("l_shipdate", DAY).alias("date"), F.col("o_orderpriority").alias("source"), F.col("n_regionkey").alias("case_id"),
        F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("qty"),
    )


#: Report texts, one per order.
TEXTS = """texts_v AS (
  SELECT o_orderkey AS id, 'Paid Rs ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' on ' || strftime(o_orderdate, '%d-%b-%Y') || ' at '
    || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ' A/C ' || lpad(CAST(o_custkey AS VARCHAR), 8, '0')
    || ' phone 9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' vehicle TS09AB' || CAST(o_orderkey % 10000 AS VARCHAR) AS text
  FROM orders)"""


def texts(t: Tables) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    key = F.col("o_orderkey")
    return t("orders").select(
        key.alias("id"),
        F.concat(
            F.lit("Paid Rs "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "dd-MMM-yyyy"),
            F.lit(" at "), two(key % 24), F.lit(":"), two(key % 60), F.lit(" A/C "), F.lpad(F.col("o_custkey").cast("string"), 8, "0"),
            F.lit(" phone 9"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" vehicle TS09AB"), (key % 10000).cast("string"),
        ).alias("text"),
    )


#: Identifiers of persons: what a customer bought where (account), and where it sits (location).
LINKS = """links_v AS (
  SELECT DISTINCT 'C' || o_custkey AS person, 'account' AS kind, l_partkey || '-' || l_suppkey AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'case', strftime(o_orderdate, '%Y-%m-%d') || o_orderpriority FROM orders
  UNION ALL SELECT 'C' || c_custkey, 'location', c_nationkey || '-' || c_mktsegment FROM customer)"""


def links(t: Tables, once: bool = True) -> DataFrame:
    """once: each link once; else as often as it is found, for what frees its own rows of repeated ones."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    person = F.concat(F.lit("C"), "o_custkey").alias("person")
    bought = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.select(person, F.lit("account").alias("kind"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("value"))
    case = o.select(person, F.lit("case").alias("kind"), F.concat(F.date_format("o_orderdate", DAY), "o_orderpriority").alias("value"))
    place = t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("person"), F.lit("location").alias("kind"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    if once:
        bought, case = bought.distinct(), case.distinct()
    return bought.unionByName(case).unionByName(place)


#: Mentions: part names with their brand as identifier.
NAMES = "names_v AS (SELECT p_partkey AS id, p_name AS name, p_brand AS account, p_partkey % 7 AS file FROM part)"


def names(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("account"), (F.col("p_partkey") % 7).alias("file"))


#: Supplier graph: suppliers that share orders among returned lines; kept from the mean plus one deviation on.
GRAPH = """lines_v AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
weighted_v AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS weight FROM lines_v a JOIN lines_v b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL),
edges_v AS (SELECT src, dst, weight FROM weighted_v WHERE weight > (SELECT avg(weight) + stddev_pop(weight) FROM weighted_v)),
both_v AS (SELECT src, dst, weight FROM edges_v UNION ALL SELECT dst, src, weight FROM edges_v),
nodes_v AS (SELECT DISTINCT src AS id FROM both_v)"""


def graph(t: Tables) -> DataFrame:
    lines = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct()
    a, b = lines.select("l_orderkey", F.col("l_suppkey").alias("src")), lines.select("l_orderkey", F.col("l_suppkey").alias("dst"))
    pairs = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    bound = pairs.agg((F.avg("weight") + F.stddev_pop("weight")).alias("bound"))
    return pairs.join(F.broadcast(bound), F.col("weight") > F.col("bound")).select("src", "dst", "weight")  # one row


#: Files: documents with their content hash; the case is the source.
FILES = "files_v AS (SELECT doc_id, source AS case_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha FROM documents)"


def files(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", F.col("source").alias("case_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
