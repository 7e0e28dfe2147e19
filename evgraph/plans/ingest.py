"""Registered queries for functions, sources, import quality and extraction (C, S, Q, X), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions import scalars as C
from evgraph.operators import extract as X
from evgraph.operators import quality as Q
from evgraph.plans import views as V
from evgraph.plans.registry import query
from evgraph.sources import files as S

PHONE = "CASE o_orderkey % 3 WHEN 0 THEN '+91-' WHEN 1 THEN '0' ELSE '' END || '98765' || CASE o_orderkey % 2 WHEN 0 THEN '-' ELSE ' ' END || lpad(CAST(o_custkey AS VARCHAR), 5, '0')"
DIGITS = "regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^0', '')"


@query("c1_norm_phone", f"""WITH r AS (SELECT o_orderkey AS id, {PHONE} AS raw FROM orders), d AS (SELECT id, raw, {DIGITS} AS x FROM r)
SELECT id, raw, CASE WHEN length(x) = 12 AND starts_with(x, '91') THEN substr(x, 3) ELSE x END AS phone FROM d""")
def c1(t) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 3 == 0, "+91-").when(k % 3 == 1, "0").otherwise(""), F.lit("98765"), F.when(k % 2 == 0, "-").otherwise(" "), F.lpad(F.col("o_custkey").cast("string"), 5, "0"))
    return t("orders").select(k.alias("id"), raw.alias("raw")).withColumn("phone", C.norm_phone("raw"))


@query("c2_norm_name", r"""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower('  ' || p_name || '. ' || p_brand), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part""")
def c2(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), C.norm_name(F.concat(F.lit("  "), "p_name", F.lit(". "), "p_brand")).alias("name"))


@query("c3_c4_norm_vehicle_account", r"""SELECT o_orderkey AS id, upper(regexp_replace('ts 09-ab ' || (o_orderkey % 10000), '[\s.\-]', '', 'g')) AS vehicle,
  upper(regexp_replace('a/c ' || o_custkey || '-x', '[^a-zA-Z0-9]', '', 'g')) AS account FROM orders""")
def c34(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(
        k.alias("id"), C.norm_vehicle(F.concat(F.lit("ts 09-ab "), (k % 10000).cast("string"))).alias("vehicle"), C.norm_account(F.concat(F.lit("a/c "), F.col("o_custkey").cast("string"), F.lit("-x"))).alias("account")
    )


@query("c5_norm_location", r"""WITH w AS (SELECT c_custkey AS id, unnest(string_split(trim(regexp_replace('  ' || lower(c_mktsegment) || '   ' || c_name, '\s+', ' ', 'g')), ' ')) AS word,
  generate_subscripts(string_split(trim(regexp_replace('  ' || lower(c_mktsegment) || '   ' || c_name, '\s+', ' ', 'g')), ' '), 1) AS n FROM customer),
p AS (SELECT id, n, unnest(string_split(word, '#')) AS piece, generate_subscripts(string_split(word, '#'), 1) AS m FROM w),
u AS (SELECT id, n, string_agg(upper(substr(piece, 1, 1)) || lower(substr(piece, 2)), '#' ORDER BY m) AS word FROM p GROUP BY id, n)
SELECT id, string_agg(word, ' ' ORDER BY n) AS location FROM u GROUP BY id""")
def c5(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), C.norm_location(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("   "), "c_name")).alias("location"))


SHAPES = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT10:15:00') ELSE 'no date ' || o_orderkey END"


def _shaped(k, date):
    p = lambda f: F.date_format(date, f)
    return F.when(k % 6 == 0, p("yyyy-MM-dd")).when(k % 6 == 1, p("dd/MM/yyyy")).when(k % 6 == 2, p("dd-MMM-yyyy")).when(k % 6 == 3, p("dd-MM-yy")).when(k % 6 == 4, F.concat(p("yyyy-MM-dd"), F.lit("T10:15:00"))).otherwise(F.concat(F.lit("no date "), k.cast("string")))


@query("c6_norm_date", f"SELECT o_orderkey AS id, {SHAPES} AS raw, CASE WHEN o_orderkey % 6 = 5 THEN 'no' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def c6(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("id"), _shaped(F.col("o_orderkey"), F.col("o_orderdate")).alias("raw")).withColumn("date", C.norm_date("raw"))


@query("c7_norm_time", """WITH r AS (SELECT event_id AS id, extract(hour FROM ts) AS h, extract(minute FROM ts) AS m, event_id % 3 AS k FROM events)
SELECT id, CASE WHEN k = 2 THEN 'late' ELSE lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END AS time FROM r""")
def c7(t) -> DataFrame:
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.date_format("ts", "h:mm a")).when(k == 1, F.date_format("ts", "dd-MMM-yyyy H:mm:ss")).otherwise("very late")
    return t("events").select(F.col("event_id").alias("id"), C.norm_time(raw).alias("time"))


@query("c8_norm_value", r"""WITH r AS (SELECT o_orderkey AS id, (['PHONE', 'PERSON', 'VEHICLE', 'BANK_ACCOUNT', 'DATE', 'OTHER'])[CAST(o_orderkey % 6 AS INT) + 1] AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN '098-7' || o_custkey WHEN 1 THEN ' Cust#' || o_custkey WHEN 2 THEN 'ts-09 ' || o_custkey WHEN 3 THEN 'a/' || o_custkey WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '  x ' END AS raw,
  strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)
SELECT id, kind, CASE kind WHEN 'PHONE' THEN regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^0', '') WHEN 'PERSON' THEN trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))
  WHEN 'VEHICLE' THEN upper(regexp_replace(raw, '[\s.\-]', '', 'g')) WHEN 'BANK_ACCOUNT' THEN upper(regexp_replace(raw, '[^a-zA-Z0-9]', '', 'g')) WHEN 'DATE' THEN iso ELSE trim(raw) END AS value FROM r""")
def c8(t) -> DataFrame:
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("PHONE", "PERSON", "VEHICLE", "BANK_ACCOUNT", "DATE", "OTHER"))), (k + 1).cast("int"))
    raw = F.when(k == 0, F.concat(F.lit("098-7"), c)).when(k == 1, F.concat(F.lit(" Cust#"), c)).when(k == 2, F.concat(F.lit("ts-09 "), c)).when(k == 3, F.concat(F.lit("a/"), c)).when(k == 4, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("  x ")
    rows = t("orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), raw.alias("raw"))
    return rows.select("id", "kind", C.norm_value(F.col("kind"), F.col("raw")).alias("value"))


SIM = """CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0
  WHEN split_part(a, ' ', 1) = split_part(b, ' ', 1) AND (strpos(a, ' ') = 0 OR strpos(b, ' ') = 0 OR substr(split_part(a, ' ', 2), 1, 1) = substr(split_part(b, ' ', 2), 1, 1)) THEN 0.9
  WHEN split_part(a, ' ', 1) = split_part(b, ' ', 1) THEN 0.8 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END"""


@query("c9_name_similarity", f"""WITH n AS (SELECT p_partkey AS id, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT id, a, b, CAST({SIM} AS DOUBLE) AS similarity FROM n WHERE b IS NOT NULL""")
def c9(t) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    n = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), nxt.alias("b")).where("b is not null")
    return n.withColumn("similarity", C.name_similarity(F.col("a"), F.col("b")))


@query("c10_c11_pair_key_strength", """SELECT l_orderkey AS o, l_linenumber AS n, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b,
  CASE WHEN l_discount * 10 >= 0.7 THEN 'STRONG' WHEN l_discount * 10 >= 0.45 THEN 'MODERATE' WHEN l_discount * 10 >= 0.2 THEN 'WEAK' ELSE 'INSUFFICIENT EVIDENCE' END AS strength FROM lineitem""")
def c1011(t) -> DataFrame:
    a, b = C.pair_key(F.col("l_partkey"), F.col("l_suppkey"))
    return t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), a.alias("a"), b.alias("b"), C.strength(F.col("l_discount") * 10).alias("strength"))


@query("c12_person_id", r"""SELECT DISTINCT 'P-' || substr(replace(trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '_'), 1, 60) AS person_id FROM customer""")
def c12(t) -> DataFrame:
    return t("customer").select(C.person_id(F.col("c_name")).alias("person_id")).distinct()


@query("c13_relationship_types", f"""WITH {V.EVENTS} SELECT person_a, list_filter([CASE WHEN count(*) FILTER (event_type = 'CALL') > 0 THEN 'calls' END, CASE WHEN count(*) FILTER (event_type = 'TRANSACTION') > 0 THEN 'transactions' END,
  CASE WHEN count(*) FILTER (event_type = 'LOCATION_OBSERVATION') > 0 THEN 'locations' END], lambda x: x IS NOT NULL) AS types FROM events_v GROUP BY person_a""")
def c13(t) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    g = V.events(t).groupBy("person_a").agg(n("CALL").alias("c"), n("TRANSACTION").alias("x"), n("LOCATION_OBSERVATION").alias("l"))
    return g.select("person_a", C.relationship_types(calls=F.col("c"), transactions=F.col("x"), locations=F.col("l")).alias("types"))


@query("c14_json_accessors", """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"user":' || user_id || ',"type":"' || event_type || '"}' AS packed FROM events""")
def c14(t) -> DataFrame:
    packed = C.json_text(F.col("user_id").alias("user"), F.col("event_type").alias("type"))
    return t("events").select(F.col("event_id").alias("id"), C.json_value("props", "$.k").cast("long").alias("k"), packed.alias("packed"))


@query("c15_event_label", f"""WITH {V.EVENTS} SELECT order_id, line, CASE event_type WHEN 'CALL' THEN 'Call ' || person_a || ' → ' || person_b WHEN 'TRANSACTION' THEN 'Transaction ' || person_a || ' → ' || person_b || ' ₹' || qty
  ELSE 'Observed ' || person_a || ' → ' || person_b END AS label FROM events_v""")
def c15(t) -> DataFrame:
    return V.events(t).select("order_id", "line", C.event_label(F.col("event_type"), F.col("person_a"), F.col("person_b"), F.col("qty").cast("string")).alias("label"))


# ---- sources and sinks


@query("s1_content_identity", "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents UNION ALL SELECT -1 - page_id, strlen(coalesce(html, '')), sha256(coalesce(html, '')) FROM pages")
def s1(t) -> DataFrame:
    pages = t("pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return S.content_identity(t("documents").select("doc_id", "text").unionByName(pages), "text").select("doc_id", "size", "sha256")


NAME_OF = "CASE event_id % 5 WHEN 0 THEN 'a.CSV' WHEN 1 THEN 'b.json' WHEN 2 THEN 'c' WHEN 3 THEN 'd.pdf' ELSE 'e.dat' END"


@query("s2_file_type", f"""WITH r AS (SELECT event_id AS id, {NAME_OF} AS name, props FROM events), k AS (SELECT id, props, CASE WHEN regexp_matches(lower(name), '\\.(pdf|csv|json|txt)$') THEN lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN starts_with(ltrim(props), '{{') OR starts_with(ltrim(props), '[') THEN 'json' ELSE 'txt' END AS kind FROM r)
SELECT id, kind, CASE kind WHEN 'pdf' THEN starts_with(ltrim(props), '%PDF') WHEN 'json' THEN starts_with(ltrim(props), '{{') OR starts_with(ltrim(props), '[') ELSE true END AS fits FROM k""")
def s2(t) -> DataFrame:
    k = F.col("event_id") % 5
    name = F.when(k == 0, "a.CSV").when(k == 1, "b.json").when(k == 2, "c").when(k == 3, "d.pdf").otherwise("e.dat")
    rows = t("events").select(F.col("event_id").alias("id"), S.file_type(name, F.col("props")).alias("kind"), "props")
    return rows.select("id", "kind", S.magic_ok(F.col("kind"), F.col("props")).alias("fits"))


@query("s3_csv_scan", """SELECT o_custkey AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS row_number, [CAST(o_orderkey AS VARCHAR), o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END] AS cells FROM orders""")
def s3(t) -> DataFrame:
    o = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))).otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"])
    files = o.groupBy(F.col("o_custkey").alias("file")).agg(F.concat(F.lit("order,status,priority\n"), F.array_join(lines, "\n")).alias("text"))
    return S.csv_rows(files, "file", "text").select("file", "row_number", "cells")


@query("s3_csv_quoted", """SELECT o_custkey AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS row_number,
  [CAST(o_orderkey AS VARCHAR), o_orderstatus || ', ' || o_orderpriority, 'said "' || o_orderkey || '"' || chr(10) || 'on ' || strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 2 = 0 THEN '5" wide' ELSE '' END] AS cells FROM orders""")
def s3q(t) -> DataFrame:
    key, quoted = F.col("o_orderkey").cast("string"), lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    said = quoted(F.lit('said ""'), key, F.lit('""\non '), F.date_format("o_orderdate", "yyyy-MM-dd"))
    wide = F.when(F.col("o_orderkey") % 2 == 0, F.lit('5" wide')).otherwise(F.lit('""'))
    o = t("orders").select("o_custkey", "o_orderkey", F.concat_ws(",", key, quoted("o_orderstatus", F.lit(", "), "o_orderpriority"), said, wide).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"])
    files = o.groupBy(F.col("o_custkey").alias("file")).agg(F.concat(F.lit('order,"status, priority",note,size\r\n'), F.array_join(lines, "\r\n")).alias("text"))
    return S.csv_rows(files, "file", "text").select("file", "row_number", "cells")


@query("s4_json_scan", """SELECT event_id AS id, 0 AS position, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS user_name FROM events UNION ALL SELECT event_id, 1, NULL, event_type FROM events WHERE event_id % 2 = 0""")
def s4(t) -> DataFrame:
    e = t("events")
    one = F.concat(F.lit('{"K":'), F.get_json_object("props", "$.k"), F.lit(',"User Name":'), F.col("user_id").cast("string"), F.lit("}"))
    two = F.concat(F.lit('{"user name":"'), "event_type", F.lit('"}'))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit(",7]"))).otherwise(one)
    rows = S.json_records(e.select(F.col("event_id").alias("id"), text.alias("text")), "id", "text")
    get = lambda k: F.try_element_at("record", F.lit(k))
    return rows.select("id", "position", get("k").alias("k"), get("user_name").alias("user_name"))


@query("s5_text_scan", "SELECT doc_id, length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents")
def s5(t) -> DataFrame:
    return S.text_rows(t("documents"), "doc_id", "text").drop("text")


@query("s6_without_retried", f"WITH {V.EVENTS} SELECT person_a, person_b, order_id, line FROM events_v WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def s6(t) -> DataFrame:
    rows = V.events(t).withColumn("source_document_id", F.col("order_id"))
    retried = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_document_id"))
    return S.without_documents(rows, retried).select("person_a", "person_b", "order_id", "line")


@query("s7_merge_by_key", "SELECT c_custkey AS id, c_mktsegment AS label FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def s7(t) -> DataFrame:
    c = t("customer")
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("label"))
    return S.merge_by_key(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), new.unionByName(new), "id")


# ---- import quality: the headers of one file per customer, picked from a fixed list by its key

CELLS = ("Calling Party", "mobile no", "Receiving-Party", "dialled number", "Date of call", "call time", "Amount", "Txn ID", "person", "Phone Number", "vrn", "Branch", "duration", "remitter", "??")
PICK = "h AS (SELECT c_custkey AS dataset, g AS ordinal, ([" + ", ".join(f"'{x}'" for x in CELLS) + f"])[CAST((c_custkey * 7 + g * (3 + c_custkey % 5)) % {len(CELLS)} AS INT) + 1] AS cell FROM customer, range(5) r(g)), nh AS (SELECT *, trim(regexp_replace(lower(trim(cell)), '[^a-z0-9]+', '_', 'g'), '_') AS col FROM h)"


def _headers(t) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("dataset"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("ordinal"))
    k = (F.col("dataset") * 7 + F.col("ordinal") * (3 + F.col("dataset") % 5)) % len(CELLS)
    return c.withColumn("cell", F.element_at(F.array(*map(F.lit, CELLS)), (k + 1).cast("int")))


ALIAS_SQL = "al(field, field_no, col) AS (VALUES " + ", ".join(f"('{f}', {n}, '{c}')" for f, n, c in Q.alias_rows()) + ")"
NUMBERS = ", ".join(f"'{x}'" for x in Q.NUMBER_CELLS)
CALLISH = ", ".join(f"'{x}'" for x in Q.CALL_FIELDS)
MAPPED = f"""{PICK}, {ALIAS_SQL},
first AS (SELECT dataset, field, ordinal, cell FROM (SELECT dataset, field, ordinal, cell, row_number() OVER (PARTITION BY dataset, field ORDER BY ordinal) AS n FROM nh JOIN al USING (col)) WHERE n = 1),
fl AS (SELECT dataset, bool_or(field = 'caller_phone') AS hc, bool_or(field = 'callee_phone') AS he FROM first GROUP BY dataset HAVING bool_or(field IN ({CALLISH}))),
lo AS (SELECT nh.*, hc, he, row_number() OVER (PARTITION BY dataset ORDER BY regexp_matches(col, '^({"|".join(Q.CALLEE_STARTS)})'), ordinal) AS n FROM nh JOIN fl USING (dataset)
  WHERE col IN ({NUMBERS}) AND NOT EXISTS (SELECT 1 FROM first f WHERE f.dataset = nh.dataset AND f.ordinal = nh.ordinal)),
m AS (SELECT * FROM first UNION ALL SELECT dataset, CASE WHEN NOT hc AND n = 1 THEN 'caller_phone' ELSE 'callee_phone' END, ordinal, cell FROM lo WHERE (NOT hc AND n = 1) OR (NOT he AND n = CASE WHEN hc THEN 1 ELSE 2 END))"""


@query("q1_norm_header", f"WITH {PICK} SELECT dataset, ordinal, col FROM nh")
def q1(t) -> DataFrame:
    return _headers(t).select("dataset", "ordinal", Q.norm_header(F.col("cell")).alias("col"))


@query("q2_map_columns", f"WITH {MAPPED} SELECT * FROM m")
def q2(t) -> DataFrame:
    return Q.map_columns(_headers(t))


@query("q3_check_mapping", f"""WITH {PICK}, {ALIAS_SQL}, u AS (SELECT dataset, CASE ordinal % 2 WHEN 0 THEN 'amount' ELSE 'price' END AS field, CASE WHEN dataset % 4 = 0 THEN 'absent' WHEN dataset % 4 = 1 THEN CAST(dataset % 9 AS VARCHAR) ELSE cell END AS cell FROM h WHERE ordinal <> 1 AND ordinal < 4)
SELECT dataset, field, cell, CASE WHEN error IS NULL THEN CASE WHEN dataset % 4 = 1 THEN CAST(cell AS BIGINT) ELSE (SELECT min(ordinal) FROM nh WHERE nh.dataset = e.dataset AND nh.cell = e.cell) END END AS ordinal, error FROM
  (SELECT *, CASE WHEN field NOT IN (SELECT field FROM al) THEN 'unknown field' WHEN dataset % 4 = 1 THEN CASE WHEN CAST(cell AS BIGINT) > 4 THEN 'index out of range' END WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.dataset = u.dataset AND h.cell = u.cell) THEN 'missing column' END AS error FROM u) e""".replace("CAST(cell AS BIGINT)", "TRY_CAST(cell AS BIGINT)"))
def q3(t) -> DataFrame:
    h = _headers(t)
    k = F.col("dataset") % 4
    cell = F.when(k == 0, "absent").when(k == 1, (F.col("dataset") % 9).cast("string")).otherwise(F.col("cell"))
    user = h.where("ordinal <> 1 AND ordinal < 4").select("dataset", F.when(F.col("ordinal") % 2 == 0, "amount").otherwise("price").alias("field"), cell.alias("cell"))
    return Q.check_mapping(user, h)


@query("q4_record_shape", f"""WITH {MAPPED} SELECT dataset, CASE WHEN bool_or(field IN ({CALLISH}, 'duration')) THEN 'call' WHEN bool_or(field IN ('sender_name','sender_account','receiver_name','receiver_account','amount','transaction_id')) THEN 'transaction'
  ELSE 'person' END AS shape FROM m GROUP BY dataset""")
def q4(t) -> DataFrame:
    return Q.record_shape(Q.map_columns(_headers(t)))


#: A cell of a CSV text and what ends it: an opening quote holds commas and line ends, doubled quotes stay inside; one that is never closed runs to the end.
CSV_CELL = r"""(?s)"(?:[^"]|"")*(?:"[^,\r\n]*(?:,|\r\n|\n|\r)|$)|[^,\r\n]*(?:,|\r\n|\n|\r)"""
BLANKS = "' ' || " + " || ".join(f"chr({x})" for x in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


@query("q5_validate_files", rf"""WITH f AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'txt' ELSE 'exe' END AS kind, coalesce(text, '') AS text FROM documents),
c AS (SELECT id, regexp_extract_all(text || chr(10), '{CSV_CELL}') AS cells FROM f WHERE kind = 'csv'), n AS (SELECT id, generate_subscripts(cells, 1) AS k, unnest(cells) AS cell FROM c),
e AS (SELECT id, k, cell, starts_with(cell, '"') AND NOT regexp_full_match(cell, '(?s)"(?:[^"]|"")*"[^,\r\n]*(?:,|\r\n|\n|\r)') AS open FROM n),
v AS (SELECT id, k, open OR NOT ends_with(cell, ',') AS last, trim(regexp_replace(CASE WHEN open THEN replace(substr(cell, 2), '""', '"') WHEN starts_with(cell, '"') THEN replace(regexp_extract(cell, '(?s)^"((?:[^"]|"")*)"', 1), '""', '"') || regexp_extract(cell, '(?s)^"(?:[^"]|"")*"(.*)$', 1) ELSE cell END, CASE WHEN open THEN '^$' ELSE '(?:,|\r\n|\n|\r)$' END, ''), {BLANKS}) AS cell FROM e),
r AS (SELECT id, k, cell, coalesce(sum(CASE WHEN last THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record FROM v),
q AS (SELECT id, record, list(lower(cell) ORDER BY k) AS cells FROM r GROUP BY id, record HAVING bool_or(cell <> '')), l AS (SELECT id, list(cells ORDER BY record) AS records FROM q GROUP BY id),
w AS (SELECT f.*, coalesce(records, []) AS lines, list_transform(coalesce(records, []), lambda x: len(x)) AS widths, coalesce(records[1], []) AS header FROM f LEFT JOIN l USING (id))
SELECT id, list_filter([CASE WHEN kind = 'exe' THEN 'unsupported' END, CASE WHEN strlen(text) > 20000 THEN 'too large' END, CASE WHEN trim(text) = '' THEN 'empty' END,
  CASE WHEN kind = 'json' AND NOT regexp_matches(ltrim(text), '^[{{\[]') THEN 'type mismatch' END, CASE WHEN contains(text, chr(0)) THEN 'binary' END, CASE WHEN kind = 'csv' AND len(lines) < 2 THEN 'no rows' END], lambda x: x IS NOT NULL) AS errors,
  list_filter([CASE WHEN kind = 'csv' AND len(list_distinct(header)) < len(header) THEN 'duplicate headers' END,
  CASE WHEN kind = 'csv' AND len(lines) > 1 AND len(list_filter(widths, lambda x: x <> widths[1])) * 2 > len(lines) - 1 THEN 'ragged rows' END], lambda x: x IS NOT NULL) AS warnings FROM w""")
def q5(t) -> DataFrame:
    k = F.col("doc_id") % 4
    return Q.validate_files(t("documents").select(F.col("doc_id").alias("id"), F.when(k == 0, "csv").when(k == 1, "json").when(k == 2, "txt").otherwise("exe").alias("kind"), "text"), 20_000)


@query("q6_duplicate_content", f"WITH {V.FILES} SELECT doc_id, case_id, nullif(min(doc_id) OVER (PARTITION BY case_id, sha), doc_id) AS duplicate_of FROM files_v")
def q6(t) -> DataFrame:
    return Q.duplicate_content(V.files(t)).select("doc_id", "case_id", "duplicate_of")


@query("q7_batch_gate", f"""WITH {V.FILES}, d AS (SELECT doc_id % 97 AS batch, CASE WHEN length(text) < 20 THEN 'too short' WHEN min(doc_id) OVER (PARTITION BY sha) <> doc_id THEN 'duplicate' END AS error FROM files_v)
SELECT batch, count(*) AS n_files, count(error) AS n_errors, CASE WHEN count(error) = 0 THEN 200 WHEN count(error) = count(*) FILTER (error = 'duplicate') THEN 409 ELSE 400 END AS status FROM d GROUP BY batch""")
def q7(t) -> DataFrame:
    f = V.files(t).withColumn("all", F.lit(0))
    f = Q.duplicate_content(f, case="all").withColumn("error", F.when(F.char_length("text") < 20, "too short").when(F.col("duplicate_of").isNotNull(), "duplicate"))
    return Q.batch_gate(f.withColumn("batch", F.col("doc_id") % 97))


STATUS = "(['completed', 'failed', 'queued'])[CAST(doc_id % 3 AS INT) + 1]"


def _imports(t) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("completed", "failed", "queued"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = V.files(t).withColumn("size", F.octet_length("text").cast("long")).withColumn("status", status)
    return rows.withColumns({"entities": F.col("doc_id") % 7, "events": F.col("doc_id") % 5, "created_at": F.col("doc_id") % 50})


@query("q8_import_totals", f"""WITH {V.FILES} SELECT case_id, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS total_size, max(doc_id) AS newest, count(*) FILTER ({STATUS} = 'completed') AS n_completed, count(*) FILTER ({STATUS} = 'queued') AS n_active,
  CAST(sum(doc_id % 7) AS BIGINT) AS n_entities, CAST(sum(doc_id % 5) AS BIGINT) AS n_events FROM files_v GROUP BY case_id""")
def q8(t) -> DataFrame:
    return Q.import_totals(_imports(t))


@query("q8_import_history", f"WITH {V.FILES} SELECT case_id, doc_id, {STATUS} AS status, doc_id % 50 AS created_at FROM files_v ORDER BY case_id, created_at DESC, doc_id DESC")
def q8h(t) -> DataFrame:
    return Q.import_history(_imports(t)).select("case_id", "doc_id", "status", "created_at")


@query("q9_discovery_counts", f"WITH {V.EVENTS} SELECT source, count(*) AS n_events, count(DISTINCT (least(person_a, person_b), greatest(person_a, person_b))) AS n_pairs FROM events_v GROUP BY source")
def q9(t) -> DataFrame:
    return Q.discovery_counts(V.events(t), "source", "person_a", "person_b")


@query("q9_growth", f"WITH {V.EVENTS}, b AS (SELECT case_id, count(*) AS n FROM events_v WHERE date < '1996-01-01' GROUP BY case_id), a AS (SELECT case_id, count(*) AS n FROM events_v GROUP BY case_id) SELECT case_id, coalesce(b.n, 0) AS n_before, a.n AS n_after, a.n - coalesce(b.n, 0) AS n_new FROM a LEFT JOIN b USING (case_id)")
def q9g(t) -> DataFrame:
    e = V.events(t).select("case_id", "date")
    return Q.growth(e.where("date < '1996-01-01'"), e, "case_id")


@query("q10_recent_jobs", "SELECT event_id AS id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def q10r(t) -> DataFrame:
    return Q.recent_jobs(t("events").select(F.col("event_id").alias("id"), "user_id", "event_type"))


@query("q10_latest_job", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q10(t) -> DataFrame:
    return Q.latest_per_key(t("events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("q11_preview", "SELECT conv_id, CAST(n AS INT) AS n, substr(text, 1, 300) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def q11(t) -> DataFrame:
    return Q.preview(t("conversations"), "conv_id", "turn", "text")


# ---- extraction


@query("x1_entities", f"""WITH {V.TEXTS}, p(type, pat, g) AS (VALUES ('PHONE', '(?:\\+91[\\s\\-]?)?([6-9]\\d{{4}}[\\s\\-]?\\d{{5}})', 0)), e AS (
  SELECT id, 'PHONE' AS type, regexp_extract_all(text, '(?:\\+91[\\s\\-]?)?([6-9]\\d{{4}}[\\s\\-]?\\d{{5}})', 0) AS v FROM texts_v
  UNION ALL SELECT id, 'VEHICLE', regexp_extract_all(text, '\\b[A-Z]{{2}}\\s?\\d{{2}}\\s?[A-Z]{{1,2}}\\s?\\d{{1,4}}\\b', 0) FROM texts_v
  UNION ALL SELECT id, 'BANK_ACCOUNT', regexp_extract_all(text, '(?i)\\b(?:A/C|ACCOUNT|Acct)[\\s:#]*(\\d{{6,20}})\\b', 1) FROM texts_v
  UNION ALL SELECT id, 'DATE', list_transform(regexp_extract_all(text, '\\b\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}\\b', 0), lambda x: strftime(strptime(x, '%d-%b-%Y'), '%Y-%m-%d')) FROM texts_v
  UNION ALL SELECT id, 'TIME', regexp_extract_all(text, '(?i)\\b\\d{{1,2}}:\\d{{2}}(?:\\s?(?:AM|PM))?\\b', 0) FROM texts_v
  UNION ALL SELECT id, 'TRANSACTION', list_transform(regexp_extract_all(text, '(?i)(?:₹|Rs\\.?|INR)\\s?([\\d,]+(?:\\.\\d+)?)', 1), lambda x: '₹' || replace(x, ',', '')) FROM texts_v)
SELECT id, type, CAST(generate_subscripts(v, 1) - 1 AS INT) AS position, unnest(v) AS value, CAST(0.95 AS DOUBLE) AS confidence, 'regex' AS method FROM e""")
def x1(t) -> DataFrame:
    return X.entities(V.texts(t))


WORDS = """d AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT unnest(['The', 'que', 'der', 'Les', 'of the', 'de la'])), w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM w), gr AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + n], ' ') AS original FROM g, range(1, 4) r(n) WHERE i + n <= len(w)),
hits AS (SELECT doc_id, name, CAST(min(i) AS INT) AS position, arg_min(original, i) AS original FROM gr JOIN d ON lower(original) = lower(name) GROUP BY doc_id, name)"""


def _names(t) -> DataFrame:
    common = t("part").sparkSession.createDataFrame([(x,) for x in ("The", "que", "der", "Les", "of the", "de la")], "name string")
    return t("part").select(F.split("p_name", " ")[0].alias("name")).unionByName(common).distinct()


@query("x2_dictionary", f"WITH {WORDS} SELECT * FROM hits")
def x2(t) -> DataFrame:
    return X.dictionary_matches(t("documents"), _names(t), "doc_id")


@query("x2_longest", f"WITH {WORDS} SELECT doc_id, name, position, original FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY length(original) DESC, name DESC) AS k FROM hits) WHERE k = 1")
def x2l(t) -> DataFrame:
    return X.dictionary_matches(t("documents"), _names(t), "doc_id", longest=True)


@query("x2_substrings", """WITH d AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT unnest(['The', 'que', 'der', 'Les', 'of the', 'de la']))
SELECT doc_id, name, CAST(strpos(lower(text), lower(name)) - 1 AS INT) AS position, substr(text, strpos(lower(text), lower(name)), length(name)) AS original FROM documents JOIN d ON contains(lower(text), lower(name))""")
def x2s(t) -> DataFrame:
    return X.name_substrings(t("documents"), _names(t), "doc_id")


@query("x3_text_events", f"""WITH {V.TEXTS} SELECT id, 'TRANSACTION' AS type, strftime(strptime(regexp_extract(text, '\\d{{2}}-[A-Za-z]{{3}}-\\d{{4}}'), '%d-%b-%Y'), '%Y-%m-%d') AS date, regexp_extract(text, '\\d{{2}}:\\d{{2}}') AS time, 'exact' AS precision,
  '₹' || regexp_extract(text, 'Rs ([\\d.]+)', 1) AS amount FROM texts_v""")
def x3(t) -> DataFrame:
    return X.text_events(V.texts(t))


CALL = {"caller_name": "caller", "callee_name": "callee", "caller_phone": "phone", "callee_phone": "other", "duration": "seconds", "timestamp": "at"}
CALLS = f"""{V.EVENTS}, c AS (SELECT order_id, line, person_a AS a, CASE WHEN line % 3 = 0 THEN NULL ELSE person_b END AS b, '9' || lpad(CAST(order_id AS VARCHAR), 9, '0') AS phone, CASE WHEN line % 3 = 0 THEN '8' || lpad(CAST(line AS VARCHAR), 9, '0') END AS other,
  CAST(qty AS VARCHAR) AS duration, date, CASE WHEN line % 2 = 0 THEN lpad(CAST(order_id % 24 AS VARCHAR), 2, '0') || ':05' END AS time FROM events_v WHERE event_type = 'CALL')"""


def _calls(t) -> DataFrame:
    e = V.events(t).where("event_type = 'CALL'")
    time = F.when(F.col("line") % 2 == 0, F.concat(F.lit(" "), F.lpad((F.col("order_id") % 24).cast("string"), 2, "0"), F.lit(":05"))).otherwise("")
    return e.select(
        "order_id", "line", F.col("person_a").alias("caller"), F.when(F.col("line") % 3 == 0, " ").otherwise(F.col("person_b")).alias("callee"), F.concat(F.lit("9"), F.lpad(F.col("order_id").cast("string"), 9, "0")).alias("phone"),
        F.when(F.col("line") % 3 == 0, F.concat(F.lit("8"), F.lpad(F.col("line").cast("string"), 9, "0"))).alias("other"), F.col("qty").alias("seconds"), F.concat("date", time).alias("at"),
    )


def _flat(events: DataFrame, *details: str) -> DataFrame:
    return events.select(*[c for c in events.columns if c != "details"], *[F.col(f"details.{d}").alias(d) for d in details])


PRECISION = "CASE WHEN time IS NOT NULL THEN 'exact' WHEN date IS NOT NULL THEN 'date_only' ELSE 'unknown' END AS precision"


@query("x4_call_rows", f"""WITH {CALLS} SELECT order_id, CAST(line AS BIGINT) AS position, 'CALL' AS type, a AS a_name, b AS b_name, date, time, {PRECISION}, 'Call ' || a || ' → ' || coalesce(b, other) AS description,
  phone AS caller_phone, other AS callee_phone, duration FROM c""")
def x4(t) -> DataFrame:
    return _flat(X.call_rows(_calls(t), "order_id", CALL, "line").events, "caller_phone", "callee_phone", "duration")


@query("x4_call_entities", f"WITH {CALLS} SELECT order_id, CAST(line AS BIGINT) AS position, 'PHONE' AS type, value, 1.0::DOUBLE AS confidence, 'csv' AS method, date, time FROM (SELECT *, phone AS value FROM c UNION ALL SELECT *, other FROM c) WHERE value IS NOT NULL")
def x4e(t) -> DataFrame:
    return X.call_rows(_calls(t), "order_id", CALL, "line").entities


NO_IDS = "NULL::VARCHAR AS account, NULL::VARCHAR AS vehicle, NULL::VARCHAR AS location"


@query("x4_call_mentions", f"WITH {CALLS} SELECT order_id, CAST(line AS BIGINT) AS position, name, phone, {NO_IDS} FROM (SELECT order_id, line, a AS name, phone FROM c UNION ALL SELECT order_id, line, b, other FROM c) WHERE name IS NOT NULL")
def x4m(t) -> DataFrame:
    return X.call_rows(_calls(t), "order_id", CALL, "line").mentions


@query("x5_transaction_rows", f"""WITH {V.EVENTS} SELECT order_id, CAST(line AS BIGINT) AS position, 'TRANSACTION' AS type, person_a AS a_name, person_b AS b_name, date, NULL::VARCHAR AS time, 'date_only' AS precision,
  'Transaction ' || person_a || ' → ' || person_b || ' ₹' || qty AS description, CAST(qty AS VARCHAR) AS amount, 'T' || order_id AS transaction_id, 'A' || person_a AS sender_account, NULL::VARCHAR AS receiver_account, source AS location FROM events_v WHERE event_type = 'TRANSACTION'""")
def x5(t) -> DataFrame:
    e = V.events(t).where("event_type = 'TRANSACTION'").withColumns({"acc": F.concat(F.lit("A"), "person_a"), "tid": F.concat(F.lit("T"), F.col("order_id").cast("string")), "blank": F.lit("  ")})
    columns = {"sender_name": "person_a", "receiver_name": "person_b", "sender_account": "acc", "receiver_account": "blank", "amount": "qty", "transaction_id": "tid", "location": "source", "date": "date"}
    return _flat(X.transaction_rows(e, "order_id", columns, "line").events, "amount", "transaction_id", "sender_account", "receiver_account", "location")


REGISTRY = "g AS (SELECT c_custkey AS id, c_name AS person_name, c_mktsegment AS location, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS account, CASE WHEN c_custkey % 3 = 0 THEN '2026-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS date FROM customer)"


def _registry(t) -> X.Bundle:
    k = F.col("c_custkey")
    date = F.when(k % 3 == 0, F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/01/2026")))
    rows = t("customer").select(k.alias("id"), "c_name", "c_mktsegment", F.when(k % 2 == 0, k.cast("string")).otherwise("  ").alias("acc"), date.alias("day"))
    return X.registry_rows(rows, "id", {"person_name": "c_name", "location": "c_mktsegment", "account": "acc", "date": "day"})


@query("x6_registry_entities", f"WITH {REGISTRY} SELECT id, NULL::BIGINT AS position, type, value, 1.0::DOUBLE AS confidence, 'csv' AS method, date, NULL::VARCHAR AS time FROM (SELECT *, 'LOCATION' AS type, location AS value FROM g UNION ALL SELECT *, 'BANK_ACCOUNT', account FROM g) WHERE value IS NOT NULL")
def x6(t) -> DataFrame:
    return _registry(t).entities


@query("x6_registry_events", f"WITH {REGISTRY} SELECT id, NULL::BIGINT AS position, 'CASE_EVENT' AS type, person_name AS a_name, NULL::VARCHAR AS b_name, date, NULL::VARCHAR AS time, 'date_only' AS precision, 'Dataset record — ' || person_name AS description, account, location FROM g WHERE date IS NOT NULL")
def x6e(t) -> DataFrame:
    return _flat(_registry(t).events, "account", "location")


#: The event log as JSON records with several spellings of keys and types.
KINDS = "(['co_location', 'Payment', 'call', 'incident', NULL, 'rumour'])[CAST(event_id % 6 AS INT) + 1]"
RECORDS = f"""j AS (SELECT event_id AS id, lower({KINDS}) AS said, CAST(user_id AS VARCHAR) AS p, CASE WHEN event_id % 4 <> 0 THEN event_type END AS q, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time FROM events)"""


def _json_bundle(t) -> X.Bundle:
    n = F.col("event_id") % 6
    kind = F.when(n == 0, "co_location").when(n == 1, "Payment").when(n == 2, "call").when(n == 3, "incident").when(n == 5, "rumour")
    q = F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise("")
    k, p = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    record = F.create_map(*[x for name, v in {"type": kind, "person": p, "with": q, "place": k, "mobile": p, "sender_name": p, "to_name": q, "from_account": k, "amount": k, "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "utr": p}.items() for x in (F.lit(name), v)])
    return X.json_bundle(t("events").select(F.col("event_id").alias("id"), F.lit(0).alias("position"), F.map_filter(record, lambda _, v: v.isNotNull()).alias("record")), "id")


@query("x7_x8_events", f"""WITH {RECORDS} SELECT id, 1::BIGINT AS position, CASE WHEN said = 'co_location' THEN 'LOCATION_OBSERVATION' WHEN said = 'call' THEN 'CALL' WHEN said = 'incident' THEN 'CASE_EVENT' ELSE 'TRANSACTION' END AS type, p AS a_name, q AS b_name, date, time, 'exact' AS precision,
  CASE WHEN said = 'co_location' THEN p || ' and ' || q || ' observed together at ' || k WHEN said = 'call' THEN 'Call ' || p || ' → ' || coalesce(q, '') WHEN said = 'incident' THEN 'Dataset record 1' ELSE 'Transaction ' || p || ' → ' || coalesce(q, '') || ' ₹' || k END AS description,
  CASE WHEN said = 'co_location' THEN NULL ELSE k END AS amount, CASE WHEN said = 'co_location' THEN NULL ELSE p END AS transaction_id, CASE WHEN said = 'co_location' THEN k END AS location FROM j WHERE (said IS NULL OR said <> 'rumour') AND (said IS NULL OR said <> 'co_location' OR q IS NOT NULL)""")
def x78(t) -> DataFrame:
    return _flat(_json_bundle(t).events, "amount", "transaction_id", "location")


@query("x7_x8_entities", f"""WITH {RECORDS} SELECT id, 1::BIGINT AS position, type, value, confidence, 'json' AS method, date, time FROM (SELECT *, 'LOCATION' AS type, k AS value, 0.9::DOUBLE AS confidence FROM j WHERE said = 'co_location'
  UNION ALL SELECT *, 'PHONE', p, 0.95::DOUBLE FROM j WHERE said = 'co_location' UNION ALL SELECT *, 'BANK_ACCOUNT', k, 1.0::DOUBLE FROM j WHERE said IS NULL OR said <> 'co_location')""")
def x78e(t) -> DataFrame:
    return _json_bundle(t).entities


@query("x7_x8_mentions", f"""WITH {RECORDS} SELECT id, 1::BIGINT AS position, p AS name, CASE WHEN said = 'co_location' THEN p END AS phone, CASE WHEN said = 'co_location' THEN NULL ELSE k END AS account, NULL::VARCHAR AS vehicle, CASE WHEN said = 'co_location' THEN k END AS location FROM j
  UNION ALL SELECT id, 1, q, NULL, NULL, NULL, CASE WHEN said = 'co_location' THEN k END FROM j WHERE q IS NOT NULL""")
def x78m(t) -> DataFrame:
    return _json_bundle(t).mentions


@query("x9_split_datetime", """SELECT event_id AS id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(ts, '%H:%M') END AS time FROM events""")
def x9(t) -> DataFrame:
    k = F.col("event_id") % 3
    cell = F.when(k == 0, F.date_format("ts", "dd-MMM-yyyy HH:mm")).when(k == 1, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    date, time = X.split_datetime(F.col("cell"))
    return t("events").select(F.col("event_id").alias("id"), cell.alias("cell")).select("id", date.alias("date"), time.alias("time"))


@query("x10_merge_mentions", f"WITH {V.NAMES} SELECT file, lower(trim(name)) AS name_key, arg_min(trim(name), id) AS name, list_sort(list_distinct(list(account))) AS accounts, list_sort(list_distinct(list(id))) AS positions, count(*) AS n_rows FROM names_v GROUP BY file, lower(trim(name))")
def x10(t) -> DataFrame:
    return X.merge_mentions(V.names(t), "file", "name", "id", accounts="account")


@query("x11_precision", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'exact' WHEN o_orderkey % 3 = 1 THEN 'date_only' ELSE 'unknown' END AS precision FROM orders")
def x11(t) -> DataFrame:
    k = F.col("o_orderkey") % 3
    date, time = F.when(k < 2, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k == 0, F.date_format("o_orderdate", "HH:mm"))
    return t("orders").select(F.col("o_orderkey").alias("id"), C.precision_tag(date, time).alias("precision"))


@query("x12_blank_to_null", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def x12(t) -> DataFrame:
    cell = F.when(F.col("c_custkey") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    return t("customer").select(F.col("c_custkey").alias("id"), C.blank_to_null(cell).alias("segment"))
