"""Small fixtures with known answers, and the defined cases."""

import pytest
from pyspark.sql import functions as F

from evgraph.functions import scalars as C
from evgraph.operators import extract as X
from evgraph.operators import graph as G
from evgraph.operators import quality as Q
from evgraph.operators import relate as E
from evgraph.operators import report as T
from evgraph.operators import resolve as R
from evgraph.operators.components import connected_components
from evgraph.sources import files as S
from evgraph.streaming import flows as W


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (C.norm_phone, "+91-98765-43210", "9876543210"), (C.norm_phone, "0919876543210", "9876543210"), (C.norm_phone, None, ""),
        (C.norm_name, "  Ravi   Kumar. ", "ravi kumar"), (C.norm_name, None, ""), (C.norm_vehicle, "TS 09 AB 1234", "TS09AB1234"),
        (C.norm_account, "ab-12/3", "AB123"), (C.norm_location, " o'brien  sTREET-west ", "O'Brien Street-West"),
        (C.norm_date, "20-Aug-2026", "2026-08-20"), (C.norm_date, "5/9/2026", "2026-09-05"), (C.norm_date, "31-02-2026", "31-02-2026"), (C.norm_date, "01-02-85", "1985-02-01"),
        (C.norm_date, "2026-08-20T10:15:00", "2026-08-20"), (C.norm_date, "  ", None), (C.norm_date, None, None), (C.norm_date, "7-september-2026", "2026-09-07"), (C.norm_date, "20/Aug/2026", "2026-08-20"),
        (C.norm_date, "20 Aug 2026", "2026-08-20"), (C.norm_date, "20-OCT-2026", "2026-10-20"), (C.norm_date, "August 5 2026", "2026-08-05"), (C.norm_date, "5 Aug 71", "1971-08-05"),
        (C.norm_time, "2:10 PM", "14:10"), (C.norm_time, "12:05 am", "00:05"), (C.norm_time, "20-Aug-2026 10:15", "10:15"), (C.norm_time, "noon", "noon"), (C.norm_time, None, None),
    ],
)
def test_normalisers(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("a, b, want", [("Ravi K.", "Ravi Kumar", 0.9), ("Ravi", "ravi kumar", 0.9), ("Ravi Rao", "Ravi Kumar", 0.8), ("x", "", 0.0), ("A b", "a  B", 1.0)])
def test_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(C.name_similarity(F.col("a"), F.col("b"))).first()[0] == want


def test_datetime_split(spark):
    rows = spark.createDataFrame([(x,) for x in ("20-Aug-2026 10:15", "10:15", "20-Aug-2026", "", None)], "c string")
    d, t = X.split_datetime(F.col("c"))
    assert [tuple(r) for r in rows.select(d, t).collect()] == [("2026-08-20", "10:15"), (None, "10:15"), ("2026-08-20", None), (None, None), (None, None)]


def test_score_of_eight_calls_and_two_transactions(spark):
    rows = [("A", "B", "CALL", "2026-01-01", f"s{k % 2}") for k in range(8)] + [("B", "A", "TRANSACTION", "2026-01-02", "s0")] * 2 + [("A", "A", "CALL", None, "s9"), (None, "B", "CALL", None, "s9")]
    e = spark.createDataFrame(rows, "person_a string, person_b string, event_type string, date string, source string")
    got = E.scored(E.event_signals(e)).collect()
    assert len(got) == 1 and got[0]["score"] == 0.783 and got[0]["strength"] == "STRONG" and got[0]["tenths"] == 56
    assert E.scored(E.event_signals(e.limit(0))).count() == 0


def test_mapping_second_pass(spark):
    cells = ["calling party", "mobile no", "receiving party", "dialled number", "date of call"]
    got = Q.map_columns(spark.createDataFrame([(1, k, c) for k, c in enumerate(cells)], "dataset int, ordinal int, cell string"))
    fields = {r["field"]: r["ordinal"] for r in got.collect()}
    assert fields["caller_name"] == 0 and fields["callee_name"] == 2 and fields["callee_phone"] == 3
    assert Q.record_shape(got).first()["shape"] == "call"


def test_csv_rows_are_padded_and_numbered(spark):
    f = spark.createDataFrame([(1, 'a,b,c\n1,"x,y"\n\n2,3,4,5\n'), (2, ""), (3, None), (4, "only,header")], "id int, text string")
    got = {(r["id"], r["row_number"]): r["cells"] for r in S.csv_rows(f, "id", "text").collect()}
    assert got == {(1, 2): ["1", "x,y", ""], (1, 3): ["2", "3", "4"]}


def test_json_records_skip_what_is_no_object(spark):
    f = spark.createDataFrame([(1, '[{"A b": 1}, 7, {"c": null}]'), (2, '{"x":"y"}'), (3, "no json"), (4, None)], "id int, text string")
    assert [(r["id"], r["position"]) for r in S.json_records(f, "id", "text").orderBy("id", "position").collect()] == [(1, 0), (1, 2), (2, 0)]


def test_text_events(spark):
    f = spark.createDataFrame([(1, "Paid Rs 1,200.50 on 20-Aug-2026 at 2:10 PM"), (2, "seen 2026-08-20"), (3, "nothing"), (4, None)], "id int, text string")
    got = {r["id"]: (r["type"], r["date"], r["time"], r["precision"], r["amount"]) for r in X.text_events(f).collect()}
    assert got == {1: ("TRANSACTION", "2026-08-20", "14:10", "exact", "₹1200.50"), 2: ("CASE_EVENT", "2026-08-20", None, "date_only", None)}


def test_components_long_path_and_nulls(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_graph_measures_on_a_path(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src long, dst long, weight long")
    b = {r["id"]: r["betweenness"] for r in G.betweenness(e).collect()}
    c = {r["id"]: r["closeness"] for r in G.closeness(e).collect()}
    p = {r["id"]: r["pagerank"] for r in G.pagerank(e).collect()}
    assert b == {1: 0.0, 2: 1.0, 3: 0.0} and c[2] == 1.0 > c[1] and abs(sum(p.values()) - 1) < 1e-9 and p[2] > p[1]
    assert [tuple(r) for r in G.jaccard(e).collect()] == [(1, 3, 1, 1.0)]
    assert tuple(G.shortest_path(e, 1, 3).first()) == (2, [1, 2, 3]) and G.shortest_path(e, 1, 9).count() == 0


def test_clusters_and_canonical(spark):
    m = spark.createDataFrame([("Ravi Kumar", "p1"), ("ravi k.", None), ("Suresh", "p1"), ("Meena Devi", "p2")], "name string, value string")
    got = {r["name"]: r["cluster"] for r in R.clusters(R.candidate_pairs(m, m), m).collect()}
    assert got == {"ravi kumar": "ravi k", "ravi k": "ravi k", "suresh": "ravi k", "meena devi": "meena devi"}


def test_timeline_puts_missing_times_last(spark):
    e = spark.createDataFrame([(1, "2026-01-02", "09:00"), (2, "2026-01-02", None), (3, "2026-01-01", "23:00"), (4, None, None)], "id int, date string, time string")
    assert [r["id"] for r in T.sort_timeline(T.timeline(e), "id").collect()] == [3, 1, 2]


def test_file_validation(spark):
    f = spark.createDataFrame([(1, "csv", "a,b"), (2, "csv", "a,a\n1,2\n1\n2"), (3, "json", "x"), (4, "exe", ""), (5, "txt", None)], "id int, kind string, text string")
    got = {r["id"]: (r["errors"], r["warnings"]) for r in Q.validate_files(f).collect()}
    assert got[1] == (["no rows"], []) and got[2] == ([], ["duplicate headers", "ragged rows"]) and got[3][0] == ["type mismatch"] and got[4][0] == ["unsupported", "empty"] and got[5][0] == ["empty"]


def test_partition_replacement_is_idempotent(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "case_id int, v string")
    for df in (a, spark.createDataFrame([(1, "z")], "case_id int, v string"), spark.createDataFrame([(1, "z")], "case_id int, v string")):
        S.replace_partitions(df, f"file://{tmp_path}/t")
    assert sorted((r["case_id"], r["v"]) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [(1, "z"), (2, "y")]


def test_failure_stream_finds_bursts(spark, tmp_path):
    log = spark.createDataFrame([(1, f"2026-01-01 00:0{k}:00") for k in range(6)] + [(2, "2026-01-01 00:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(f"file://{tmp_path}/log")
    found = W.failure_stream(log, least=5)
    assert {r["user_id"] for r in found.collect()} == {1}
    s = W.failure_stream(spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/log"), delay="0 seconds")
    assert {r["user_id"] for r in W.run_to_table(s.select("user_id", "failures"), "failures").collect()} <= {1}


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    got = S.scan_files(spark, f"file://{tmp_path}").first()
    assert got["filename"] == "a.csv" and got["size"] == 8
    assert S.scan_texts(spark, f"file://{tmp_path}").first()["text"] == "x,y\n1,2\n"
