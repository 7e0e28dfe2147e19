"""Nulls, ties, repeated rows, empty tables and shapes that the given tables do not have."""

import csv
import io
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from evgraph.functions import scalars as C
from evgraph.functions.arrays import running
from evgraph.operators import extract as X
from evgraph.operators import graph as G
from evgraph.operators import project as P
from evgraph.operators import quality as Q
from evgraph.operators import relate as E
from evgraph.operators import report as T
from evgraph.operators import resolve as R
from evgraph.operators.numbering import numbered
from evgraph.sources import files as S
from evgraph.streaming import flows as W


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_pair_within_a_fifth_of_edits_is_missed(spark):
    rng = random.Random(11)
    names = set()
    for _ in range(30):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randint(3, 32))).strip() or "x"
        names.add(base)
        for _ in range(4):
            name = list(base)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(name) + 1)
                name[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
            if name:
                names.add("".join(name))
    names = sorted(names)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if edits(a, b) <= max(len(a), len(b)) // 5}
    got = [tuple(r) for r in R.edit_pairs(spark.createDataFrame([(n,) for n in names + names[:3]], "name string")).collect()]
    assert len(want) > 40 and set(got) == want and len(got) == len(want)


def varied(rng, base, most, letters):
    name = list(base)
    for _ in range(rng.randint(1, most)):
        at = rng.randrange(len(name) + 1)
        name[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
    return "".join(name) or "x"


def test_long_names_meet(spark):
    """Lengths around SHORT, and long names that share most of their words, against all pairs."""
    rng = random.Random(5)
    words = ["private", "limited", "trading", "company", "holding", "estates"]
    names = {varied(rng, "".join(rng.choice("abcdefgh ") for _ in range(n)), n // 4, "ae") for n in (18, 20, 23, 24, 25, 26, 29, 30, 31, 40) for _ in range(6)}
    for base in list(names):
        names |= {varied(rng, base, max(1, len(base) // 5), "aex") for _ in range(3)}
    for _ in range(5):
        base = " ".join(rng.choice(words) for _ in range(12))
        names |= {base, varied(rng, base, 9, "qz"), varied(rng, base, 30, "qz"), base[: len(base) * 5 // 6], base[len(base) // 5 :]}
    names = sorted(names)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) <= max(len(a), len(b)) // 5 and edits(a, b) <= max(len(a), len(b)) // 5}
    got = [tuple(r) for r in R.edit_pairs(spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "name string")).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_many_very_long_names(spark):
    rng = random.Random(6)
    bases = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(2000)]
    names = bases + [varied(rng, b, 35, "xyz") for b in bases[:50]]
    got = {tuple(r) for r in R.edit_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {tuple(sorted((a, b))) for a, b in zip(bases, names[2000:])}


def test_no_pair_of_similar_ratio_is_missed(spark):
    rng = random.Random(7)
    names = set()
    for n in (*range(1, 14), 16, 20, 25, 33):
        for _ in range(4):
            base = "".join(rng.choice("abcdeno ") for _ in range(n))
            names |= {base, *(varied(rng, base, max(1, n // 3), "aex") for _ in range(3)), base[n // 3 :] or "x", base[: n - n // 4]}
    names = sorted(names)
    want = {(a, b): r for i, a in enumerate(names) for b in names[i + 1 :] if (r := SequenceMatcher(None, a, b).ratio()) >= 0.8}
    got = R.ratio_pairs(spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "name string")).collect()
    assert len(want) > 100 and {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)
    one = spark.createDataFrame([(None, "a"), ("", ""), ("abcd", "bcda"), ("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in one.select(C.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [None, 1.0, 0.75, 0.25, 0.5]


def test_names_that_differ_in_their_first_letter_meet(spark):
    rows = spark.createDataFrame([("Rawi Kumar",), ("Ravi Kumar",), (None,), ("  ",), ("Ravi Kumar",)], "name string")
    got = R.candidate_pairs(rows).collect()
    assert [(r["a"], r["b"], r["similarity"], r["signals"], r["confidence"]) for r in got] == [("ravi kumar", "rawi kumar", 0.9, ["name similarity"], "MEDIUM")]
    assert R.candidate_pairs(rows.limit(0)).count() == 0


def test_roll_up_of_three_mentions(spark):
    m = spark.createDataFrame([("Ravi Kumar", "p1", None), ("ravi k.", "p1", "v1"), ("Meena Devi", None, None), ("Meena Devi", None, None)], "name string, phone string, vehicle string")
    ids = m.select("name", F.lit("phone").alias("kind"), F.col("phone").alias("value"))
    pairs = R.candidate_pairs(m, ids)
    clustered = R.clusters(pairs, m)
    got = {r["name"]: r for r in R.roll_up(m, clustered, pairs, {"phone": "phone", "vehicle": "vehicle"}).collect()}
    ravi, meena = got["Ravi Kumar"], got["Meena Devi"]
    assert ravi["variants"] == ["Ravi Kumar", "ravi k."] and ravi["signals"] == ["name similarity", "shared identifier"] and ravi["confidence"] == 0.95 and ravi["vehicle"] == ["v1"]
    assert meena["merged"] and meena["mentions"] == 2 and meena["signals"] == ["name similarity"] and meena["confidence"] == 0.8 and meena["phone"] == []
    persons = R.roll_up(m, clustered, pairs, {"phone": "phone"})
    assert {tuple(r) for r in R.alias_map(m, clustered, persons).collect()} == {("ravi kumar", "P-ravi_kumar"), ("ravi k", "P-ravi_kumar"), ("meena devi", "P-meena_devi")}
    assert R.explain(persons, "P-meena_devi").first()["merged"]


def test_graph_of_several_components(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (10, 11, 1), (20, 21, 1), (21, 22, 1), (22, 23, 1)], "src long, dst long, weight long")
    exact = {r["id"]: r["closeness"] for r in G.closeness(e, scope="component").collect()}
    few = {r["id"]: r["closeness"] for r in G.closeness_landmarks(e, landmarks=1, exact=2).collect()}
    assert set(few) == set(exact) and exact[2] == 1.0 and exact[10] == 1.0 and abs(exact[1] - 2 / 3) < 1e-9
    assert few[10] == 1.0 and few[2] == 0.0 and few[1] == 1.0 and few[23] == 0.5 and few[21] == 0.0  # 2 and 21 are landmarks themselves
    assert G.closeness_landmarks(e).where("closeness = 0").count() == 0
    assert {r["id"]: r["component"] for r in G.components(e).collect()} == {1: 0, 2: 0, 3: 0, 10: 1, 11: 1, 20: 2, 21: 2, 22: 2, 23: 2}
    few = G.betweenness(e, 4)
    assert few.count() == 9 and G.pivot_count(40) is None and G.pivot_count(41) == 12 and G.pivot_count(10_000) == 32
    empty = e.limit(0)
    for found in (G.degree(empty), G.closeness(empty), G.closeness_landmarks(empty), G.betweenness(empty), G.pagerank(empty), G.components(empty), G.communities(empty), G.jaccard(empty), G.jaccard(empty, 3)):
        assert found.count() == 0


def test_pagerank_stops_when_it_has_settled(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0)], "src long, dst long, weight double")
    a, b = ({r["id"]: r["pagerank"] for r in G.pagerank(e, rounds, tolerance=t).collect()} for rounds, t in ((200, 1e-5), (80, None)))
    assert all(abs(a[k] - b[k]) < 1e-4 for k in b) and abs(sum(a.values()) - 1) < 1e-9


def test_jaccard_below_hubs(spark):
    rng = random.Random(5)
    pairs = {(a, b) for a, b in ((min(x), max(x)) for x in ((rng.randrange(12), rng.randrange(12)) for _ in range(30))) if a != b} | {(0, k) for k in range(1, 12)}
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in range(12)}
    want = {}
    for a in range(12):
        for b in range(a + 1, 12):
            common = near[a] & near[b]
            if any(len(near[x]) <= 5 for x in common):
                want[a, b] = len(common)
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    assert {(r["a"], r["b"]): r["common"] for r in G.jaccard(e, 5).collect()} == want
    assert G.jaccard(e, top=3).count() == 3


def test_numbers_of_a_key_that_has_most_rows(spark):
    rows = [("hot", k) for k in range(500)] + [("cold", 3), (None, 1), (None, 2), ("cold", 1), ("tie", 1), ("tie", 1)]
    random.Random(1).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "c string, k long").repartition(6), ["c"], ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got if r["c"] == "hot") == [(k, k + 1) for k in range(500)]
    assert sorted((r["c"] or "", r["k"], r["n"]) for r in got if r["c"] != "hot") == [("", 1, 1), ("", 2, 2), ("cold", 1, 1), ("cold", 3, 2), ("tie", 1, 1), ("tie", 1, 2)]
    assert numbered(spark.createDataFrame([], "c string, k long"), [], ["k"], "n").count() == 0


def test_running_sums(spark):
    values = [[], [4], [1, 2, 3, 4, 5], [1] * 70]
    got = spark.createDataFrame([(v,) for v in values], "v array<int>").select(running(F.col("v"), lambda x, y: x + y)).collect()
    assert [r[0] for r in got] == [[sum(v[: k + 1]) for k in range(len(v))] for v in values]


def test_quotes_in_csv_texts(spark):
    f = spark.createDataFrame([(1, 'a,b\n"x,1",2\n"y,2",3\n'), (2, 'a,b\n"one\ntwo ""2""",3\r\n4,5'), (3, 'a,b\n1,2,3\n"open\nend'), (4, "")], "id int, text string")
    got = {(r["id"], r["row_number"]): r["cells"] for r in S.csv_rows(f, "id", "text").collect()}
    assert got == {(1, 2): ["x,1", "2"], (1, 3): ["y,2", "3"], (2, 2): ['one\ntwo "2"', "3"], (2, 3): ["4", "5"], (3, 2): ["1", "2"], (3, 3): ["open\nend", ""]}  # an open quote runs to the end
    found = {r["id"]: r["warnings"] for r in Q.validate_files(f.withColumn("kind", F.lit("csv"))).collect()}
    assert found[1] == [] and found[2] == [] and found[3] == ["ragged rows"]


def test_csv_texts_of_any_shape(spark):
    """Wide records, large cells, many quotes, quotes inside unquoted cells, blank records and line ends, as the csv module of Python reads them."""
    wide = ",".join(f'"c{k}, ""{k}"""' for k in range(10_000))
    large = "x, \n" * 2_000_000
    texts = [
        f"{wide}\n{wide}", f'a,b\n"{large}",2', 'a\n"' + '""' * 500_000 + '"', 'a,b\n5" pipe,6" pipe\n"a"b,c"d"', "a,b\n , \n,,\n\n1, 2 \r\n3,4\r\n", "\n\na,b\n1,2", 'a,b\r"x\ry",2\r', "a\n1\x002",
        "a,b", "", " , \n", 'é,"漢,字"\n🙂,"“q”"', None,
    ]
    f = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["id"], r["row_number"]): (r["cells"], r["n_cells"]) for r in S.csv_rows(f, "id", "text").collect()}
    csv.field_size_limit(1 << 30)
    want = {}
    for k, text in enumerate(texts):
        try:
            records = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text or "", newline=""))]
        except csv.Error:
            continue
        records = [r for r in records if any(r)]
        for n, r in enumerate(records[1:], 2):
            want[k, n] = ((r + [""] * len(records[0]))[: len(records[0])], len(r))
    assert got == want and {k for k, _ in got} >= {0, 1, 2, 3, 4, 5, 11}
    errors = {r["id"]: r["errors"] for r in Q.validate_files(f.withColumn("kind", F.lit("csv"))).collect()}
    assert errors[0] == [] and errors[8] == ["no rows"] and errors[9] == ["empty", "no rows"] and errors[12] == ["empty", "no rows"] and "binary" in errors[7]


def test_mapping_by_name_and_index(spark):
    h = spark.createDataFrame([(1, 0, "Date"), (1, 1, "Amount"), (1, 2, "amount")], "dataset int, ordinal long, cell string")
    m = spark.createDataFrame([(1, "amount", "AMOUNT"), (1, "date", "0"), (1, "time", "3"), (1, "place", "Date"), (1, "phone", "nope"), (2, "date", "0"), (1, "date", None), (1, "time", "99999999999999999999")], "dataset int, field string, cell string")
    got = {(r["dataset"], r["field"], r["cell"]): (r["ordinal"], r["error"]) for r in Q.check_mapping(m, h).collect()}
    assert got[1, "amount", "AMOUNT"] == (1, None) and got[1, "date", "0"] == (0, None) and got[1, "time", "3"] == (None, "index out of range")
    assert got[1, "place", "Date"] == (None, "unknown field") and got[1, "phone", "nope"] == (None, "missing column") and got[1, "date", None] == (None, "missing column")
    assert got[2, "date", "0"] == (None, "index out of range") and got[1, "time", "99999999999999999999"] == (None, "index out of range")


def test_json_records_by_type(spark):
    said = [
        {"type": "Transfer", "sender": "A", "receiver": "B", "amount": "5", "from_account": "x1", "timestamp": "20-Aug-2026 10:15", "city": "Pune"},
        {"sender_name": "A", "to_name": ""},  # no type: a transaction
        {"record_type": "incident", "summary": "s" * 600, "date": "2026-08-20"},
        {"type": "record"},
        {"type": "rumour", "sender": "C", "vehicle": "TS1"},  # unknown: no event
        {"type": "co_location", "person": "A", "with": "D", "place": "Docks", "mobile": "9"},
        {"type": "cctv", "subject": "E", "location": "Mall"},  # one person alone: no event
        {"type": "call", "sender": "A", "receiver": "B"},
    ]
    rows = spark.createDataFrame([(1, k, r) for k, r in enumerate(said)], "id int, position int, record map<string,string>")
    b = X.json_bundle(rows, "id")
    e = {r["position"]: r for r in b.events.collect()}
    assert {k: v["type"] for k, v in e.items()} == {1: "TRANSACTION", 2: "TRANSACTION", 3: "CASE_EVENT", 4: "CASE_EVENT", 6: "LOCATION_OBSERVATION", 8: "CALL"}
    assert (e[1]["date"], e[1]["time"], e[1]["precision"], e[1]["details"]["sender_account"]) == ("2026-08-20", "10:15", "exact", "x1") and e[2]["b_name"] is None
    assert len(e[3]["description"]) == 500 and e[4]["description"] == "Dataset record 4" and e[6]["description"] == "A and D observed together at Docks"
    found = sorted((r["position"], r["type"], r["value"], r["confidence"]) for r in b.entities.collect())
    assert found == [(1, "BANK_ACCOUNT", "x1", 1.0), (1, "LOCATION", "Pune", 0.9), (5, "VEHICLE", "TS1", 0.9), (6, "LOCATION", "Docks", 0.9), (6, "PHONE", "9", 0.95), (7, "LOCATION", "Mall", 0.9)]
    people = sorted((r["position"], r["name"], r["phone"], r["location"]) for r in b.mentions.collect() if r["position"] > 4)
    assert people == [(5, "C", None, None), (6, "A", "9", "Docks"), (6, "D", None, "Docks"), (7, "E", None, "Mall"), (8, "A", None, None), (8, "B", None, None)]
    assert all(x.count() == 0 for x in X.json_bundle(rows.limit(0), "id"))


def test_csv_records(spark):
    calls = spark.createDataFrame([(1, "Ann", "1", " ", "2", "60", "20-Aug-2026 9:05"), (2, " ", None, "", None, "5", "20-Aug-2026")], "id int, a string, p string, b string, q string, s string, at string")
    b = X.call_rows(calls, "id", {"caller_name": "a", "caller_phone": "p", "callee_name": "b", "callee_phone": "q", "duration": "s", "timestamp": "at"})
    assert [(r["id"], r["a_name"], r["b_name"], r["description"], r["time"], r["details"]["duration"]) for r in b.events.collect()] == [(1, "Ann", None, "Call Ann → 2", "09:05", "60")]
    assert b.entities.count() == 2 and [r["phone"] for r in b.mentions.collect()] == ["1"]
    sums = spark.createDataFrame([(1, None, "Docks"), (2, "7", None)], "id int, amount string, place string")
    b = X.transaction_rows(sums, "id", {"amount": "amount", "location": "place"})
    assert [(r["id"], r["description"], r["precision"]) for r in b.events.collect()] == [(2, "Transaction  →  ₹7", "unknown")] and [r["value"] for r in b.entities.collect()] == ["Docks"]
    known = spark.createDataFrame([(1, None, "v1", "2026-08-20"), (2, "Ann", None, None), (3, " ", None, "2026-08-20")], "id int, n string, v string, d string")
    b = X.registry_rows(known, "id", {"person_name": "n", "vehicle": "v", "date": "d"})
    assert [(r["id"], r["description"]) for r in b.events.collect()] == [(1, "Dataset record — v1")] and [r["name"] for r in b.mentions.collect()] == ["Ann"]


def test_mentions_and_names(spark):
    m = spark.createDataFrame([(1, 2, " Ann", "p2"), (1, 3, "ANN ", "p1"), (1, 4, None, "p3"), (2, 2, "Ann", None)], "file int, row int, name string, phone string")
    got = {r["file"]: (r["name"], r["phones"], r["positions"], r["n_rows"]) for r in X.merge_mentions(m, "file", "name", "row", phones="phone").collect()}
    assert got == {1: ("Ann", ["p1", "p2"], [2, 3], 2), 2: ("Ann", [], [2], 1)}
    d = spark.createDataFrame([("Ann",), ("Ann Lee",), ("ann lee ray",), (None,), ("..",)], "name string")
    t = spark.createDataFrame([(1, "Then ANN LEE met ann."), (2, None), (3, "annex")], "id int, text string")
    got = {(r["id"], r["name"], r["position"], r["original"]) for r in X.dictionary_matches(t, d).collect()}
    assert got == {(1, "Ann", 1, "ANN"), (1, "Ann Lee", 1, "ANN LEE")}
    assert [r["name"] for r in X.dictionary_matches(t, d, longest=True).collect()] == ["Ann Lee"]


def test_relations_with_nulls_and_strangers(spark):
    kind = "person_a string, person_b string, event_type string, date string, source string, case_id int, id int"
    e = spark.createDataFrame([("A", "B", "CALL", None, None, None, 1), ("B", "A", None, "2026-01-01", "s", 1, 2), ("A", None, "CALL", None, "s", 1, 3), ("A", "X", "CALL", None, "s", 1, 4), ("A", "A", "CALL", None, "s", 1, 5)], kind)
    people = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "person string")
    got = E.event_signals(e, persons=people).collect()
    assert [(r["a"], r["b"], r["calls"], r["transactions"], r["sources"], r["first_date"]) for r in got] == [("A", "B", 1, 0, 1, "2026-01-01")]
    assert sorted(r["evidence_id"] for r in E.evidence_rows(e, "case_id", ["id"]).collect()) == ["E1-", "E1-1", "E2-1"]
    assert E.evidence_rows(e.limit(0), "case_id", ["id"]).count() == 0
    members = spark.createDataFrame([("A", 1), ("B", 1), ("A", 2), ("C", 3), ("D", 3), (None, 1), ("E", None), ("B", 1)], "person string, case_id int")
    assert [tuple(r) for r in E.shared_cases(members).collect()] == [("A", "B", 1)]
    f = spark.createDataFrame([("r", "relevant", 1), ("r", "incorrect", 2)], "relationship string, decision string, at int")
    assert tuple(E.latest_decisions(f, "relationship", "decision", "at").first()) == ("r", "incorrect", 2, 1, 1, 0)
    old = spark.createDataFrame([("A", "B", 0.2, "relevant"), ("C", "D", 0.4, None)], "a string, b string, score double, decision string")
    new = spark.createDataFrame([("A", "B", 0.9, 3), ("E", "F", 0.1, None)], "a string, b string, score double, calls int")
    assert sorted(tuple(r) for r in E.upsert(old, new).collect()) == [("A", "B", 0.9, 3, "relevant"), ("C", "D", 0.4, None, None), ("E", "F", 0.1, None, None)]


def test_projection(spark):
    e = spark.createDataFrame([("e1", "A", "B", "c1"), ("e2", "A", None, "c1"), ("e3", "C", "C", None)], "id string, person_a string, person_b string, case_id string")
    links = spark.createDataFrame([("A", "phone:1", "phone"), ("A", "phone:1", "phone"), ("B", "x:1", None)], "person string, node string, role string")
    rel = spark.createDataFrame([("A", "B", 0.5, "MODERATE"), ("A", "A", 0.5, "MODERATE")], "a string, b string, score double, strength string")
    got = P.typed_edges(events=e, links=links, relationships=rel)
    assert got.count() == got.select("id").distinct().count() == 3 + 1 + 2 + 2 + 1
    assert {(r["type"], r["src"]) for r in got.where("type NOT IN ('PARTICIPATED_IN', 'INVOLVED_IN')").collect()} == {("USES_PHONE", "A"), ("ASSOCIATED_WITH", "B"), ("CONNECTED_TO", "A")}
    cases = spark.createDataFrame([("c1",)], "case_id string")
    assert {r["id"] for r in P.case_persons(cases, e, links=spark.createDataFrame([("Z", "c1"), ("Y", "c2")], "person string, case_id string")).collect()} == {"A", "B", "Z"}
    assert P.metric_graph(rel, persons=spark.createDataFrame([("A",)], "id string")).count() == 0 and P.metric_graph(rel).count() == 1


def test_graph_sink_is_an_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    nodes = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1), (None, "y", 1)], "id string, label string, v int")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, src string, dst string")
    assert S.read_graph(spark, path, "nodes") is None
    for _ in range(2):
        S.write_graph(nodes.select("id", "v", "label"), edges, path)
    S.write_graph(spark.createDataFrame([("b", 5, "z")], "id string, v int, label string"), edges.limit(0), path)
    assert sorted(tuple(r) for r in S.read_graph(spark, path, "nodes").collect()) == [("a", 2, "new"), ("b", 5, "z")] and S.read_graph(spark, path, "edges").count() == 1
    assert sorted(tuple(r) for r in S.merge_by_key(nodes, nodes.limit(0), "id").collect()) == [("a", "new", 2), ("a", "old", 1), ("b", "x", 1)]


def test_reports_of_nothing_and_of_nulls(spark):
    kind = "id int, person_a string, person_b string, event_type string, date string, time string, source string, case_id int"
    e = spark.createDataFrame([(1, "A", "B", "CALL", "2026-01-02", None, "s", 1), (2, "A", None, None, None, None, None, None), (3, "A", "C", "CALL", "2026-01-02", "09:00", None, 1), (4, "C", "A", None, None, "08:00", None, 2)], kind)
    got = {r["person_a"]: r for r in T.temporal_summary(e, "person_a", ["id"], 1).collect()}
    assert (got["A"]["events"], got["A"]["timed_events"], got["A"]["earliest"]["id"], got["A"]["latest"]["id"], [x["id"] for x in got["A"]["sequence"]]) == (3, 2, 1, 3, [1])
    ids = spark.createDataFrame([("A", "phone", "1"), ("A", "phone", "1")], "person string, kind string, value string")
    rel = E.scored(E.event_signals(e))
    evidence = E.evidence_rows(e, "case_id", ["id"])
    p = {r["person"]: r for r in T.profile(e, ids, rel).collect()}
    assert (p["A"]["events"], p["A"]["n_cases"], p["A"]["n_identifiers"], p["B"]["n_identifiers"]) == (4, 2, 1, None)
    d = T.profile_details(e, ids, rel, evidence)
    assert d.where("section = 'identifier'").count() == 1 and d.where("section = 'case' AND person = 'A'").count() == 2 and d.where("section = 'evidence'").count() == 6
    c = {r["case_id"]: r for r in T.case_context(e, evidence, rel).collect()}
    assert c[1]["people"] == 3 and c[1]["relationships"] == 2 and c[None]["evidence"] == 0
    none = e.limit(0)
    for found in (T.temporal_summary(none, "person_a", ["id"]), T.profile(none, ids.limit(0), rel.limit(0)), T.profile_details(none, ids.limit(0), rel.limit(0), evidence.limit(0)), T.case_context(none, evidence.limit(0), rel.limit(0))):
        assert found.count() == 0
    log = spark.createDataFrame([(1, 1, "login", 7, 10), (1, 2, "view", 8, 20), (2, 3, "view", None, 5)], "user_id int, event_id int, action string, item int, ts int")
    o = {r["user_id"]: r for r in T.overview(log, spark.createDataFrame([(1, 7), (3, 9)], "user_id int, case_id int")).collect()}
    assert (o[1]["cases"], o[1]["last_login"], o[1]["last_action"], o[1]["recent"]) == (1, 10, "view", [8, 7]) and o[2]["last_login"] is None and o[2]["cases"] == 0 and o[3]["recent"] == []
    assert T.in_scope(e, ids.select(F.lit(1).alias("case_id"))).count() == 2 and T.in_scope(e, ids, admin=True).count() == 4


def test_failures_are_cleared_by_a_success(spark):
    rng = random.Random(8)
    log = [(k, rng.randrange(3), rng.randrange(600), rng.random() < 0.15) for k in range(150)]
    want = {}
    for k, user, at, ok in log:
        cleared = max([(x[2], x[0]) for x in log if x[1] == user and x[3] and (x[2], x[0]) < (at, k)], default=(-1, -1))
        if not ok:
            # rows of the same second count whatever their order, as long as no success lies between
            later = min([(x[2], x[0]) for x in log if x[1] == user and x[3] and (x[2], x[0]) > (at, k)], default=(10**9, 0))
            want[k] = sum(x[1] == user and not x[3] and at - 60 < x[2] <= at and cleared < (x[2], x[0]) < later for x in log)
    rows = spark.createDataFrame([(k, u, at, ok) for k, u, at, ok in log] + [(999, 1, None, False)], "event_id int, user_id int, at int, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    got = {r["event_id"]: r["failures"] for r in W.failure_windows(rows, seconds=60, least=1, success="ok").collect()}
    assert got == want


def test_rolling_pairs_and_states(spark):
    e = spark.createDataFrame([("B", "A", "CALL", "2026-01-01 10:00:00"), ("A", "B", "CCTV", "2026-01-01 11:00:00"), ("A", None, "CALL", "2026-01-01 11:00:00")], "person_a string, person_b string, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [tuple(r)[:2] + tuple(r)[3:] for r in W.rolling_pairs(e).collect()] == [("A", "B", 1, 0, 1)]
    c = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5), (5, 5)], "case_id int, ts int")
    p = spark.createDataFrame([(1, 4, True), (2, 6, None), (3, 6, True), (4, 6, False)], "case_id int, ts int, ok boolean")
    assert {r["case_id"]: r["state"] for r in W.sync_state(c, p).collect()} == {1: "PENDING", 2: "SYNCING", 3: "SYNCED", 4: "FAILED", 5: "PENDING"}


def test_import_reports(spark):
    e = spark.createDataFrame([("d", "A", "B"), ("d", "B", "A"), ("d", None, "A")], "doc string, a string, b string")
    assert tuple(Q.discovery_counts(e, "doc", "a", "b").first()) == ("d", 3, 1)
    g = Q.growth(e.limit(0), e, "doc").collect()
    assert [(r["n_before"], r["n_after"], r["n_new"]) for r in g] == [(0, 3, 3)]


def in_files(spark, rows, path):
    """rows as a stream whose files come one a batch, in the given order."""
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_attempts_by_user_and_address_as_a_stream(spark, tmp_path):
    """The stream gives the batch form's rows; a failure exactly as old as the window is over; a success clears both keys."""
    rng = random.Random(12)
    log = [(k, rng.choice(["Bob", " bob ", "eve", None]), rng.choice(["1.1", "2.2"]), rng.randrange(900), rng.choice([False, False, False, None, True])) for k in range(200)]
    log += [(1000, "old", "9.9", 2000, False), (1001, "old", "9.9", 2060, False), (1002, "new", "9.8", 2000, False), (1003, "new", "9.8", 2059, False), (1004, "x", "9.7", None, False)]
    log.sort(key=lambda r: (r[3] is None, r[3], r[0]))
    df = spark.createDataFrame(log, "event_id long, who string, ip string, at int, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    parts = [df.where("at < 300 OR at IS NULL"), df.where("at >= 300 AND at < 2001"), df.where("at >= 2001")]
    keys = lambda rows: W.attempt_keys(rows, user="who", address="ip")
    stream = in_files(spark, parts, f"file://{tmp_path}/log")
    got = {(r["key"], r["event_id"]): r["failures"] for r in W.run_to_table(W.limited_attempts(keys(stream), 60, 2).drop("ts"), "limited").collect()}
    want = {(r["key"], r["event_id"]): r["failures"] for r in W.failure_windows(keys(df), "key", 60, 2, "ok").collect()}
    assert got == want and len(want) > 50
    assert ("user:new", 1003) in got and ("user:old", 1001) not in got and {k for k, _ in got} >= {"user:bob", "address:1.1"}


def test_steps_of_cases_in_any_order(spark, tmp_path):
    rng = random.Random(13)
    changes = [(rng.randrange(9), rng.randrange(50)) for _ in range(40)] + [(None, 3), (1, None)]
    projections = [(rng.randrange(11), rng.randrange(50), rng.choice([None, True, False])) for _ in range(60)]
    c = spark.createDataFrame(changes, "case_id int, s int").select("case_id", F.timestamp_seconds("s").alias("ts"))
    p = spark.createDataFrame(projections, "case_id int, s int, ok boolean").select("case_id", F.timestamp_seconds("s").alias("ts"), "ok")
    cut = F.pmod(F.hash("case_id", "ts"), F.lit(3))
    one, two = (in_files(spark, [df.where(cut == k) for k in range(3)], f"file://{tmp_path}/{name}") for name, df in (("c", c), ("p", p)))
    steps = W.run_to_table(W.sync_transitions(one, two), "steps").collect()
    last = {}
    for r in sorted(steps, key=lambda r: (r["case_id"], r["n"])):
        before = last.get(r["case_id"], (0, None))
        assert (r["n"] - 1, r["before"]) == before and r["before"] != r["after"]
        last[r["case_id"]] = (r["n"], r["after"])
    assert {k: v for k, (_, v) in last.items() if v} == {r["case_id"]: r["state"] for r in W.sync_state(c.where("case_id IS NOT NULL AND ts IS NOT NULL"), p).collect()}
    plain = [(1, 10, None), (1, 20, True), (1, 30, None), (1, 40, False)]
    p = spark.createDataFrame(plain, "case_id int, s int, ok boolean").select("case_id", F.timestamp_seconds("s").alias("ts"), "ok")
    c = spark.createDataFrame([(1, 5), (1, 25)], "case_id int, s int").select("case_id", F.timestamp_seconds("s").alias("ts"))
    one, two = (in_files(spark, [df], f"file://{tmp_path}/{name}") for name, df in (("c2", c), ("p2", p)))
    got = W.run_to_table(W.sync_transitions(one, two), "steps").orderBy("n").collect()
    assert [r["after"] for r in got] == ["PENDING", "SYNCING", "SYNCED", "PENDING", "SYNCING", "FAILED"]


def test_pair_view_after_each_batch(spark, tmp_path):
    rows = [("A", "B", "CALL", 0), ("B", "A", "CALL", 5), ("A", "C", "TRANSACTION", 5), ("A", "B", "CCTV", 90_000), (None, "B", "CALL", 5), ("A", "A", "CALL", 5), ("A", "B", "CALL", 200_000), ("B", "C", "CALL", 3)]
    df = spark.createDataFrame(rows, "person_a string, person_b string, event_type string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path, work = f"file://{tmp_path}/events", f"file://{tmp_path}/work"
    seen = None
    for part in ("s < 4 OR ts IS NULL", "s = 5", "s > 5"):
        part = df.withColumn("s", F.unix_timestamp("ts")).where(part).drop("s")
        stream = in_files(spark, [part], path)
        W.maintain_pairs(stream, work).awaitTermination()
        seen = part if seen is None else seen.unionByName(part)
        got = {(r["a"], r["b"]): (r["calls"], r["transactions"], r["locations"]) for r in W.pair_totals(spark, work).collect()}
        want = {}
        for r in seen.where("person_a <> person_b").collect():
            k, n = tuple(sorted((r["person_a"], r["person_b"]))), ["CALL", "TRANSACTION", "CCTV"].index(r["event_type"])
            want[k] = tuple(x + (m == n) for m, x in enumerate(want.get(k, (0, 0, 0))))
        assert got == want
    assert sum(1 for _ in (tmp_path / "work" / "pairs").glob("batch=*")) >= 3


def test_null_and_absent_types(spark):
    said = [{"type": None, "sender": "A", "amount": "5"}, {"type": None, "record_type": "call", "sender": "A"}, {"record_type": None, "sender": "A"}, {"record_type": "call", "sender": "A"}, {"receiver": "B"}]
    rows = spark.createDataFrame([(1, k, r) for k, r in enumerate(said)], "id int, position int, record map<string,string>")
    b = X.json_bundle(rows, "id")
    assert {r["position"]: (r["type"], r["description"]) for r in b.events.collect()} == {4: ("CALL", "Call A → "), 5: ("TRANSACTION", "Transaction  → B")}
    assert [r["name"] for r in b.mentions.orderBy("position").collect()] == ["A", "A", "A", "A", "B"]


def test_names_of_any_length(spark):
    long = "the Grand Old Duke of York"
    d = spark.createDataFrame([(x,) for x in ("ravi k.", "RAVI", "vi", long, None, "", "É", "ann lee")], "name string")
    t = spark.createDataFrame([(1, "Then Ravi K. met THE grand old  duke"), (2, f"x{long.upper()}x and École"), (3, None), (4, ""), (5, "Ann  Lee, ann lee")], "id int, text string")
    want = {(1, "ravi k.", 5, "Ravi K."), (1, "RAVI", 5, "Ravi"), (1, "vi", 7, "vi"), (2, long, 1, long.upper()), (2, "É", 33, "É"), (5, "ann lee", 10, "ann lee")}
    for most in (1 << 24, 8):  # one automaton, or several
        assert {tuple(r) for r in X.name_substrings(t, d, most=most).collect()} == want
    assert X.name_substrings(t, d.limit(0)).count() == 0 and X.name_substrings(t.limit(0), d).count() == 0
    assert {(r["id"], r["name"], r["original"]) for r in X.dictionary_matches(t.where("id = 2"), spark.createDataFrame([("Grand Old Duke of",)], "name string")).collect()} == {(2, "Grand Old Duke of", "GRAND OLD DUKE OF")}
    six = spark.createDataFrame([(6, f"See: {long}!")], "id int, text string")
    assert [r["original"] for r in X.dictionary_matches(six, d).collect()] == [long]


def test_mismatches_are_named(spark):
    a = [(1, "x", None), (2, "y", 1), (None, "n", 1), (3, "t", 1), (3, "t", 1), (4, "u", 1), (4, "v", 2), (6, "w", None)]
    b = [(1, "x", None), (2, "y", 2), (None, "n", 2), (3, "t", 1), (4, "v", 2), (4, "u", 1), (5, "z", 1)]
    left, right = (spark.createDataFrame(rows, "id int, s string, n int") for rows in (a, b))
    for buckets in (4096, 1):
        got = {r["id"]: (r["mismatch"], r["n_source"], r["n_projected"]) for r in P.mismatches(left, right.select("n", "s", "id"), "id", buckets=buckets).collect()}
        assert got == {2: ("changed", 1, 1), None: ("changed", 1, 1), 3: ("changed", 2, 1), 5: ("extra", 0, 1), 6: ("missing", 1, 0)}
    assert P.mismatches(left, left, "id").count() == 0 and P.mismatches(left.limit(0), left.limit(0), "id").count() == 0


def test_search_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(14)
    names = ["".join(rng.choice("abcdeÉ 1") for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["Ann Lee", "ann LEE", "annlee", "x", "", None, "the same", "the same"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    more = spark.createDataFrame([("z", "ANN"), ("y", "plain")], "id string, text string")
    path = f"file://{tmp_path}/index"
    T.write_search_index(path, parts=256, person=(df, "k", "name"), note=(more, "id", "text"))
    for term in ("ann", "ANN LEE", "abc", "the same", "é 1", "nothing", "a", "de", "x"):
        want = sorted(tuple(r) for r in T.search(term, person=(df, "k", "name"), note=(more, "id", "text")).collect())
        assert sorted(tuple(r) for r in T.search_index(spark, path, term).collect()) == want, term
    size = lambda files: sum(f.stat().st_size for f in files)
    folders = list((tmp_path / "index" / "postings").glob("part=*"))
    scan = size(tmp_path.glob("index/postings/part=*/*.parquet"))
    assert max(size(f.glob("*.parquet")) for f in folders) < scan / 10
