"""Every pair of persons with a value in common is a row of its own."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from compare import SMALL
from evgraph.operators import pairs as P
from evgraph.operators import relate as E
from evgraph.plans import QUERIES


def members(links):
    """value -> its persons."""
    of = {}
    for person, *value in links:
        if person is not None and None not in value:
            of.setdefault(tuple(value), set()).add(person)
    return of


def test_shared_locations_has_every_pair(spark):
    rows = spark.read.parquet(f"{SMALL}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey"), "c_nationkey", "c_mktsegment").collect()
    want = {pair for persons in members(rows).values() for pair in combinations(sorted(persons), 2)}
    found = [tuple(r) for r in QUERIES["e3_shared_locations"](spark, SMALL).collect()]
    assert len(found) == len(want) and set(found) == {(a, b, 1) for a, b in want}


def test_shared_cases_has_every_pair(spark, tmp_path):
    """Persons with the same cases are pairs too, beside pairs of persons with other cases."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    for name, df in {"orders": orders.unionByName(orders.withColumns({"o_orderkey": F.col("o_orderkey") + 100000, "o_custkey": F.col("o_custkey") + 10000}))}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("lineitem", "customer"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = spark.read.parquet(f"{tmp_path}/orders.parquet").select(F.concat(F.lit("C"), "o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority").distinct().collect()
    cases, want = {}, {}
    for person, *_ in rows:
        cases[person] = cases.get(person, 0) + 1
    for persons in members(rows).values():
        for pair in combinations(sorted(persons), 2):
            if max(map(cases.get, pair)) > 1:
                want[pair] = want.get(pair, 0) + 1
    found = [tuple(r) for r in QUERIES["e4_shared_cases"](spark, str(tmp_path)).collect()]
    assert len(found) == len(want) and {(a, b): n for a, b, n in found} == want


@pytest.mark.parametrize("at_once", [1, 40, 1 << 19])
def test_pairs_with_a_common_value(spark, monkeypatch, at_once):
    """Common values, rows that repeat, nulls, values that look alike when joined, and pairs known otherwise; at_once cuts a task's pairs into slices."""
    monkeypatch.setattr(P, "AT_ONCE", at_once)
    monkeypatch.setattr(P, "TASK_PAIRS", 400)
    hold = lambda k: [v for v in range(12) if (k * 7 + v * v) % 11 < 2] + ([99] if k % 3 else [])
    links = [(k, f"{v % 3},", f'"{v}') for k in range(90) for v in hold(k)] + [(3, "0,", '"0'), (3, "0,", '"0'), (None, "0,", '"0'), (5, None, "x"), (6, None, "x"), (200, ",", "a"), (201, "", ",a")]
    strong = lambda k: k % 4 == 0
    own = [(0, 1, 5), (1, 500, 7), (400, 401, 9), (200, 201, 1)]
    df = spark.createDataFrame(links, "who long, one string, two string").withColumn("strong", F.col("who") % 4 == 0)
    want = {(a, b): [n, n] for a, b, n in own}
    for (one, _), persons in members(links).items():
        for a, b in combinations(sorted(persons), 2):
            if strong(a) or strong(b):
                n = want.setdefault((a, b), [0, 0])
                n[0], n[1] = n[0] + 1, n[1] + (one == "0,")
    ready = spark.createDataFrame([(a, b, n, n) for a, b, n in own], "a long, b long, n long, zeros long")
    found = P.pair_signals(df, ["one", "two"], person="who", strong="strong", own=ready, n=F.lit(1), zeros=(F.col("one") == "0,").cast("int"))
    assert found.columns == ["a", "b", "n", "zeros"]
    rows = found.collect()
    assert len(rows) == len(want) and {(r.a, r.b): [r.n, r.zeros] for r in rows} == want


def test_no_links(spark):
    none = spark.createDataFrame([("p", "x"), ("q", "y")], "person string, value string")
    assert P.pair_signals(none, ["value"], n=F.lit(1)).collect() == []
    assert P.pair_signals(none.where("false"), ["value"], n=F.lit(1)).collect() == []


def test_scores_are_rounded_as_round_does(spark):
    zero = [F.lit(0).cast("long").alias(c) for c in ("calls", "locations", "shared_ids")]
    signals = spark.range(200000).select(F.col("id").alias("a"), F.col("id").alias("b"), (F.col("id") % 401).alias("transactions"), F.floor(F.col("id") / 401).alias("cases"), (F.col("id") % 5).alias("sources"), *zero)
    w = F.col("tenths") / 10.0
    exact = F.round(F.least(F.lit(1.0), w / (w + 4) + F.least("sources", F.lit(3)) * 0.1), 3)
    rows = E.scored(signals)
    assert dict(rows.dtypes)["score"] == "double" and rows.where(~exact.eqNullSafe(F.col("score"))).count() == 0
