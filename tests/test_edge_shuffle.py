"""Edges of events are moved once an event, and events once for the signals of pairs."""

from evgraph.operators import project as P
from evgraph.operators import relate as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_move_once(spark):
    rows = [("v1", "A", "B", "c"), ("v1", "A", "B", "c"), ("v1", "B", "C", None), ("v2", None, "A", "c"), ("v2", "A", "A", "d"), (None, "A", "B", "c"), ("v3", "v3", "B", None)]
    events = spark.createDataFrame(rows, "id string, person_a string, person_b string, case_id string")
    found = P.typed_edges(events=events)
    participated = {(r["src"], r["dst"]) for r in found.where("type = 'PARTICIPATED_IN'").collect()}
    assert participated == {("A", "v1"), ("B", "v1"), ("C", "v1"), ("A", "v2"), ("B", "v3")}
    assert sorted((r["src"], r["dst"]) for r in found.where("type = 'INVOLVED_IN'").collect()) == [("A", "c"), ("A", "d"), ("B", "c")]
    assert found.count() == 8 == found.select("id").distinct().count()
    plan = plan_of(found.where("type = 'PARTICIPATED_IN'"))
    assert plan.index("Generate explode") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_signals_of_many_events_move_once(spark):
    kind = "person_a string, person_b string, event_type string, date string, source string"
    rows = [("A", "B", "CALL", None, "s"), ("B", "A", "CALL", "2026-01-01", "s"), ("A", "B", "TRANSACTION", "2026-01-02", "t"), ("A", "B", None, None, None), ("A", "C", "CCTV", None, None), ("A", "A", "CALL", None, "s"), (None, "A", "CALL", None, "s")]
    events = spark.createDataFrame(rows, kind)
    once = E.event_signals(events, rows=len(rows))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, E.event_signals(events).collect()), key=repr) == [("A", "B", 2, 1, 0, 2, "2026-01-01", "2026-01-02"), ("A", "C", 0, 0, 1, 0, None, None)]
    assert "REPARTITION_BY_NUM" in plan_of(once) and "ENSURE_REQUIREMENTS" not in plan_of(once)  # no second exchange for the sources
