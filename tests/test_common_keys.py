"""A key that most rows have does not put them into one task."""

from pyspark.sql import functions as F

from evgraph.operators import project as P
from evgraph.operators import report as T
from evgraph.operators.numbering import numbered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_case_stay_where_they_are(spark):
    events = spark.range(2000).select((F.col("id") % 3).alias("case_id"), F.col("id").cast("string").alias("person_a"), F.lit("hub").alias("person_b"))
    cases = spark.range(1, 2).withColumnRenamed("id", "case_id")
    found = T.in_scope(events, cases)
    assert "SortMergeJoin" not in plan(found) and found.count() == 667
    persons = P.case_persons(cases, events)
    assert "SortMergeJoin" not in plan(persons) and persons.count() == 668
    edges = events.select(F.col("person_a").alias("src"), F.col("person_b").alias("dst"))
    kept = P.induced(edges, persons)
    assert "SortMergeJoin" not in plan(kept) and kept.count() == 667


def test_numbering_moves_rows_once(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 3001).alias("x"))
    found = numbered(rows, ["k"], ["x"], "n")
    assert plan(found).count("SortMergeJoin") == 0
    by = {}
    for r in sorted(found.collect(), key=lambda r: r["x"]):
        by.setdefault(r["k"], []).append(r["n"])
    assert set(by) == {None, 0, 1} and all(n == list(range(1, len(n) + 1)) for n in by.values())
