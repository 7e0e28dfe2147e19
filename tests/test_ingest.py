"""A later file that touches a case keeps the case's earlier rows."""

import pytest
from pyspark.sql import functions as F

from evgraph.streaming import flows as W


@pytest.mark.parametrize("case", [None, "c"])
def test_two_batches_touch_one_case(spark, tmp_path, case):
    path, work = f"{tmp_path}/in", f"{tmp_path}/work"
    build = lambda df: df.select("document", F.col("c").alias("case_id"))
    kind = "document long, c string"

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        W.ingest(spark, path, spark.read.parquet(path).schema, work, build, case=case and F.col(case)).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("document long, case_id string").parquet(f"{work}/table").select(F.coalesce("case_id", F.lit("-")), "document").collect())

    assert arrive([(1, "a"), (2, "a"), (3, "b"), (4, None)]) == [("-", 4), ("a", 1), ("a", 2), ("b", 3)]
    assert arrive([(5, "a"), (6, None)]) == [("-", 4), ("-", 6), ("a", 1), ("a", 2), ("a", 5), ("b", 3)]


def test_a_batch_reads_only_the_cases_it_touches(spark, tmp_path):
    path, work, kind = f"{tmp_path}/in", f"{tmp_path}/work", "document long, c string"
    seen = []

    def build(df):
        seen.append(sum(f.count("/bucket=") for f in df.inputFiles()))
        return df.groupBy(F.col("c").alias("case_id")).agg(F.count("document").alias("n"), F.max("document").alias("last"))

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        W.ingest(spark, path, spark.read.parquet(path).schema, work, build, case=F.col("c")).awaitTermination()
        return {r["case_id"]: (r["n"], r["last"]) for r in spark.read.schema("case_id string, n long, last long").parquet(f"{work}/table").collect()}

    want = {f"case{k}": (1, k) for k in range(100)}
    assert arrive([(k, f"case{k}") for k in range(100)]) == want
    assert arrive([(500, "case7"), (501, "case7")]) == want | {"case7": (3, 501)}
    assert seen[0] > 60 and seen[1] == 2  # one bucket, of both batches
    spark.read.parquet(f"{work}/table").where("case_id = 'case7'").count()
    assert arrive([(502, "new")]) == want | {"case7": (3, 501), "new": (1, 502)}
