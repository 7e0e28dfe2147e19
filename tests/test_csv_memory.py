"""Texts of CSV files, however large, are passed on in slices."""

from pyspark.sql import functions as F

from evgraph.operators import quality as Q
from evgraph.sources import files as S


def test_large_texts_arrive_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 20_000)
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.concat(x.cast("string"), F.lit(',"a\nb"'))), "\r\n")
    wide = F.array_join(F.array_repeat(F.lit("column"), 5000), ",")
    files = spark.range(3).select("id", F.when(F.col("id") == 0, F.concat(F.lit("n,x\n"), lines)).when(F.col("id") == 1, F.concat(wide, F.lit("\n1\n2\n3"))).otherwise("n\n\n , \n7").alias("text")).coalesce(1)
    held = S.csv_slices(files, "id", "text").select("id", "first", F.size("records").alias("n"), F.size(F.flatten("records")).alias("cells")).collect()
    assert sum(r["n"] for r in held) == 3004 and max(r["n"] for r in held if r["id"] == 0) < 300
    assert len([r for r in held if r["id"] == 1]) == 1  # slices are no smaller than the header that they repeat
    rows = S.csv_rows(files, "id", "text")
    assert str(rows._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1 and "EvalPython" not in str(rows._jdf.queryExecution().executedPlan())  # read by one worker, once
    got = {(r["id"], r["row_number"]): (r["cells"], r["n_cells"]) for r in rows.collect()}
    assert len(got) == 3004 and all(got[0, k + 1] == ([str(k), "a\nb"], 2) for k in range(1, 3001))
    assert got[1, 4] == (["3"] + [""] * 4999, 1) and got[2, 2] == (["7"], 1)
    found = {r["id"]: (r["errors"], r["warnings"]) for r in Q.validate_files(files.withColumn("kind", F.lit("csv"))).collect()}
    assert found == {0: ([], []), 1: ([], ["duplicate headers", "ragged rows"]), 2: ([], [])}


def test_wide_headers_with_one_row_each(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 20_000)
    wide = F.array_join(F.array_repeat(F.lit("column"), 1000), ",")
    files = spark.range(0, 20, 1, 1).select("id", F.concat(wide, F.lit("\n"), F.col("id").cast("string")).alias("text"))
    assert {(r["id"], r["cells"][0]) for r in S.csv_rows(files, "id", "text").collect()} == {(k, str(k)) for k in range(20)}
