"""Parts of a stream arrive as several files, in order of time."""

from pathlib import Path

from pyspark.sql import functions as F

from evgraph.plans import analysis as A
from evgraph.streaming import flows as W


def test_a_part_is_not_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "shared_dir", lambda *_: str(tmp_path / "in"))
    rows = spark.range(0, 8000, 1, 4).select("id", F.timestamp_seconds(F.col("id") * 7919 % 8000).alias("ts"))
    stream, arrivals = A._in_order(spark, rows, "ts", "rows")
    files = lambda: len(list(Path(tmp_path / "in").glob("*.parquet")))
    before = files()
    arrivals[0]()
    assert files() - before > 1
    found = W.run_to_table(stream, "arrived", arrivals=arrivals[1:])
    assert found.count() == 8000 == found.select("id").distinct().count()
