"""Every stage of the pipeline over nulls, empty and very long texts, repeated rows, and columns whose names clash or hold dots."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from compare import SMALL


def test_stages_over_odd_texts(spark, odd):
    docs = odd.withColumns({"a.b": F.lit("?"), "__removed": F.lit("?"), "__row": F.lit("?")}).withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in P.STAGES:
        got = stage(spark, docs, SMALL)
        if name == "best_fit_packing":
            assert got.where("doc_id IS NULL").count() >= 2 and got.agg(F.max("length")).first()[0] <= 2048
        else:
            assert got.columns == docs.columns and 0 < got.count() <= docs.count()


def test_later_copy_of_a_near_copy_goes(spark):
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(3, text), (1, text.replace("w50", "x")), (2, text), (None, text), (4, None), (5, None), (6, "other words here")], "doc_id long, text string")
    got = [r["doc_id"] for r in P.STAGES[2][1](spark, docs, SMALL).collect()]
    assert sorted(got) == [1, 4, 6]
