import corpus_pipeline as P
from compare import SMALL
from evgraph.llm.secrets import scan
from evgraph.session import stored
from test_near_dedup import kept as kept_of_all_pairs


def test_stages_in_order_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    seen = {"documents": docs}
    for name, stage in P.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SMALL), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.dtypes == before.dtypes and docs.count() <= before.count()
    kept = {r["doc_id"] for r in seen["quality_classifier"].collect()}
    assert sum(labels[d] == 1 and d not in kept for d in labels) <= 0.03 * len(labels)
    assert seen["line_dedup"].count() == seen["quality_classifier"].count()
    texts = [(r["doc_id"], r["text"]) for r in seen["line_dedup"].orderBy("doc_id").collect()]
    want, _ = kept_of_all_pairs([(d, (t or "").lower()) for d, t in texts])
    assert {r["doc_id"] for r in seen["simhash_near_dedup"].collect()} == want
    assert scan(seen["secret_scan"]).where("size(spans) > 0").count() == 0
    assert seen["secret_scan"].where("n_chars <> char_length(text)").count() == 0
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in seen["secret_scan"].collect()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.count() == 0


def test_run(spark):
    assert P.run(spark, SMALL).groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
