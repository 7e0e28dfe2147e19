import math
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from evgraph.llm import quality_rules as R
from evgraph.llm.queries import queries

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries()["op6_rule_ensemble"](spark, MIDDLE)
    both = got.join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in both)
    out = [r for r in both if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(R.fold(F.col("doc_id")) == R.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert R.train(docs, labels) == R.train(docs, turned)


def test_compiled_rules_equal_their_python_form(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    names = ["q_a", "q_b", "q_c"]
    model = R.fit(x, y, names)
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k int, q_a double, q_b double, q_c double")
    got = {r["k"]: r["s"] for r in rows.select("k", model.column(F.struct(*names)).alias("s")).collect()}
    for k, v in enumerate(x):
        at = dict(zip(names, v))
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if all((at[n] > t) == above for n, above, t in rule))
        assert abs(got[k] - 1 / (1 + np.exp(-total))) < 1e-9
    assert np.mean([(got[k] >= 0.5) == y[k] for k in range(len(y))]) > 0.95 and 0 < len(model.rules) < 120


def test_sample_is_bounded_and_thinned(spark):
    stats = spark.range(5000).select(F.col("id").alias("doc_id"), F.rand(1).alias("q_a"))
    labels = stats.select("doc_id", (F.col("q_a") > 0.5).cast("int").alias("quality"))
    docs = stats.select("doc_id", F.col("q_a").cast("string").alias("text"))
    measure = lambda text: F.struct(text.cast("double").alias("q_a"))
    assert len(R.train(docs, labels, sample_rows=500, measure=measure).rules) > 0


def test_defined_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = R.score_documents(odd, labels).collect()
    assert len(got) == odd.count() and len({r["score"] for r in got}) == 1
    assert R.score_documents(none, labels).count() == 0 and R.score_documents(odd, labels.limit(0)).count() == odd.count()
    assert R.keep_good(odd, labels).columns == odd.columns


def slow(text):
    """The statistics of one text, counted word by word and character by character."""
    t = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]
    parts = re.split("[ \n]", t)
    per_char, per_word = (lambda n: n / len(t) if t else 0.0), (lambda n: n / len(words) if words else 0.0)
    echoes = k = 0
    pairs = list(re.finditer("[^ \n]+", t))
    while k + 1 < len(pairs):  # found from left to right, none inside another
        a, b = pairs[k], pairs[k + 1]
        hit = a[0] == b[0] and t[a.end() : b.start()] == " "
        echoes, k = echoes + hit, k + (2 if hit else 1)
    blanks = len(re.findall("[ \t\n\x0b\f\r]+", t))
    pieces = re.split("[ \t\n\x0b\f\r]+", t) if blanks else [t]
    return {
        "q_words": len(words), "q_word_chars": per_word(len(t)), "q_line_words": len(words) / (t.count("\n") + 1),
        "q_capitals": per_char(sum(unicodedata.category(c) == "Lu" for c in t)), "q_symbols": per_char(sum(c in "#*$%&|<>" for c in t)),
        "q_marks": per_char(t.count("!") + t.count("?")), "q_digits": per_char(sum(c in "0123456789" for c in t)),
        "q_stops": per_word(sum(c in ".:;" for c in t)), "q_distinct": per_word(len(set(pieces))), "q_echoes": per_word(echoes),
        "q_short_words": per_word(sum(0 < len(w) <= 2 for w in parts)),
    }


def test_statistics_and_scores_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "a a a a b b\nb b. c  c d\td"), (-2, "A.B! ?;: 12 #*"), (-3, " lead and trail \n"), (-4, "no no no")], "doc_id long, text string")
    docs = docs.unionByName(more).unionByName(odd.select("doc_id", "text"))
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = R.train(docs, labels)
    assert len(model.rules) > 0
    both = docs.select("text", R.statistics(F.col("text")).alias("q")).collect()
    for r in both:
        want = slow(r["text"])
        assert set(want) == set(r["q"].asDict()) and all(abs(want[n] - r["q"][n]) < 1e-9 for n in want), (r["text"] or "")[:80]
    def score(text):
        q = slow(text)
        return 1 / (1 + math.exp(-model.bias - sum(w for rule, w in zip(model.rules, model.weights) if all((q[n] > t) == above for n, above, t in rule))))
    want = sorted((repr(r["doc_id"]), round(score(r["text"]), 6)) for r in docs.collect())
    got = R.score_documents(docs, labels).collect()
    assert sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in got) == want
    good = sorted(x for x, y in want if y >= 0.5)
    assert sorted(repr(r["doc_id"]) for r in R.keep_good(docs, labels).collect()) == good
