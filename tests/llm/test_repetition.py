import re

from hypothesis import given, settings
from hypothesis import strategies as st

from compare import SMALL
from evgraph.llm.queries import queries
from evgraph.llm.repetition import NGRAM_LIMITS, measure, repetition_rules

BLANKS = " \t\n\v\f\r"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))

    def inside(n):
        starts = {}
        for k in range(len(words) - n + 1):
            starts.setdefault(tuple(words[k : k + n]), []).append(k)
        return {k + j for at in starts.values() if len(at) > 1 for k in at for j in range(n)}

    n_repeat, chars = len(inside(5)), sum(map(len, words))
    failed = len(words) < 10 or 100 * n_repeat > 20 * len(words)
    shares = [sum(len(words[k]) for k in inside(n)) / chars / limit for n, limit in NGRAM_LIMITS.items()] if chars else []
    if lines:
        total = sum(map(len, lines))
        shares += [dup / len(lines) / 0.3, sum(len(x) for k, x in enumerate(lines) if x in lines[:k]) / total / 0.2]
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, n_repeat, failed, not failed and max(shares, default=0) <= 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cé", "#", "\n", " ", "d e", "a b c d e", "\t", "\u00a0", "a b c d e f g h\n"]), max_size=60))
def test_measure_equals_brute_force(parts):
    text = " ".join(parts)
    assert measure(text)[:7] == slow(text)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries()["op4_repetition_rules"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == slow(docs[r["doc_id"]])


def test_clean_documents_stay(spark):
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lost = [r for r in repetition_rules(docs).where("NOT kept AND NOT base_failed").collect() if r["doc_id"] in labels]
    assert not lost


def test_defined_cases(odd, none):
    got = repetition_rules(odd).collect()
    assert len(got) == odd.count() and repetition_rules(none).count() == 0
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert [r["kept"] for r in got if r["doc_id"] == 4] == [True] and [r["n_dup_lines"] for r in got if r["doc_id"] == 11] == [2999]
