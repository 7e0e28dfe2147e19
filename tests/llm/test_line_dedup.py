import random
import re

from compare import SMALL
from evgraph.llm.line_dedup import CUT, NOISE_WORDS, SURE_WORDS, dedup_lines
from evgraph.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines(text):
    return [(x.strip(" \t\n\x0b\f\r"), len(WORD.findall(x))) for x in re.split(CUT, text)]


def windows(segments, least):
    """(start, stop, content) of the shortest run from each segment with that many words."""
    for i in range(len(segments)):
        words = 0
        for j in range(i, len(segments)):
            words += segments[j][1]
            if words >= least:
                yield i, j + 1, tuple(x for x, _ in segments[i : j + 1])
                break


def check(docs, after):
    """Every repeat of a run of SURE_WORDS is broken in all but the first document; what is lost repeats a run of NOISE_WORDS."""
    first, again, noisy, repeats = {}, [], {}, {}
    for d, text in docs:
        for i, j, key in windows(lines(text), SURE_WORDS):
            if first.setdefault(key, d) != d:
                again.append((d, key))
        for i, j, key in windows(lines(text), NOISE_WORDS):
            if key in noisy:
                repeats.setdefault(d, []).append(key)
            noisy.setdefault(key, d)
    for d, key in again:
        left = [x for x, _ in lines(after[d])]
        assert all(tuple(left[q : q + len(key)]) != key for q in range(len(left) - len(key) + 1)), d
    for d, text in docs:
        if after[d] != text:
            assert d in repeats
            left = [x for x, _ in lines(after[d])] if after[d] else []
            gone = [x for x, _ in lines(text)]
            for x in left:
                gone.remove(x)
            assert set(gone) <= {x for d2, t2 in docs for x, _ in lines(t2)}
    return len(again)


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r["doc_id"]: r["text"] for r in queries()["op7_line_dedup"](spark, SMALL).collect()}
    assert len(got) == len(docs) and check(docs, got) > 0


def test_shared_passages_in_any_surroundings(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [[fresh(rng.randint(1, 30)) for _ in range(rng.randint(3, 9))] for _ in range(6)] + [[fresh(55)]]
    docs = []
    for d in range(60):
        parts = [fresh(rng.randint(1, 20)) for _ in range(rng.randint(0, 4))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 2)
            parts += p[cut:] + [""] * rng.randint(0, 2) + [fresh(rng.randint(1, 9))]
        docs.append((d, "\n".join(parts)))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert check(docs, got) > 20


def test_extension_covers_the_whole_run_and_short_lines_stay(spark):
    run = [f"line {k} " + " ".join(f"t{k}x{j}" for j in range(12)) for k in range(10)]
    docs = [(1, "\n".join(["head", *run, "tail one"])), (2, "\n".join(["other", *run, "tail two"])), (3, "head"), (4, "\n".join(run[:2]))]
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), removed_col="gone").collect()}
    assert got[1] == (docs[0][1], 0) and got[2] == ("other\ntail two", 10) and got[3] == ("head", 0) and got[4] == (docs[3][1], 0)


def test_repeats_within_a_document(spark):
    p = " ".join(f"p{k}" for k in range(60))
    got = dedup_lines(spark.createDataFrame([(1, f"a\n{p}\nb\n{p}\nc\n{p}")], "doc_id long, text string")).first()
    assert got["text"] == f"a\n{p}\nb\nc"


def test_defined_cases(odd, none):
    got = dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    same = got.where("doc_id <> 11 OR doc_id IS NULL")
    assert same.exceptAll(odd).count() == 0
    assert dedup_lines(none).count() == 0


def test_documents_that_share_thousands_of_lines(spark):
    """Long texts with the same lines, and long texts of different ones: work in proportion to the lines."""
    shared = [f"line {k} of a text that two documents share word by word" for k in range(12_000)]
    own = [f"line {k} of a text that only one document has at all" for k in range(12_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["first"] + shared)), (3, "\n".join(own))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "first", 3: rows[2][1]}
