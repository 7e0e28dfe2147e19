"""Spelling variants against all pairs of words, and odd cases."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evgraph.llm import spelling
from evgraph.session import importable_by_workers
from tests.compare import SMALL


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(words, ratio=5):
    near = {w: [x for x in words if edits(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def counted(rows, noise=199):
    c = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % noise == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if n >= 5 and len(w) >= 6}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("unit", [2048, 3])  # 3: whole vectors are divided into chunks as well
def test_equals_all_pairs(spark, unit):
    importable_by_workers(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60 if unit == 3 else 1000)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = got(spelling.spelling_variants(docs, unit=unit))
    assert found == expected(counted(rows)) and len(found) > 100


def test_chains_ties_and_long_words(spark):
    importable_by_workers(spark)
    long = "x" * 40 + "abc" * 300
    counts = {"colours": 700, "colour": 100, "colouri": 25, "colourin": 5, "alphas": 30, "alphat": 30, "alphaé": 6, long: 30, long + "y": 5, "b" * 5000: 5, "b" * 4999: 25}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = got(spelling.spelling_variants(docs, noise=0))
    assert found == expected(counts)
    assert found["colourin"][:2] == ("colouri", "colours")
    assert found["alphaé"][0] == "alphas" and found[long + "y"][0] == long


def test_odd_rows_and_empty_table(spark, odd, none):
    importable_by_workers(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(spelling.spelling_variants(odd)) == expected(counted(rows))
    assert spelling.spelling_variants(none).count() == 0


def test_slices_keep_runs_whole():
    boundary = re.compile("[^a-z]")
    text = "abc def" * 50 + "z" * 300 + " tail"
    parts = list(spelling.slices(text, boundary, 20))
    assert "".join(parts) == text and len(parts) > 3
    assert re.findall("[a-z]+", text) == [w for p in parts for w in re.findall("[a-z]+", p)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=25, unique=True))
def test_trie_finds_each_pair_once(words):
    size = 4
    v = np.array([[sum(ord(x) % size == g for x in w) for g in range(size)] + [0] for w in words])
    order = np.lexsort(v.T[::-1])
    held, one = v[order], np.ones(len(words), int)
    met = Counter()
    for h, q in spelling.descend(held, v, one, one):
        for i, j in zip(order[h].tolist(), q.tolist()):
            if (v[i] != v[j]).any() or words[j] < words[i]:
                met[frozenset((words[i], words[j]))] += 1
    assert set(met.values()) <= {1}
    assert all(frozenset((a, b)) in met for a in words for b in words if edits(a, b))
