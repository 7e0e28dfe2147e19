import math
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from compare import SMALL
from evgraph.llm import language as L
from evgraph.llm.queries import queries


def test_query_agrees_with_addresses(spark):
    got = queries()["op5_language_fusion"](spark, SMALL)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").selectExpr("page_id", r"regexp_extract(url, '//[^/]+/([a-z]{2})/', 1) AS said")
    both = got.join(pages, "page_id").collect()
    assert len(both) == pages.count()
    known = [r for r in both if r["said"]]
    assert sum(r["said"] == r["lang"] for r in known) >= 0.97 * len(known)


def buckets(text):
    """Bucket of every character trigram, with whole numbers alone."""
    c = [32 if ord(x) < 65 else ord(x) for x in f" {text.lower()} "]
    out = []
    for a, b, d in zip(c, c[1:], c[2:]):
        h = ((a * 0x1F35 + b) * 0x2C1B + d) % 2**64
        h ^= h >> 15
        out.append((h * 0x9E3779B1 % 2**64 >> 9) & (L.BUCKETS - 1))
    return out


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, post string")


def test_fusion_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 400").collect()}
    rows = []
    for k in range(30):
        lang = ("de", "fr")[k % 2] if k < 20 else "es"
        body = texts[lang][:60] if k % 3 else ""
        rows.append((k, f"http://h{k % 4}.site{k % 2}.{('com', 'de', 'fr')[k % 3]}/x", f'<html lang="{lang if k % 5 else "xx"}"><body><script>x</script><p>{body}</p></body></html>', "?", "?"))
    got = {r["page_id"]: r for r in L.identify(pages_of(spark, rows), docs).collect()}
    langs = sorted({r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"]})
    counts = {x: Counter() for x in langs}
    for r in docs.collect():
        if r["lang"] and r["text"] is not None:
            counts[r["lang"]].update(buckets(r["text"]))
    table = np.array([[counts[x][b] + L.SMOOTH for b in range(L.BUCKETS)] for x in langs])
    table = np.log(table / table.sum(axis=1, keepdims=True))
    own, host, domain = [], [], []
    for k, url, html, *_ in rows:
        body = html.split("<p>")[1].split("</p>")[0]
        n = np.bincount(buckets("   " + body + "    "), minlength=L.BUCKETS) if body else np.zeros(L.BUCKETS)
        e = table @ n * (L.TEMPER / (L.TEMPER + n.sum()))
        for said, right in ((html.split('"')[1], L.DECLARED_RIGHT), (L.SUFFIXES.get(url.split("/")[2].rsplit(".", 1)[1]), L.SUFFIX_RIGHT)):
            if said in langs:
                e = e + np.array([math.log(right if x == said else (1 - right) / (len(langs) - 1)) for x in langs])
        own.append(e)
        host.append(url.split("/")[2])
        domain.append(".".join(host[-1].split(".")[-2:]))
    post = np.array([np.exp(e - e.max()) / np.exp(e - e.max()).sum() for e in own])
    world = (post.sum(0) + 1) / (len(rows) + len(langs))
    for k in range(len(rows)):
        in_d, in_h = [j for j in range(len(rows)) if domain[j] == domain[k] and j != k], [j for j in range(len(rows)) if host[j] == host[k] and j != k]
        d = (post[in_d].sum(0) + L.HOST_WEIGHT * world) / (len(in_d) + L.HOST_WEIGHT)
        h = (post[in_h].sum(0) + L.HOST_WEIGHT * d) / (len(in_h) + L.HOST_WEIGHT)
        want = own[k] + np.log(h)
        want = np.exp(want - want.max()) / np.exp(want - want.max()).sum()
        assert np.allclose(got[k]["posterior"], want, atol=1e-6), k
        assert got[k]["lang"] == langs[int(np.argmax(want))]


def test_defined_cases(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = pages_of(spark, [(1, None, None, "?", "?"), (2, "", "", "?", "?"), (2, "", "", "?", "?"), (3, "http://a.de/", "<html>", "?", "?"), (None, "x", "<html lang=fr>", "?", "?")])
    got = L.identify(rows, docs).collect()
    assert len(got) == 5 and all(r["lang"] for r in got)
    assert {r["page_id"]: r["lang"] for r in got}[3] == "de" and {r["page_id"]: r["text_lang"] for r in got}[1] is None
    assert L.identify(rows.limit(0), docs).count() == 0
    assert [r["lang"] for r in L.identify(rows, docs.limit(0)).collect()] == [None] * 5


def test_very_long_pages_and_many_languages(spark, monkeypatch):
    """Unclosed tags cost no more than closed ones; languages are met a group at a time; junk is no language."""
    monkeypatch.setattr(L, "GROUP", 16)
    letters = "abcdefg"
    tags = [f"x{a}{b}" for a in letters for b in letters]
    docs = spark.createDataFrame([(t, f"{t}{t} " * 9) for t in tags] + [("English, perhaps", "zzz zzz"), (None, "zzz"), ("xaa-YY", "xaaxaa")], "lang string, text string")
    rows = [(1, None, "<script>" * 20_000 + "a", "?", "?"), (2, None, "<!--" * 20_000 + "<" * 200_000, "?", "?"), (3, None, "<html " * 20_000, "?", "?"), (4, None, "<p>" + "xcdxcd " * 4000, "?", "?"), (5, "http://a.xx/", '<html lang="xbb"><style>p {}</style>', "?", "?")]
    began = time.time()
    got = {r["page_id"]: r for r in L.identify(pages_of(spark, rows), docs).collect()}
    assert time.time() - began < 60 and len(got) == 5 and got[4]["lang"] == got[4]["text_lang"] == "xcd" and got[5]["lang"] == "xbb" and len(got[5]["posterior"]) == len(tags)


def test_visible_text(spark):
    html = ["a<script>b</script>c", "<STYLE x>b</style >c<p>d", "a<!-- <b> -->c", "a<!-- b", "a < b &amp;&lt;", "<scripted>x</scripted>"]
    got = spark.createDataFrame([(x,) for x in html], "html string").select(L.visible_text(F.col("html"))).collect()
    assert [r[0].split() for r in got] == [["a", "c"], ["c", "d"], ["a", "c"], ["a"], ["a", "<", "b", "&<"], ["x"]]
