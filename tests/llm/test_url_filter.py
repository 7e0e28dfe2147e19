"""The URL filter against a plain version of it, and odd urls."""

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evgraph.llm import url_filter as U
from evgraph.llm.language import visible_text
from evgraph.llm.queries import URL_RULES, queries
from evgraph.session import importable_by_workers
from tests.compare import SMALL

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, score string, cell string, word string, run string"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return lower(host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(n + p, v) for v, n, p in URL_RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def every_cut(run):
    for mask in range(1 << (len(run) - 1)):
        at = [0, *[k + 1 for k in range(len(run) - 1) if mask >> k & 1], len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def segment(run, count, total):
    """Plain dynamic program over whole words."""
    if len(run) > 63:
        return [run]
    cost = lambda w: math.log(count[w] / total) if count.get(w) else math.log(10 / max(1, total)) - len(w) * math.log(10)
    best = {0: (0.0, [])}
    for end in range(1, len(run) + 1):
        best[end] = max(((best[a][0] + cost(run[a:end]), best[a][1] + [run[a:end]]) for a in range(end)), key=lambda x: (x[0], len(x[1][-1])))
    return best[len(run)][1]


def cell(kind, word):
    h = xxhash.xxh64_intdigest(word.encode(), xxhash.xxh64_intdigest(kind.encode(), 42))
    return (h - (1 << 64) if h >> 63 else h) % U.BUCKETS


def words_of_path(path):
    return re.findall("[a-z0\x80-\U0010ffff]+", re.sub("[0-9]+", " 0 ", lower(path)))


def brute(rows, texts):
    count = Counter(w for t in texts for w in re.findall(r"(?<![^\W\d_])[a-z]{1,20}(?![^\W\d_])", lower(t)))
    total = sum(count.values())
    found, tokens, urls, seen = [], np.ones((2, U.BUCKETS)), [1, 1], {}
    for page_id, url in rows:
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        for run in re.findall("[a-z]+", host):
            if run not in seen:
                seen[run] = segment(run, count, total)
        cells = [cell("host", w) for run in re.findall("[a-z]+", host) for w in seen[run]] + [cell("path", w) for w in words_of_path(path)]
        found.append((page_id, host, path, rule, verdict, cells))
        if verdict:
            k = verdict == "block"
            urls[k] += 1
            np.add.at(tokens[int(k)], cells, 1)
    log = np.log(tokens / tokens.sum(axis=1, keepdims=True))
    weight, prior = np.rint(U.UNIT * (log[1] - log[0])).astype(int), round(U.UNIT * math.log(urls[1] / urls[0]))
    out = []
    for page_id, host, path, rule, verdict, cells in found:
        score = prior + int(weight[cells].sum()) if cells else prior
        out.append((page_id, host, path, rule, verdict or ("block" if score > 0 else "allow"), score / U.UNIT))
    return sorted(out, key=str)


def test_equals_plain_version(spark):
    importable_by_workers(spark)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = pages.select("page_id", "url", visible_text(F.coalesce("html", F.lit(""))).alias("t")).collect()
    got = queries()["op12_url_filter"](spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r["page_id"], r["url"]) for r in rows], [r["t"] for r in rows])
    assert any(r["rule"] is None for r in got) and any(r["rule"] for r in got)


def test_viterbi_is_the_best_of_all_cuts():
    count = {"cheap": 50, "pills": 20, "pill": 30, "s": 5, "he": 90, "a": 100, "ap": 3}
    total = sum(count.values())
    for run in ("cheappills", "cheapills", "hepa", "zzcheap", "a", "pillspills"):
        known = {(a, b - a): count[run[a:b]] for a in range(len(run)) for b in range(a + 1, len(run) + 1) if run[a:b] in count}
        cost = lambda ws: sum(math.log(count[w] / total) if w in count else math.log(10 / total) - len(w) * math.log(10) for w in ws)
        assert math.isclose(cost(U.best_words(run, known, total)), max(map(cost, every_cut(run))))
    assert U.best_words("cheappills", {(0, 5): 50, (5, 5): 20, (5, 4): 30}, total) == ["cheap", "pills"]
    assert U.best_words("x" * 64, {}, 0) == ["x" * 64]


def test_odd_urls(spark):
    importable_by_workers(spark)
    urls = [
        None, "", "no scheme", "http://", "http:///en/", "HTTP://A.Example.COM", "http://a.com/", "http://example.com/en/x", "http://www.example.com/en/", "http://x.www.example.com/en/1?a=/es/",
        "http://notexample.com/en/", "http://net/es/", "http://b.net/es", "http://b.net/es/#/fr/", "http://b.net?x=/es/", "a://b://c.net/fr/", "http://ÉCOLE.net/fr/é", "x://h\n.net/fr/\n?", "http://" + "a" * 5000 + ".org/" + "w/" * 5000,
        "http://b.org/es/", "http://b.org/es/", "http://c.net/es/casino", "http://casino.org/", "://com/",
    ]
    html = ["<p>casino example words</p>", None, ""]
    rows = [(None if k == 4 else k, u, html[k % 3], *["?"] * 7) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = [r[0] for r in df.select(visible_text(F.coalesce("html", F.lit("")))).collect()]
    assert sorted((tuple(r) for r in U.judge_urls(df, URL_RULES).collect()), key=str) == brute([(r[0], r[1]) for r in rows], texts)
    assert U.judge_urls(df.limit(0), URL_RULES).count() == 0
    bare = U.judge_urls(df.where("url is null or url not like '%://%'"), URL_RULES).collect()
    assert {(r["host"], r["path"], r["rule"], r["verdict"]) for r in bare} == {("", "", None, "allow")}


def test_learned_words_decide_other_hosts(spark):
    importable_by_workers(spark)
    rows = [(k, f"http://cheappills{k}.net/es/", "<p>cheap pills good books garden</p>") for k in range(20)]
    rows += [(100 + k, f"http://goodbooks{k}.com/", "<p>good books</p>") for k in range(20)]
    rows += [(200, "http://buycheappills.org/", ""), (201, "http://mygoodbooks.org/", "")]
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert (got[200], got[201]) == ("block", "allow")
