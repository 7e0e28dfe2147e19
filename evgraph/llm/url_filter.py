"""URL filter: rules first, else naive Bayes over the words of host and path.

1. Rules (host, path) fit their host and its subdomains where the url's path starts with theirs; the longest wins.
2. Host names are cut into words: runs of letters of all hosts, each once, are segmented by unigram Viterbi. Word counts come from the visible text of
   all pages. Every substring of a run that may be a word meets the counts in a join, so the vocabulary stays distributed.
3. Multinomial naive Bayes learns from the urls that rules decide: words of the segmented host and of the path, each in one of BUCKETS hashed cells, so
   the model is bounded whatever the vocabulary. Counts are sums over all such urls; hosts are counted before their words are.
4. A host's score is computed once and joined to its urls; the path's is added inside tasks. Weights are whole numbers, so sums do not depend on order.

Defined cases: a null url, or one without "://", has empty host and path and is judged by the prior of the classes; a run of more than 63 letters is no name
(a label has 63 at most) and stays one word; without urls of one class the prior alone, smoothed, decides; ties are allowed; null html has
no words; repeated rows each give a row; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import ascii_lower, column
from evgraph.llm.language import visible_text
from evgraph.session import stored

LABEL, LONGEST, BUCKETS, UNIT, FLUSH = 63, 20, 1 << 18, 1 << 20, 1 << 18
ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first "://" up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, or null; of equally long ones the first in code-point order."""
    found = F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.lit(name + start)).otherwise(found)
    return found


def runs(host: Column) -> Column:
    """The runs of letters of a host."""
    return F.regexp_extract_all(host, F.lit("[a-z]+"), 0)


def path_words(path: Column) -> Column:
    """Words of a path: letters (A-Z in lower case) and other characters beyond ASCII; any number is one word."""
    return F.regexp_extract_all(F.regexp_replace(ascii_lower(path), "[0-9]+", " 0 "), F.lit(r"[a-z0\x{80}-\x{10ffff}]+"), 0)


def text_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): lower-case a-z words of LONGEST letters at most in the visible text of all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for pdf in batches:
            for words in pdf["words"]:
                total.update(words.tolist())
            if len(total) > FLUSH:
                yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                total.clear()
        if total:
            yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})

    bare = ascii_lower(visible_text(F.coalesce(column(html_col), F.lit(""))))
    words = pages.select(F.regexp_extract_all(bare, F.lit(rf"(?<![\p{{L}}])[a-z]{{1,{LONGEST}}}(?![\p{{L}}])"), 0).alias("words"))
    return words.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def best_words(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of run: known has the counts of its substrings (start, length); others cost more with each letter. Ties: the longer last word."""
    if len(run) > LABEL:
        return [run]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for size in range(1, end + 1):
            n = known.get((end - size, size))
            cost = math.log(n / total) if n else math.log(10.0 / max(1, total)) - size * math.log(10.0)
            options.append((best[end - size][0] + cost, size))
        best.append(max(options))
    out, end = [], len(run)
    while end:
        size = best[end][1]
        out.append(run[end - size : end])
        end -= size
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """names (run), words (word, n) -> run, parts: each run with its likeliest words."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length("run")))
    pieces = names.where(F.char_length("run") <= LABEL).select("run", F.explode(sizes).alias("size"))
    pieces = pieces.select("run", "size", F.explode(F.sequence(F.lit(1), F.char_length("run") - F.col("size") + 1)).alias("at"))
    pieces = pieces.select("run", "at", "size", F.substring("run", F.col("at"), F.col("size")).alias("word"))
    met = pieces.hint("merge").join(words.hint("merge"), "word").select("run", F.struct((F.col("at") - 1).alias("at"), "size", "n").alias("piece"))
    met = stored(met, "url-pieces").groupBy("run").agg(F.collect_list("piece").alias("pieces"))  # LABEL x LONGEST at most
    rows = names.hint("merge").join(stored(met, "url-known").hint("merge"), "run", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [{(p["at"], p["size"]): p["n"] for p in found} if found is not None else {} for found in pdf["pieces"]]
            yield pd.DataFrame({"run": pdf["run"], "parts": [best_words(r, k, total) for r, k in zip(pdf["run"], known)]})

    return rows.mapInPandas(cut, "run string, parts array<string>")


def _cell(kind: str, word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), word), F.lit(BUCKETS)).cast("int")


def weights(counts: DataFrame, urls: tuple[int, int]) -> tuple[int, np.ndarray]:
    """counts (cell, allow, block) and the numbers of urls of either class -> prior and every cell's weight, in units of 1 / UNIT: above zero speaks for block."""
    n = np.ones((2, BUCKETS))
    for r in counts.collect():  # BUCKETS rows at most
        n[:, r["cell"]] += r["allow"], r["block"]
    log = np.log(n / n.sum(axis=1, keepdims=True))
    return round(UNIT * math.log((urls[1] + 1) / (urls[0] + 1))), np.rint(UNIT * (log[1] - log[0])).astype(np.int64)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds for block of the method, for every url)."""
    spark, url = pages.sparkSession, F.coalesce(column(url_col), F.lit(""))
    rows = pages.select(column(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    says = {name + start: verdict for verdict, name, start in rules}
    ruled = lambda verdict: F.coalesce(F.col("rule").isin([r for r, v in says.items() if v == verdict]), F.lit(False))
    rows = stored(rows.withColumn("by_rule", F.when(ruled(ALLOW), ALLOW).when(ruled(BLOCK), BLOCK)), "url-rows")
    words = stored(text_words(pages, html_col), "url-words")

    both = [F.count_if(F.col("by_rule") == v).alias(v) for v in (ALLOW, BLOCK)]
    hosts = stored(rows.groupBy("host").agg(*both), "url-hosts")
    named = hosts.select("host", ALLOW, BLOCK, F.explode(runs(F.col("host"))).alias("run"))
    parts = stored(segmented(stored(named.select("run").distinct(), "url-runs"), words), "url-parts")
    named = named.hint("merge").join(parts.hint("merge"), "run").select("host", ALLOW, BLOCK, F.explode("parts").alias("word"))
    named = stored(named.select("host", ALLOW, BLOCK, _cell("host", F.col("word")).alias("cell")), "url-host-words")
    of_path = rows.where("by_rule is not null").select("by_rule", F.explode(path_words(F.col("path"))).alias("word"))
    of_path = of_path.select(_cell("path", F.col("word")).alias("cell"), *[(F.col("by_rule") == v).cast("long").alias(v) for v in (ALLOW, BLOCK)])
    counts = named.select("cell", ALLOW, BLOCK).unionByName(of_path).groupBy("cell").agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK))
    prior, weight = weights(counts, tuple(hosts.agg(*[F.coalesce(F.sum(v), F.lit(0)) for v in (ALLOW, BLOCK)]).first()))
    shared = spark.sparkContext.broadcast(weight)  # 8 x BUCKETS bytes

    def of_host(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "host_score": shared.value[pdf["cell"].to_numpy()]})

    scores = named.select("host", "cell").mapInPandas(of_host, "host string, host_score long")
    scores = stored(scores.groupBy("host").agg(F.sum("host_score").alias("host_score")), "url-host-scores")
    found = rows.hint("merge").join(scores.hint("merge"), "host", "left")
    cells = F.transform(path_words(F.col("path")), lambda w: _cell("path", w)).alias("cells")
    found = found.select("page_id", "host", "path", "rule", "by_rule", (F.coalesce("host_score", F.lit(0)) + prior).alias("score"), cells)

    def with_path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["score"] += [int(shared.value[np.asarray(c, np.int64)].sum()) for c in pdf.pop("cells")]
            yield pdf

    kind = rows.schema["page_id"].dataType.simpleString()
    found = found.mapInPandas(with_path, f"page_id {kind}, host string, path string, rule string, by_rule string, score long")
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("score") / UNIT).alias("score"))
