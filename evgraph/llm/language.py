"""Language ID by Bayesian fusion of text, declaration, address and host.

The log evidence of a page for each language is the sum of
- the text's: hashed character trigrams against counts that grouped aggregation takes from all documents of known language; long
  texts are tempered, as their trigrams are not independent;
- the declared markup language's and the address suffix's, each as a report that is right with a stated probability;
- the host's prior, smoothed hierarchically: host towards registered domain towards all pages. Its counts are the posteriors of
  the host's other pages before the host is considered, so a page never votes for itself.

A language is a primary tag of two or three letters, so stray values of the column are no languages. Counts are languages x BUCKETS whatever the
corpus; the texts meet GROUP languages at a time, so neither the driver nor a task holds more than GROUP x BUCKETS of them. Hosts stay
distributed (partial sums, then a merge join that AQE can split).

Markup is removed in one walk: scripts and styles run to the next tag of either kind (or the end), comments to their end, and a tag that is not closed before the next "<" is text.

Defined cases: null or empty html has no text evidence; a missing or unknown declaration, suffix or host is no evidence
(pages without a host share the prior of all pages); declared languages such as "de-AT" count by their first part; every page gives one row; ties go to the alphabetically first language;
without documents of known language, or pages, the result is empty or null-languaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, let
from evgraph.session import stored

BUCKETS, TEMPER, SMOOTH, GROUP = 1 << 15, 60.0, 0.5, 64
DECLARED_RIGHT, SUFFIX_RIGHT, HOST_WEIGHT = 0.9, 0.8, 8.0
#: Country suffix -> its main language.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def _trigrams(text: str) -> np.ndarray:
    """Bucket of every character trigram."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c[c < 65] = 32  # digits, marks and blanks alike
    h = (c[:-2] * np.uint64(0x1F35) + c[1:-1]) * np.uint64(0x2C1B) + c[2:]
    h ^= h >> np.uint64(15)
    return (h * np.uint64(0x9E3779B1) >> np.uint64(9)).astype(np.int64) & (BUCKETS - 1)


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all documents of known language; a task counts GROUP languages at a time."""

    def cells(total: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if lang not in total and len(total) == GROUP:
                    yield from cells(total)
                    total.clear()
                n = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                n += np.bincount(_trigrams(text), minlength=BUCKETS)
        yield from cells(total)

    tag = F.lower(F.regexp_extract(column(lang_col), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    rows = docs.select(tag.alias("lang"), column(text_col).alias("text")).where("lang <> '' AND text IS NOT NULL")
    return rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(bucket | language) for some languages: dense rows of BUCKETS, from trigram_counts."""
    rows = counts.where(F.col("lang").isin(langs)).toPandas()  # len(langs) x BUCKETS at most
    table = np.full((len(langs), BUCKETS), SMOOTH)
    table[np.searchsorted(langs, rows["lang"].to_numpy(object).astype(str)), rows["bucket"]] += rows["n"]
    return np.log(table / table.sum(axis=1, keepdims=True))


def visible_text(html: Column) -> Column:
    mark = r"(?i)<(?=/?(?:script|style)\b)"
    pieces = F.transform(F.split(html, mark, -1), lambda x, k: F.when((k > 0) & ~x.startswith("/"), " ").when(k > 0, F.concat(F.lit("<"), x)).otherwise(x))
    bare = F.regexp_replace(F.array_join(pieces, ""), r"(?s)<!--.*?(?:-->|\z)|<[^<>]*+>", " ")
    for mark, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(mark), F.lit(letter))
    return bare


def _report(said: Column, langs: list[str], right: float) -> Column:
    """Log likelihood of a reported language under each language; zeros if it says nothing known."""
    wrong = (1 - right) / max(1, len(langs) - 1)
    heard = lambda x: F.when(said == x, float(np.log(right))).otherwise(float(np.log(wrong)))
    return F.when(F.array_contains(F.lit(langs), said), F.transform(F.lit(langs), heard)).otherwise(F.array_repeat(F.lit(0.0), len(langs)))


def _normal(logs: Column) -> Column:
    """Log evidence -> probabilities."""
    shifted = let(F.array_max(logs), lambda most: F.transform(logs, lambda x: F.exp(x - most)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return let(shifted, lambda values: let(total(values), lambda t: F.transform(values, lambda x: x / t)))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, declared, suffix, text_lang (by text alone), lang, confidence, posterior (in order of languages)."""
    counts = stored(trigram_counts(docs), "language-trigrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # tags of two or three letters
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    if not langs:
        return pages.select(column(id_col).alias("page_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("host", "string"), ("declared", "string"), ("suffix", "string"), ("text_lang", "string"), ("lang", "string"), ("confidence", "double"), ("posterior", "array<double>"))])

    def likelihood(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logp = shared.value
            for pdf in batches:
                out = []
                for text, known in zip(pdf["text"], pdf["by_text"]):
                    n = np.bincount(_trigrams(text), minlength=BUCKETS) if text and text.strip() else np.zeros(BUCKETS)
                    at = np.flatnonzero(n)
                    total = n[at].sum()
                    out.append([*known, *((logp[:, at] @ n[at]) * (TEMPER / (TEMPER + total)) if total else np.zeros(len(logp)))])
                pdf["by_text"] = out
                yield pdf

        return run

    html, url = F.coalesce(column(html_col), F.lit("")), F.coalesce(column(url_col), F.lit(""))
    none = lambda c: F.when(c != "", c)
    rows = pages.select(
        column(id_col).alias("page_id"),
        none(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))).alias("host"),
        none(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z]+)""", 1))).alias("declared"),
        visible_text(html).alias("text"), F.array().cast("array<double>").alias("by_text"),
    )
    for k in range(0, len(langs), GROUP):
        shared = spark.sparkContext.broadcast(text_model(counts, langs[k : k + GROUP]))
        rows = rows.mapInPandas(likelihood(shared), f"page_id {kind}, host string, declared string, text string, by_text array<double>")
        if k + GROUP < len(langs):
            rows = stored(rows, "language-likelihoods")
    rows = rows.drop("text")
    suffix = F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([a-z]+)$", 1)
    suffix_lang = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    own = add(add(F.col("by_text"), _report(F.col("declared"), langs, DECLARED_RIGHT)), _report(suffix_lang, langs, SUFFIX_RIGHT))
    rows = rows.select("page_id", "host", "declared", none(suffix).alias("suffix"), "by_text", own.alias("own"), F.coalesce(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))
    rows = stored(rows.withColumn("post", _normal(F.col("own"))), "language-evidence")

    cells = rows.where("host is not null").select("host", "domain", F.posexplode("post").alias("k", "p"))
    cells = stored(cells.groupBy("host", "domain", "k").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")), "language-hosts")
    total = lambda *by: cells.groupBy(*by, "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])  # one cell per language
    everything = {r["k"]: r for r in total().collect()}  # one row per language
    count = everything[0]["n"] if everything else 0
    world = [((everything[k]["s"] if everything else 0.0) + 1.0) / (count + len(langs)) for k in range(len(langs))]
    domains = total("domain").groupBy("domain").agg(gathered.alias("domain_sums"), F.max("n").alias("domain_n"))
    hosts = cells.groupBy("host", "domain").agg(gathered.alias("host_sums"), F.max("n").alias("host_n")).hint("merge").join(domains.hint("merge"), "domain").drop("domain")
    hosts = stored(hosts, "language-priors")

    found = rows.hint("merge").join(hosts.hint("merge"), "host", "left")
    less = lambda sums: F.zip_with(sums, "post", lambda s, p: F.greatest(s - p, F.lit(0.0)))  # noqa: E731  the page itself doesn't count
    smoothed = lambda sums, n, towards: F.zip_with(less(sums), towards, lambda s, q: (s + HOST_WEIGHT * q) / (n - 1 + HOST_WEIGHT))
    base = F.lit(world)
    prior = F.when(F.col("host_n").isNull(), base).otherwise(smoothed(F.col("host_sums"), F.col("host_n"), smoothed(F.col("domain_sums"), F.col("domain_n"), base)))
    names = F.lit(langs)
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    found = found.withColumn("posterior", _normal(F.zip_with("own", prior, lambda x, p: x + F.log(p))))
    heard = F.array_max("by_text") != F.array_min("by_text")
    return found.select("page_id", "host", "declared", "suffix", F.when(heard, best(F.col("by_text"))).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), "posterior")
