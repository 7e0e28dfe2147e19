"""Quality rules: repetition coverage.

Per text, word ids are rolled into 64-bit hashes of n words for several n in numpy (the hash of n+1 words from
that of n), and the characters that lie inside n-grams found twice or more are measured; so are those in repeated
lines. Duplicate hashes are compared word by word, so a chance collision never counts. n-grams of n+1 words can
only repeat where those of n do, hence most texts stop at the first length.

The verdict uses the limits published for web text with the MassiveText corpus: share of characters in duplicate n-grams
(n = 5..10), of lines and of characters in duplicate lines.

Defined cases: a null or empty text has no words (all counts 0, base_failed, not kept); every input row gives one row;
a text of any length is read whole; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from evgraph.llm.common import id_and_text

#: Published limits, n of the n-gram -> largest share of characters.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, worst_share double"


def _repeats(rolled: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of n ids that occur twice or more."""
    order = np.argsort(rolled, kind="stable")
    h = rolled[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return order[:0]
    a, b = order[:-1][same], order[1:][same]
    if all((ids[a + k] == ids[b + k]).all() for k in range(n)):
        return np.unique(np.concatenate([a, b]))
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)  # a collision: settle it by the ids themselves
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return np.flatnonzero(counts[inverse.ravel()] > 1)


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n that begins at one of starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, max_repeat_percent: int = 20, min_words: int = 10) -> tuple:
    """The values of FIELDS for one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII blanks
    n_words, word_chars = len(words), len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    distinct = set(lines)
    n_dup_lines = len(lines) - len(distinct)

    worst = 0.0  # the largest share in relation to its limit; over 1 fails
    if n_dup_lines:
        chars = sum(map(len, lines))
        worst = max(n_dup_lines / len(lines) / LINE_LIMIT, (chars - sum(map(len, distinct))) / chars / LINE_CHARS_LIMIT)
    n_repeat = 0
    if n_words > 5:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
        if len(seen) < n_words - 4:  # each of two equal windows of 5 repeats 5 words, or overlaps itself
            rolled, sizes = ids, None
            with np.errstate(over="ignore"):
                for n in range(2, max(NGRAM_LIMITS) + 1):
                    if n > n_words - 1:
                        break
                    rolled = rolled[:-1] * FACTOR + ids[n - 1 :]
                    if n < min(NGRAM_LIMITS):
                        continue
                    starts = _repeats(rolled, ids, n)
                    if not len(starts):
                        break
                    inside = _covered(starts, n, n_words)
                    if n == 5:
                        n_repeat = int(inside.sum())
                    if sizes is None:
                        sizes = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words])
                    worst = max(worst, float(sizes[inside].sum()) / word_chars / NGRAM_LIMITS[n])
    failed = n_words < min_words or 100 * n_repeat > max_repeat_percent * n_words
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, not failed and worst <= 1.0, worst


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and FIELDS; worst_share is the largest measured share over its limit."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([measure(t) for t in pdf["text"]], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIELDS}")
