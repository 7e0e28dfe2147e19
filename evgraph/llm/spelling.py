"""Spelling variants: words that differ by one edit, found in a trie of letter-group counts.

1. Words: runs of letters of every text, counted inside tasks and then by word. A run may be damaged on purpose (`noise`), as the contract of
   op11 asks; noise=0 leaves all runs alone.
2. Vectors: letters fall into GROUPS groups (code point modulo GROUPS); a word's vector holds how many of its letters each group has. One edit
   changes a vector by a surplus of one in at most one group and a deficit of one in at most one other.
3. Trie: words are arranged by the successive counts of their vectors. The top `depth` levels are Spark's: a word is held by the node of its own
   prefix, and goes as a query to every node that the budget reaches. The other levels are a trie inside a task, where all queries of a node
   go down together, depth first, and a branch ends when no query can pay for it. Words at leaves are verified letter by letter.
4. Each pair is met once: from the word whose vector is less at the first level where they differ (of equal vectors, from the lesser word), so a
   deficit can be spent only after the surplus. A task returns each word's count and best near word, never pairs.

`depth` follows the words: the fewest levels at which no node holds more than `unit` words. Where even whole vectors do, a node is
divided into chunks of about `unit` words and its queries go to each chunk, so no word is left out and no task holds more.

Defined cases: null text has no words; a null id counts as empty in the noise; repeated rows count each; a word without near words has n_near 0
and is its own root; of near words with equal counts the least in code-point order is the form; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import id_and_text
from evgraph.session import stored

LETTERS, NOISE, MIN_LENGTH, MIN_COUNT, RATIO = "a-zA-ZÀ-ÿ", 199, 6, 5, 5
GROUPS, UNIT, LEAF, ASK, LONG, TASK_ROWS, FLUSH, SLICE = 16, 2048, 32, 1024, 32, 1 << 20, 1 << 18, 1 << 22


def slices(text: str, boundary: re.Pattern, size: int = SLICE) -> Iterator[str]:
    """A very long text in parts that end where boundary matches."""
    at = 0
    while len(text) - at > size:
        found = boundary.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): how often each word of min_length letters or more occurs in all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, boundary = re.compile(f"[{LETTERS}]{{{min_length},}}"), re.compile(f"[^{LETTERS}]")
        total: Counter[str] = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
                begin = crc32(f"{doc_id}:".encode())
                for part in slices(lower, boundary):
                    for run, n in Counter(word.findall(part)).items():
                        if noise and not (h := crc32(run.encode(), begin)) % noise:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < min_length:
                                continue
                        total[run] += n
                if len(total) > FLUSH:
                    yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                    total.clear()
        if total:
            yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})

    rows = id_and_text(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def group_counts(word: Column) -> list[Column]:
    """How many letters of word each group has."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    group = lambda g: "".join(x for x in letters if ord(x) % GROUPS == g)
    return [(F.char_length(word) - F.char_length(F.translate(word, group(g), ""))).cast("int") for g in range(GROUPS)]


def best_depth(vectors: DataFrame, unit: int) -> tuple[int, int]:
    """(depth, words of its largest node): the fewest levels of the trie at which no node holds more than unit words, or all."""
    names = [f"v{g}" for g in range(GROUPS)]
    per = vectors.select(*[F.col("v")[g].alias(x) for g, x in enumerate(names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    level = F.lit(GROUPS) - F.bit_count(F.grouping_id(*names))
    nodes = per.rollup(*names).agg(F.sum("n").alias("n"), level.alias("level"))
    most = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.max("n").alias("n")).collect()}  # one row a level
    return next(((k, most.get(k, 0)) for k in range(1, GROUPS) if most.get(k, 0) <= unit), (GROUPS, most.get(GROUPS, 0)))


def _letters(words: np.ndarray, right: bool) -> np.ndarray:
    """Words of LONG letters at most as rows of bytes (their letters are Latin-1), aligned left or right."""
    adjust = str.rjust if right else str.ljust
    return np.array([adjust(w, LONG, "\0").encode("latin-1") for w in words], f"S{LONG}").view(np.uint8).reshape(-1, LONG)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced or, where it is longer by one, inserted. a differs from b."""
    n = len(a)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), n)
    return a[i + 1 :] == b[i + 1 :] if len(b) == n else a[i:] == b[i + 1 :]


class Words:
    """Words that are compared letter by letter, many pairs at once: what two words share at both ends leaves one edit between."""

    def __init__(self, words: np.ndarray):
        self.word, self.size = words, np.array([len(w) for w in words])
        short = np.where(self.size <= LONG, words, "")
        self.left, self.right = _letters(short, False), _letters(short, True)

    def one_edit(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """Whether the words at j of other are those at i with one letter replaced or inserted; no pair is of equal words."""
        before = (self.left[i] != other.left[j]).argmax(axis=1)
        after = (self.right[i] != other.right[j])[:, ::-1].argmax(axis=1)
        near = before + after >= other.size[j] - 1
        for k in np.flatnonzero(other.size[j] > LONG):
            near[k] = one_edit(self.word[i[k]], other.word[j[k]])
        return near


def descend(held: np.ndarray, query: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search of all queries through the trie of held vectors (rows in order) -> places (held, query) of pairs within the budget."""
    levels = held.shape[1]
    stack = [(0, len(held), 0, np.arange(len(query)), surplus, deficit)]
    while stack:
        low, high, level, who, plus, minus = stack.pop()
        if high - low <= LEAF or level == levels - 1:  # a leaf: what is left of its words' vectors is compared at once
            more = held[low:high, None, level:] - query[None, who, level:]
            up, down = more == 1, more == -1
            fits = (abs(more).max(axis=2, initial=0) <= 1) & (up.sum(axis=2) <= plus) & (down.sum(axis=2) <= minus)
            first_up = np.where(up.any(axis=2), up.argmax(axis=2), np.where(plus == 0, -1, levels))
            first_down = np.where(down.any(axis=2), down.argmax(axis=2), levels)
            h, q = np.nonzero(fits & ((first_up < first_down) | (~down.any(axis=2))))
            if len(h):
                yield low + h, who[q]
            continue
        count = held[low:high, level]
        edge = [0, *(np.flatnonzero(np.diff(count)) + 1).tolist(), high - low]
        asked = query[who, level]
        for a, b in zip(edge, edge[1:]):
            step = count[a] - asked
            live = (step == 0) | ((step == 1) & (plus == 1)) | ((step == -1) & (plus == 0) & (minus == 1))
            if live.any():
                step = step[live]
                stack.append((low + a, low + b, level + 1, who[live], plus[live] - (step == 1), minus[live] - (step == -1)))


class Node:
    """The held words of one node (or chunk of one), against which its queries come batch by batch."""

    def __init__(self, rows: pd.DataFrame):
        v = np.stack(rows["v"].to_numpy()).astype(np.int32)
        order = np.lexsort(v.T[::-1])
        self.v, self.n, self.words = v[order], rows["n"].to_numpy()[order], Words(rows["word"].to_numpy()[order])

    def near(self, rows: pd.DataFrame) -> Iterator[tuple[str, int, str, int]]:
        """(word, n, near word, its n) of each pair, once, in either order."""
        v, n, words = np.stack(rows["v"].to_numpy()).astype(np.int32), rows["n"].to_numpy(), Words(rows["word"].to_numpy())
        plus, minus = rows["surplus"].to_numpy(), rows["deficit"].to_numpy()
        for h, q in _joined(descend(self.v, v, plus, minus)):
            same = (plus[q] == 1) & (self.v[h] == v[q]).all(axis=1)
            once = ~same | (words.word[q] < self.words.word[h]).astype(bool)
            h, q = h[once], q[once]
            near = words.one_edit(q, self.words, h)
            h, q = h[near], q[near]
            yield from zip(words.word[q], n[q].tolist(), self.words.word[h], self.n[h].tolist())


def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small pairs of arrays -> larger ones."""
    held, many = [], 0
    for part in parts:
        held.append(part)
        many += len(part[0])
        if many >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, many = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of unit, held words before queries -> each word's number of near words and the best of them, for each batch."""
    unit, held, node = None, [], None
    for pdf in batches:
        best: dict[str, tuple[int, int, str]] = {}
        edges = np.flatnonzero(np.append(True, np.diff(pdf["unit"].to_numpy()) != 0)).tolist()
        for a, b in zip(edges, [*edges[1:], len(pdf)]):
            part = pdf.iloc[a:b]
            if part["unit"].iloc[0] != unit:
                unit, held, node = part["unit"].iloc[0], [], None
            asks = part["asks"].to_numpy()
            if not asks.all():
                held.append(part[~asks])
            if asks.any() and held:
                if node is None:
                    node = Node(pd.concat(held))
                queries = part[asks]
                for k in range(0, len(queries), ASK):
                    for one, n, other, m in node.near(queries.iloc[k : k + ASK]):
                        for word, more, form in ((one, m, other), (other, n, one)):
                            so_far, less, known = best.get(word, (0, 1, ""))
                            best[word] = (so_far + 1, *min((less, known), (-more, form)))
        if best:
            yield pd.DataFrame([(word, count, form, -less) for word, (count, less, form) in best.items()], columns=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, unit: int = UNIT) -> DataFrame:
    """words (word, n) -> word, n_near, form, form_n for every word that has a near word: how many, and the one of largest n (ties: the least)."""
    vectors = stored(words.select("word", "n", F.array(*group_counts(F.col("word"))).alias("v")), "spelling-vectors")
    depth, most = best_depth(vectors, unit)
    chunks = F.lit(max(1, -(-most // unit)))
    add = lambda i, j: F.array(*[F.col("v")[k] + (1 if k == i else -1 if k == j else 0) for k in range(depth)])
    step = lambda i, j, plus, minus: F.struct(add(i, j).alias("to"), F.lit(plus).alias("surplus"), F.lit(minus).alias("deficit"))
    reach = [step(-1, -1, 1, 1), *[step(i, -1, 0, 1) for i in range(depth)], *[step(i, j, 0, 0) for i in range(depth) for j in range(i + 1, depth)]]
    rest = F.concat(F.slice("v", depth + 1, GROUPS), F.array(F.lit(0))).alias("v")  # never empty
    asked = vectors.select("word", "n", "v", F.explode(F.filter(F.array(*reach), lambda x: F.array_min(x["to"]) >= 0)).alias("r"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    asked = asked.select(F.xxhash64("r.to", "chunk").alias("unit"), F.lit(True).alias("asks"), "word", "n", rest, "r.surplus", "r.deficit")
    own = F.xxhash64(F.slice("v", 1, depth), F.pmod(F.xxhash64("word"), chunks).cast("int")).alias("unit")
    held = vectors.select(own, F.lit(False).alias("asks"), "word", "n", rest, F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), vectors.count() * len(reach) // TASK_ROWS)
    met = held.unionByName(asked).repartition(parts, "unit").sortWithinPartitions("unit", "asks")
    found = met.mapInPandas(_compare, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that forms lead to. Counts rise along forms, so there are no cycles; each pass doubles the way."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.hint("merge").join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        at = moved.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, unit: int = UNIT) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word's more usual spelling, one edit away and at least `ratio` times as frequent, and the last of such forms."""
    words = stored(word_counts(docs, id_col, text_col, noise, min_length).where(F.col("n") >= min_count), "spelling-words")
    near = stored(near_words(words, unit), "spelling-near")
    found = words.hint("merge").join(near.hint("merge"), "word", "left")
    usual = F.col("form_n") >= F.col("n") * ratio
    found = found.select("word", F.when(usual, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("form_n")).alias("form_n"))
    found = stored(found, "spelling-forms")
    last = roots(found.where("form is not null"))
    return found.hint("merge").join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
