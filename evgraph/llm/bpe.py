"""BPE encoding and decoding by contiguous rank arrays.

A pre-split word is held as two contiguous arrays: its parts (token ids between boundaries) and the merge rank of every adjacent
pair. The smallest rank is found by scanning, its boundary deleted, and the ranks of the two neighbours refreshed,
until no pair can merge. Words of more than SCAN parts use the same arrays as a linked list with a heap of ranks, so
that a text of one endless word stays near linear.

The normalisation, splitting and special tokens of the lower-casing word vocabulary (NFC, white space, lower case; words, single digits,
runs of other characters) are done here as well; the tokenizers library is not used. Ids of frequent chunks are remembered
per worker within a bound.

Defined cases: a null or empty text has no tokens (n_tokens 0, hashes of the empty string); other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from evgraph.llm.common import id_and_text
from evgraph.llm.encoding import BLANK, LOWERS, MARKS, Memo, byte_letters

SCAN, NEVER, WORD_ROOM = 96, 1 << 30, 500_000


class RankBpe:
    """A vocabulary file's merges, applied by rank arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()}
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + suffix] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.blanks = regex.compile(f"[{BLANK}]+")
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
        self.ids_of, self.text_of = Memo(self._ids_text, WORD_ROOM), Memo(self._decoded_text, WORD_ROOM)
        self.words = Memo(self.merge, WORD_ROOM)

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.final[raw[-1]])
        merges, none = self.merges, (NEVER, 0)
        ranks = [merges.get(pair, none)[0] for pair in zip(parts, parts[1:])]
        if len(parts) > SCAN:
            return self._merge_long(parts, ranks)
        while ranks and (least := min(ranks)) < NEVER:
            k = ranks.index(least)
            parts[k : k + 2] = [merges[parts[k], parts[k + 1]][1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = merges.get((parts[k], parts[k + 1]), none)[0]
            if k:
                ranks[k - 1] = merges.get((parts[k - 1], parts[k]), none)[0]
        return parts

    def _merge_long(self, parts: list[int], ranks: list[int]) -> list[int]:
        n, merges, none = len(parts), self.merges, (NEVER, 0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, r in enumerate(ranks) if r < NEVER]
        heapq.heapify(heap)
        ranks.append(NEVER)
        while heap:
            rank, k = heapq.heappop(heap)
            if ranks[k] != rank:
                continue
            gone = after[k]
            parts[k] = merges[parts[k], parts[gone]][1]
            ranks[gone] = -1
            after[k] = right = after[gone]
            if right < n:
                before[right] = k
            for left in (k, before[k]):
                if left >= 0:
                    ranks[left] = merges.get((parts[left], parts[after[left]]), none)[0] if after[left] < n else NEVER
                    if ranks[left] < NEVER:
                        heapq.heappush(heap, (ranks[left], left))
        k, out = 0, []
        while k < n:
            out.append(parts[k])
            k = after[k]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.at_special.split(text)):
            if k % 2:
                out.append(self.special[part])
                continue
            part = self.blanks.sub(" ", unicodedata.normalize("NFC", part))
            part = part.replace("Σ", "σ").lower()  # letter by letter: no final form
            for word in self.split.findall(part):
                out += self.words[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: its tokens, joined by spaces."""
        return " ".join([self.names[i] for i in ids])

    def _chunk_ids(self, chunk: str) -> list[int]:
        """encode(), without its general steps for a plain word and a mark behind it."""
        word = chunk[:-1] if chunk[-1:] in MARKS else chunk
        if not (word.isalpha() and word.isascii()):
            return self.encode(chunk)
        ids = self.merge(word.lower())
        return ids if word is chunk else ids + self.words[chunk[-1]]

    def _ids_text(self, chunk: str) -> bytes:
        return " ".join(map(str, self._chunk_ids(chunk))).encode()

    def _decoded_text(self, chunk: str) -> bytes:
        names = self.names
        return " ".join([names[int(x)] for x in self.ids_of[chunk].split()]).encode("utf-8", "surrogatepass")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count and the hashes of the ids' text and of the decoded text."""
        if "<|" not in text and (text.isascii() or LOWERS.fullmatch(text)):
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        ids = b" ".join(filter(None, map(self.ids_of.__getitem__, chunks)))
        decoded = b" ".join(filter(None, map(self.text_of.__getitem__, chunks)))
        return ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def rank_bpe(path: str) -> RankBpe:
    return RankBpe(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded: the encoded and the decoded whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = rank_bpe(path)
        for pdf in batches:
            ids = [bpe.encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = rank_bpe(path)
        for pdf in batches:
            out = pd.DataFrame([bpe.digest(t) for t in pdf["text"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
