"""Best-fit packing of documents into token sequences.

Every piece has three demands that follow from its length: tokens (n), documents (1) and attention cost (n squared, for
attention within documents). Pieces of one length are alike, so the plan is made from the histogram of lengths, which
has at most `max_tokens` rows whatever the size of the corpus: lengths go from long to short, and each is placed in the
open bins with the smallest weighted norm of what is left over (or the largest weighted dot-product of demand and
residual), under every constraint, before new bins are opened. Bins with the same history are one range of sequence
numbers, so a plan row places a whole range of pieces.

The corpus itself stays distributed: tasks encode the texts, pieces are numbered within (length, bucket), and a
prefix sum over the buckets of each length turns that into a rank, which the plan maps to sequence and offset. A length that holds a third of
all pieces is spread over all buckets.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed each; an empty
table gives an empty result; only texts of more than `max_tokens` ids are cut; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import id_and_text
from evgraph.llm.encoding import encoder
from evgraph.session import stored


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold, and how much each residual weighs in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    by: str = "norm"  # or "dot"


def pieces_of(docs: DataFrame, path: str, max_tokens: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (int array)."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * max_tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            at, rows, kept = [], [], []
            for k, ids in enumerate(enc.encode_all(pdf["text"])):
                ids += end
                for n, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    at.append(k)
                    rows.append((n, a // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        kept.append(np.frombuffer(part, np.int32))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy()[at])
            if with_ids:
                out["ids"] = kept
            yield out

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(lengths: dict[int, int], cap: Capacity) -> pd.DataFrame:
    """Histogram of lengths -> rows (length, rank, copies, sequence, offset).

    Pieces of that length from `rank` on go to the sequences from `sequence` on, `copies` to each, the first at `offset`.
    """
    size = np.array([cap.tokens, cap.documents, cap.cost], float)
    weights = np.array(cap.weights)
    left = np.empty((64, 3))  # residual of each range of bins
    first, bins, fill = (np.zeros(64, np.int64) for _ in range(3))
    used, sequences, out = 0, 0, []
    for length in sorted(lengths, reverse=True):
        need, rank, todo = np.array([length, 1, length * length], float), 0, lengths[length]
        fit_new = int((size // need).min())
        if fit_new < 1:
            raise ValueError(f"a piece of {length} tokens exceeds a bin's capacities")
        while todo:
            fits = np.flatnonzero((left[:used] >= need).all(axis=1) & (bins[:used] > 0))
            if len(fits):
                copies = np.minimum((left[fits] // need).min(axis=1), todo)
                if cap.by == "dot":
                    score = -((left[fits] / size) * (need / size) * weights).sum(axis=1)
                else:
                    score = ((((left[fits] - copies[:, None] * need) / size) ** 2) * weights).sum(axis=1)
                best = int(np.argmin(score))
                k, each = int(fits[best]), int(copies[best])
                take = max(1, min(int(bins[k]), todo // each))
                base, room, at = int(first[k]), left[k].copy(), int(fill[k])
                first[k] += take
                bins[k] -= take
            else:
                each = min(fit_new, todo)
                take = max(1, todo // each)
                base, room, at = sequences, size.copy(), 0
                sequences += take
            out.append((length, rank, each, base, at))
            placed = take * each
            rank, todo = rank + placed, todo - placed
            free = np.flatnonzero(bins[:used] == 0)
            if len(free):
                k = int(free[0])
            else:
                if used == len(bins):
                    left = np.concatenate([left, np.empty_like(left)])
                    first, bins, fill = (np.concatenate([x, np.zeros_like(x)]) for x in (first, bins, fill))
                k, used = used, used + 1
            left[k], first[k], bins[k], fill[k] = room - each * need, base, take, at + each * length
    return pd.DataFrame(out, columns=["length", "rank", "copies", "sequence", "offset"]).astype("int64")


def pack(pieces: DataFrame, cap: Capacity, rows_per_bucket: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), a stored table."""
    buckets = max(256, pieces.count() // rows_per_bucket)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    steps = plan(totals, cap).sort_values(["length", "rank"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("within", within).hint("merge").join(before, ["length", "bucket"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "bucket"], (F.col("before") + F.col("within") - 1).alias("rank"))

    top = int(steps["rank"].max() or 0) + max(totals.values(), default=0) + 1 if len(steps) else 1
    plan_keys = (steps["length"] * top + steps["rank"]).to_numpy()
    columns = {c: steps[c].to_numpy() for c in ("rank", "copies", "sequence", "offset")}
    shared = pieces.sparkSession.sparkContext.broadcast((plan_keys, columns, top))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, col, base = shared.value
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            k = np.searchsorted(keys, length * base + rank, side="right") - 1
            nth = rank - col["rank"][k]
            pdf["sequence_id"] = col["sequence"][k] + nth // col["copies"][k]
            pdf["offset"] = col["offset"][k] + nth % col["copies"][k] * length
            yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, cap: Capacity = Capacity(), end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, cuts and packs: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(stored(pieces_of(docs, path, cap.tokens, end_id, with_ids, id_col, text_col), "packing-pieces"), cap)
