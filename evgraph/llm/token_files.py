"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the whole corpus, so the frequent ones are small. Each rank takes 1 to 4 bytes in
the data stream; a control byte beside it holds four 2-bit byte counts. Both directions are numpy table look-ups over
whole blocks. A block holds the documents of consecutive order up to `block_ids` ids and is one row of the output
files (Parquet as the container, so that any store Spark writes to will do): shard, block, doc_ids, counts, control, data. The
vocabulary's ranking is a second small table beside them.

Shards are ranges of (doc_id, text hash), blocks ascend within a shard, documents within a block. What passes the
driver is the ranking (as many rows as the vocabulary has ids) and the range bounds.

Defined cases: a null or empty text has the end id alone; null ids come first; rows with one id follow the hash of their ids; repeated
rows are written each; an empty table gives empty files; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import id_and_text
from evgraph.llm.encoding import encoder
from evgraph.session import stored

#: LENGTHS[control byte] = the byte counts of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def _taken(sizes: np.ndarray, width: int) -> np.ndarray:
    """Which of the width cells of each value are stored, column by column."""
    taken = np.empty((len(sizes), width), bool)
    for k in range(width):
        taken[:, k] = sizes > k
    return taken


def squeeze(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks -> control bytes, data bytes."""
    width = 2 if not len(ranks) or ranks.max() <= 0xFFFF else 4  # of the cells that are looked at; the bytes are the same
    ranks = ranks.astype(f"<u{width}")
    codes = (ranks > 0xFF).view(np.uint8)
    if width == 4:
        codes = codes + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    cells = ranks.view(np.uint8).reshape(-1, width)
    return control.tobytes(), cells[_taken(codes + 1, width)].tobytes()


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of squeeze()."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    width = 2 if not n or sizes.max() <= 2 else 4
    cells = np.zeros((n, width), np.uint8)
    cells[_taken(sizes, width)] = np.frombuffer(data, np.uint8)
    return cells.view(f"<u{width}").reshape(-1)


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie, width, ids: the ids as little-endian unsigned integers of 2 bytes, or 4 for vocabularies that need them.

    A task's last row has no ids but `counts`: how often it has seen each id, as 8-byte integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        end, size = int(end_id).to_bytes(4, "little"), max(enc.vocab_size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        total = np.zeros(size, np.int64)
        for pdf in batches:
            whole = [ids + end for ids in enc.encode_all(pdf["text"])]
            packed = [np.frombuffer(x, "<u4").astype(kind) for x in whole]
            for ids in packed:
                if len(ids) > 1 << 16:
                    total += np.bincount(ids, minlength=size)
            small = [ids for ids in packed if len(ids) <= 1 << 16]
            for k in range(0, len(small), 1024):
                total += np.bincount(np.concatenate(small[k : k + 1024]), minlength=size)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "width": int(kind[-1]), "tie": [zlib.crc32(x) for x in whole], "ids": [x.tobytes() for x in packed], "counts": None})
        yield pd.DataFrame({"doc_id": [None], "width": 0, "tie": 0, "ids": None, "counts": [total.astype("<i8").tobytes()]})

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, width int, tie long, ids binary, counts binary")


def ranking(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, by falling count; as many rows as there are distinct ids."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for pdf in batches:
            for raw in pdf["counts"]:
                n = np.frombuffer(raw, "<i8").copy()
                n[: len(total)] += total
                total = n
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    counts = tokens.where("counts is not null").select("counts").mapInPandas(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "id").select("id", "n")


def write_files(tokens: DataFrame, ranks: pd.DataFrame, path: str, block_ids: int = 1 << 16, block_docs: int = 4096) -> None:
    """Writes tokens (of encoded()) to path in ascending order of doc_id."""
    spark = tokens.sparkSession
    of = np.zeros(int(ranks["id"].max()) + 1 if len(ranks) else 1, np.uint32)
    of[ranks["id"].to_numpy()] = np.arange(len(ranks), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(of)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.where("ids is not null").select("doc_id", "tie", "width", "ids").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number, size = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ids: list[np.ndarray] = []

        def block() -> pd.DataFrame:
            control, data = squeeze(rank_of.value[np.concatenate(ids)])
            return pd.DataFrame({"shard": [shard], "block": [number], "n_ids": [size], "doc_ids": [docs], "counts": [[len(x) for x in ids]], "control": [control], "data": [data]})

        for pdf in batches:
            for doc, width, raw in zip(pdf["doc_id"], pdf["width"], pdf["ids"]):
                docs.append(None if pd.isna(doc) else doc)
                ids.append(np.frombuffer(raw, f"<u{width}"))
                size += len(ids[-1])
                if size >= block_ids or len(docs) >= block_docs:
                    yield block()
                    docs, ids, number, size = [], [], number + 1, 0
        if docs:
            yield block()

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = ordered.mapInPandas(blocks, f"shard int, block int, n_ids long, doc_ids array<{kind}>, counts array<int>, control binary, data binary")
    rows.write.mode("overwrite").option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str, ranks: pd.DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of every document in the files."""
    files = spark.read.parquet(path)
    id_of = spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = id_of.value[expand(row.control, row.data, row.n_ids)]
                ends = np.cumsum(row.counts)
                docs = [ids[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
                out = pd.DataFrame({
                    "doc_id": pd.Series(list(row.doc_ids), dtype=object), "shard": row.shard, "block": row.block, "within": ends - np.asarray(row.counts),
                    "n_tokens": np.asarray(row.counts, np.int64), "ids_crc32": [zlib.crc32(x.tobytes()) for x in docs],
                })
                if with_ids:
                    out["ids"] = [x.astype(np.int64) for x in docs]
                yield out

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    docs = files.mapInPandas(decode, f"doc_id {kind}, shard int, block int, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)

    heads = files.select("shard", "block", "n_ids")
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", before.alias("shard_start"))  # one row per shard
    above = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = heads.withColumn("above", above).hint("merge").join(shards, "shard").select("shard", "block", (F.col("above") + F.col("shard_start")).alias("block_start"))
    found = docs.hint("merge").join(starts, ["shard", "block"])
    return found.select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """Encodes docs into files at out_path; the ranking needed to read them is written to out_path-ranks and returned."""
    tokens = stored(encoded(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    ranks = ranking(tokens).toPandas()  # no more rows than the vocabulary
    docs.sparkSession.createDataFrame(ranks, "id long, n long").write.mode("overwrite").parquet(f"{out_path}-ranks")
    write_files(tokens, ranks, out_path)
    return ranks
