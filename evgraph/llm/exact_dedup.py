"""Exact deduplication as a stateful stream [native].

A stream over the document files groups rows by the SHA-256 of the normalised text. The keyed state lives in
RocksDB, on disk and checkpointed, and has no watermark, so no key ever expires. Per digest it retains the
stable identifier that stays (the largest), a content locator (file and row of that document, hashed to 64 bits)
and a row count. Memory is bounded by RocksDB's buffers, not by the number of texts. With a `state` folder of its own a later call
goes on from there and reads only files that are new.

On hits (digests that more than one row has) the full bytes are compared: the texts of these rows are read by their locators, equal texts of a
map task become one, and each is held against the one at the digest's locator. Should one digest have several texts, its rows are
grouped again by their bytes.

Defined cases: a null text counts as empty; a null id loses against any other; of repeated rows with the same id
and text exactly one is kept; an empty input gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.llm.common import ascii_lower, column
from evgraph.session import as_pattern, shared_dir, stored

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes of disk
}


#: As many locators are sent to all tasks at once (8 bytes each, and a flag); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = ascii_lower(F.coalesce(column(text_col), F.lit("")))
    return df.select(
        column(id_col).alias("doc_id"),
        norm.alias("norm"),
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("loc"),
    ).withColumn("digest", digest(F.col("norm")))


def _states(spark: SparkSession, path: str, schema, id_col: str, text_col: str, digest, max_bytes: int, work: str) -> DataFrame:
    """The final state of the stream: digest, keep_id, locator, group_size."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        files = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(as_pattern(path))
        state = (
            _rows(files, id_col, text_col, digest)
            .groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.max_by("loc", "doc_id").alias("locator"), F.max("loc").alias("any_loc"), F.count(F.lit(1)).alias("group_size"))
        )

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{work}/states/batch={number}")  # a repeated batch replaces itself

        (
            state.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = _rows(spark.read.schema(schema).parquet(path), id_col, text_col, digest)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    spec = f"digest {kinds['digest']}, keep_id {kinds['doc_id']}, locator long, any_loc long, group_size long, batch int"
    try:
        seen = spark.read.schema(spec).option("basePath", f"{work}/states").parquet(f"{work}/states/*")
    except Exception as e:  # no batch ran: the input has no files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], spec).drop("batch", "any_loc")
    # update mode repeats a key in each batch that changed it; the last one holds
    latest = seen.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "locator", "any_loc", "group_size")).alias("s"))
    return latest.select("digest", "s.keep_id", F.coalesce("s.locator", "s.any_loc").alias("locator"), "s.group_size")


def exact_dedup(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest, max_bytes: int = 64 << 30, state: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet files at path: doc_id, keep_id, group_size, kept, digest.

    state: a shared folder that holds the stream's state from call to call, always for the same path; files may be added to path, not
    changed or removed. Without one, each call starts anew. max_bytes: of files read in one micro-batch.
    """
    docs = spark.read.parquet(path)
    work = (state or shared_dir(spark, "exact-dedup")).rstrip("/")
    states = stored(_states(spark, path, docs.schema, id_col, text_col, digest, max_bytes, work), "exact-dedup-states")
    rows = _rows(docs, id_col, text_col, digest)
    keyed = stored(rows.select("doc_id", "digest", "loc"), "exact-dedup-keys")

    several = stored(states.where("group_size > 1").select("digest", "locator"), "exact-dedup-several")
    hits = keyed.select("digest", "loc").hint("merge").join(several.hint("merge"), "digest")
    hits = stored(hits.select("loc", (F.col("loc") == F.col("locator")).alias("holder")), "exact-dedup-hits")
    how = "merge" if hits.count() > BROADCAST_ROWS else "broadcast"
    texts = _rows(docs, id_col, text_col, digest).select("loc", "norm").join(hits.hint(how), "loc").groupBy("norm").agg(F.bool_or("holder").alias("holder"))
    differ = stored(texts.where("NOT holder").select(digest(F.col("norm")).alias("digest")).distinct(), "exact-dedup-differ")

    found = (
        keyed.hint("merge").join(states.hint("merge"), "digest")
        .select("doc_id", "keep_id", "group_size", (F.col("loc") == F.col("locator")).alias("kept"), "digest")
    )
    if differ.isEmpty():
        return found
    # texts that share a digest without being equal: these few groups are settled by their bytes
    apart = rows.hint("merge").join(differ, "digest", "left_semi")
    by = Window.partitionBy("digest", "norm")
    last = F.row_number().over(by.orderBy(F.desc_nulls_last("doc_id"), "loc")) == 1
    settled = apart.select("doc_id", F.max("doc_id").over(by).alias("keep_id"), F.count(F.lit(1)).over(by).alias("group_size"), last.alias("kept"), "digest")
    return found.hint("merge").join(differ, "digest", "left_anti").select(found.columns).unionByName(settled)
