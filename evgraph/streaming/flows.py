"""Streaming forms (W1-W5) of the incremental steps, with their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evgraph.operators.relate import OBSERVATIONS
from evgraph.session import as_pattern, shared_dir, stored


#: State of windows on disk: it grows with pairs and days.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def _sorted(parts, by: list[str]) -> pd.DataFrame:
    """The rows of a key in one frame, in order."""
    parts = list(parts)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    return rows if len(rows) == 1 else rows.sort_values(by, kind="stable")


#: Parts that the cases of an ingest are dealt out to.
CASE_BUCKETS = 256


def held_rows(spark: SparkSession, work: str, schema, buckets: list[int]) -> DataFrame:
    """The rows of all batches so far in some buckets of cases; no file of another bucket is opened."""
    chosen = ",".join(map(str, buckets))
    return spark.read.schema(schema).option("basePath", f"{work}/rows").parquet(f"{work}/rows/batch=*/bucket={{{chosen}}}")


def ingest(
    spark: SparkSession, path: str, schema, work: str, build: Callable[[DataFrame], DataFrame], by: str = "case_id", files_per_batch: int | None = None, case: Column | None = None, buckets: int = CASE_BUCKETS
) -> StreamingQuery:
    """New files -> the cases they touch, rebuilt by build() from all their rows so far and written over their partitions.

    case is a row's case before build(), which keeps it as column `by`. With it, every batch files its rows by bucket of their case, and reads back only the
    buckets it touches; without it, all files that lie in path are read for each batch. Earlier rows of a touched case stay, and a repeated
    batch leaves the same table. A null case is a case.
    """
    pattern = as_pattern(path)
    stream = spark.readStream.schema(schema)
    files = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(pattern)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if case is None:
            touched = stored(build(batch).select(F.col(by).alias("__touched")).distinct(), "ingest-touched")
            rows = session.read.schema(schema).parquet(pattern)
        else:
            bucket = F.pmod(F.xxhash64(case), F.lit(buckets)).cast("int")
            batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{work}/rows/batch={number}")
            touched = stored(batch.select(case.alias("__touched"), bucket.alias("bucket")).distinct(), "ingest-touched")
            parts = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # `buckets` numbers at most
            if not parts:
                return
            rows = held_rows(session, work, schema, parts)
        whole = build(rows)
        whole = whole.join(touched, whole[by].eqNullSafe(touched["__touched"]), "left_semi")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{work}/table")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()


def dedup_content(stream: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """First row per key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def failure_windows(log: DataFrame, user: str = "user_id", seconds: int = 900, least: int = 5, success: str | None = None) -> DataFrame:
    """Batch: failures at which a user has `least` or more within the last `seconds`, a failure exactly that old being over.

    log: user, ts, event_id and, if named, success (boolean): a success clears what was counted before it. A user's rows are dealt out by
    spans of `seconds`, each with those of the span before, so that a busy user is spread over many tasks. Rows without a time are left out; null
    users are one user; failures of one moment count for each other unless a success lies between.
    """
    at, size = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    rows = log.withColumn("__at", at).where("__at IS NOT NULL").withColumn("__ok", F.coalesce(F.col(success), F.lit(False)) if success else F.lit(False))
    span = F.floor(F.col("__at") / size)
    rows = rows.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__span", span + F.when(F.col("__own"), 0).otherwise(1))
    by = [user, "__span"]
    rows = rows.withColumn("__since", F.sum(F.col("__ok").cast("int")).over(Window.partitionBy(*by).orderBy("__at", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*by, "__since").orderBy("__at").rangeBetween(1 - size, 0)
    rows = rows.withColumn("failures", F.count_if(~F.col("__ok")).over(w))
    return rows.where(F.col("__own") & ~F.col("__ok") & (F.col("failures") >= least)).select(*log.columns, "failures")


def attempt_keys(log: DataFrame, **columns: str) -> DataFrame:
    """log once for each of the named columns (as user="user_id", address="ip"), with key "user:..." or "address:..." in lower case without outer blanks; null values have none."""
    keys = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:"), F.lower(F.trim(F.col(c).cast("string"))))) for name, c in columns.items()]
    return log.withColumn("key", F.explode(F.array_compact(F.array(*keys))))


def limited_attempts(log: DataFrame, seconds: int = 900, least: int = 5, success: str = "ok", delay: str = "10 minutes") -> DataFrame:
    """Stream: failed attempts (key, event_id, ts) at which their key has `least` or more failures within the last `seconds`; a success clears the key.

    log is that of attempt_keys with key, ts, event_id and success. A key's state holds the times of its failures of the last `seconds` and goes when
    the watermark has passed them. Attempts of one batch are taken in order of time (then event_id); one that comes in a later batch than attempts
    after it counts for those that follow. Rows without a time are left out; a null success is a failure. Equal to failure_windows over the same rows.
    """
    size = seconds * 1_000_000

    def step(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows, out, k = _sorted(parts, ["at", "event_id"]), [], 0
        at, ok, ids = rows["at"].tolist(), rows["ok"].tolist(), rows["event_id"].tolist()
        while k < len(at):
            if ok[k]:
                times, k = [], k + 1
                continue
            end = k
            while end < len(at) and at[end] == at[k] and not ok[end]:
                end += 1
            times = [t for t in times if t > at[k] - size] + at[k:end]
            failures = sum(t <= at[k] for t in times)
            if failures >= least:
                out += [(key[0], i, at[k], failures) for i in ids[k:end]]
            k = end
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max(max(times) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "at", "failures"])

    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL AND key IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("key", "ts", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("at"), F.coalesce(F.col(success), F.lit(False)).alias("ok"))
    found = rows.groupBy("key").applyInPandasWithState(step, "key string, event_id long, at long, failures long", "times array<bigint>", "append", "EventTimeTimeout")
    return found.select("key", "event_id", F.timestamp_micros("at").alias("ts"), "failures")


def failure_stream(log: DataFrame, user: str = "user_id", seconds: int = 900, slide: int = 60, least: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Stream: sliding windows with `least` failures or more per user; late rows are dropped by the watermark."""
    win = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    return log.withWatermark("ts", delay).groupBy(user, win).agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= least)


def rolling_activity(events: DataFrame, keys: list[str], size: str = "1 day", delay: str | None = None) -> DataFrame:
    """Counts per keys and tumbling window of ts, batch or stream."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(*keys, F.window("ts", size)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def rolling_pairs(events: DataFrame, size: str = "1 day", delay: str | None = None) -> DataFrame:
    """The signals of each unordered pair and window: calls, transactions, locations; events have person_a, person_b, event_type and ts."""
    rows = events.where("person_a IS NOT NULL AND person_b IS NOT NULL AND person_a <> person_b")
    rows = rows.withWatermark("ts", delay) if delay else rows
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    sums = [n("CALL").alias("calls"), n("TRANSACTION").alias("transactions"), n(*OBSERVATIONS).alias("locations")]
    found = rows.groupBy(F.least("person_a", "person_b").alias("a"), F.greatest("person_a", "person_b").alias("b"), F.window("ts", size)).agg(*sums)
    return found.select("a", "b", F.col("window.start").alias("start"), "calls", "transactions", "locations")


def maintain_pairs(events: DataFrame, work: str, size: str = "1 day", delay: str = "1 day") -> StreamingQuery:
    """Keeps the signals of pairs up to date from a stream of events: each batch writes the windows that it changed, and no other.

    A window's counts stay in the state until the watermark has passed it; later events of it are dropped. A repeated batch replaces what it wrote.
    """
    counts = rolling_pairs(events, size, delay)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/pairs/batch={number}")

    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pair_windows(spark: SparkSession, work: str) -> DataFrame:
    """a, b, start and counts as they stand after the last batch of maintain_pairs."""
    counts = ["calls", "transactions", "locations"]
    rows = spark.read.schema("a string, b string, start timestamp, calls long, transactions long, locations long, batch int").parquet(f"{work}/pairs")
    last = F.max_by(F.struct(*counts), "batch").alias("c")  # update mode repeats a window in each batch that changed it
    return rows.groupBy("a", "b", "start").agg(last).select("a", "b", "start", *[f"c.{c}" for c in counts])


def pair_totals(spark: SparkSession, work: str) -> DataFrame:
    """a, b and counts over all windows: what relate.event_signals gives for all events so far."""
    return pair_windows(spark, work).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("calls", "transactions", "locations")])


def sync_state(changes: DataFrame, projections: DataFrame, key: str = "case_id") -> DataFrame:
    """PENDING, SYNCING, SYNCED or FAILED per changed case, from its last change and last projection (W5). projections: key, ts, ok (null while it runs)."""
    c = changes.groupBy(key).agg(F.max("ts").alias("changed"))
    p = projections.groupBy(key).agg(F.max(F.struct("ts", "ok")).alias("last"))
    old = F.col("last").isNull() | (F.col("last.ts") < F.col("changed"))
    state = F.when(old, "PENDING").when(F.col("last.ok").isNull(), "SYNCING").when(F.col("last.ok"), "SYNCED").otherwise("FAILED")
    return c.hint("merge").join(p.hint("merge"), key, "left").select(key, state.alias("state"))


def sync_transitions(changes: DataFrame, projections: DataFrame, key: str = "case_id") -> DataFrame:
    """Two streams, of changes (key, ts) and of projections (key, ts, ok: null while it runs), -> the steps that each case takes.

    Rows: key, n (from 1), ts, before (null at first), after. A change makes a case PENDING, the start of a projection SYNCING, its end SYNCED or FAILED. The state
    of a case is its last change and last projection, so rows that come late alter nothing that is newer, and the last `after` is that of sync_state whatever
    the order of arrival. Cases without a change have no state. Null keys or times are left out. A case's state stays as long as the stream does.
    """
    names = {0: "SYNCING", 1: "FAILED", 2: "SYNCED"}

    def step(case, parts, state):
        changed, last, rank, n, now = state.get if state.exists else (None, None, None, 0, None)
        rows, out = _sorted(parts, ["at", "rank"]), []
        for at, r in zip(rows["at"].tolist(), rows["rank"].tolist()):
            if r < 0:
                changed = at if changed is None else max(changed, at)
            elif last is None or (at, r) > (last, rank):
                last, rank = at, r
            after = None if changed is None else "PENDING" if last is None or last < changed else names[rank]
            if after != now:
                n += 1
                out.append((case[0], n, at, now, after))
                now = after
        state.update((changed, last, rank, n, now))
        if out:
            yield pd.DataFrame(out, columns=[key, "n", "at", "before", "after"])

    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    done = F.when(F.col("ok"), 2).when(~F.col("ok"), 1).otherwise(0).cast("int").alias("rank")
    rows = changes.select(key, at, F.lit(-1).cast("int").alias("rank")).unionByName(projections.select(key, at, done)).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    spec, held = f"`{key}` {kind}, n long, at long, before string, after string", "changed bigint, last bigint, rank int, n bigint, now string"
    found = rows.groupBy(key).applyInPandasWithState(step, spec, held, "append", "NoTimeout")
    return found.select(key, "n", F.timestamp_micros("at").alias("ts"), "before", "after")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", arrivals: Sequence[Callable[[], object]] = ()) -> DataFrame:
    """Runs a stream over what there is now into Parquet files and reads them; with arrivals, after each of them over what it brought."""
    spark = stream.sparkSession
    work = shared_dir(spark, name)
    for arrive in arrivals or [lambda: None]:
        arrive()
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")
