"""Scans and sinks (S1-S7). Null texts give no rows; an empty file has no records."""

from __future__ import annotations

import csv
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY_SUFFIX = {"pdf": "pdf", "csv": "csv", "json": "json", "txt": "txt"}


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, size, sha256, content of every file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def content_identity(df: DataFrame, content: str) -> DataFrame:
    """Adds size (bytes) and sha256 of a text column; null counts as empty."""
    c = F.coalesce(F.col(content), F.lit(""))
    return df.withColumn("size", F.octet_length(c).cast("long")).withColumn("sha256", F.sha2(c, 256))


def file_type(filename: Column, head: Column) -> Column:
    """pdf, csv, json or txt by suffix, else json by its first mark, else txt."""
    suffix = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(*BY_SUFFIX), suffix).when(F.ltrim(head).rlike(r"^[{\[]"), "json").otherwise("txt")


def magic_ok(kind: Column, head: Column) -> Column:
    """Whether the first bytes fit the type."""
    lead = F.ltrim(head)
    return F.when(kind == "pdf", lead.startswith("%PDF")).when(kind == "json", lead.rlike(r"^[{\[]")).otherwise(~head.contains("\x00"))


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


#: What a CSV text holds: why it cannot be read, its first record, how many records, and how many of them are not as wide as the first.
CSV_SHAPE = "struct<error: string, header: array<string>, records: int, ragged: int>"

#: Bytes of cells that a task holds as Python objects before it passes them on.
SLICE_BYTES = 4 << 20

#: A line with its end, as Python's text files read it.
LINE = re.compile(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+")


def _csv_reader() -> tuple[Callable[[str], Iterator[list[str]]], Callable[[list[str]], int]]:
    """Functions that give the records of a CSV text one at a time, and the bytes of a record; closures, so that workers need not import this package."""

    def records(text: str) -> Iterator[list[str]]:
        csv.field_size_limit(sys.maxsize)
        for record in csv.reader(m.group() for m in LINE.finditer(text)):
            cells = [cell.strip() for cell in record]
            if any(cells):
                yield cells

    return records, lambda cells: sum(map(len, cells)) + 64 * len(cells)


def csv_shape(text: Column) -> Column:
    """What a CSV text holds (CSV_SHAPE), in one pass that keeps no record but the first; cells and records as in csv_slices; a null text gives nulls."""
    (records_of, cell_bytes), most = _csv_reader(), SLICE_BYTES
    kind = pa.struct({"error": pa.string(), "header": pa.list_(pa.string()), "records": pa.int32(), "ragged": pa.int32()})

    def shape(texts: pa.Array) -> pa.Array:
        done, found, size = [], [], 0
        for text in texts:
            error, header, n, ragged = None, None, 0, 0
            if text.is_valid:
                try:
                    for cells in records_of(text.as_py()):
                        header = cells if header is None else header
                        n, ragged = n + 1, ragged + (len(cells) != len(header))
                except csv.Error as e:
                    error, header, n, ragged = str(e), None, 0, 0
            found.append({"error": error, "header": header, "records": n, "ragged": ragged} if text.is_valid else None)
            size += cell_bytes(header or [])
            if size >= most:
                done, found, size = [*done, pa.array(found, kind)], [], 0
        return pa.concat_arrays([*done, pa.array(found, kind)])

    return F.arrow_udf(shape, CSV_SHAPE)(text)


def csv_slices(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, header, first, records: the records of CSV texts below their first, in slices of some SLICE_BYTES; first is the place of a slice's first record, from 1.

    Commas, doubled quotes and line feeds inside quotes are part of a cell, and a quote inside an unquoted cell is a plain character. Cells are
    trimmed; records whose cells are all blank are left out. A task holds a batch of texts and one slice, however large a text or a batch is.
    """
    (records_of, cell_bytes), most = _csv_reader(), SLICE_BYTES
    row, rows = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))

    def readable(text: str) -> bool:
        try:
            for _ in records_of(text):
                pass
        except csv.Error:
            return False
        return True

    def passed_on(keys: pa.Array, held: list[tuple[int, list[str], int, list[list[str]]]]) -> pa.RecordBatch:
        at, headers, first, records = zip(*held)
        columns = [keys.take(pa.array(at, pa.int32())), pa.array(headers, row), pa.array(first, pa.int32()), pa.array(records, rows)]
        return pa.RecordBatch.from_arrays(columns, ["key", "header", "first", "records"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            held, size = [], 0
            for k, value in enumerate(texts):
                text = value.as_py()
                if text is None or not readable(text):
                    continue
                if size >= most:
                    yield passed_on(keys, held)
                    held, size = [], 0
                header, least, records, own = None, 0, [], 0
                for n, cells in enumerate(records_of(text)):
                    taken = cell_bytes(cells)
                    if header is None:
                        header, least = cells, taken
                        continue
                    if not records:
                        held.append((k, header, n, records))
                        size += least
                    records.append(cells)
                    size, own = size + taken, own + taken
                    if size >= most and own >= least:  # a slice is no smaller than the header it repeats
                        yield passed_on(keys, held)
                        held, size, records, own = [], 0, [], 0
            if held:
                yield passed_on(keys, held)

    strings = T.ArrayType(T.StringType())
    spec = T.StructType().add("key", files.schema[key].dataType).add("header", strings).add("first", T.IntegerType()).add("records", T.ArrayType(strings))
    return files.select(key, text).mapInArrow(slices, spec).withColumnRenamed("key", key)


def csv_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, row_number (from 2, the header being 1), header, cells, n_cells: records of CSV texts, padded or cut to the header's width (S3).

    A text that cannot be read, or has no row below its header, gives no rows (validate_files says why).
    """
    rows = csv_slices(files, key, text).select(key, "header", "first", F.posexplode("records").alias("pos", "body"))
    width = F.size("header")
    padded = F.slice(F.concat("body", F.array_repeat(F.lit(""), F.greatest(width - F.size("body"), F.lit(0)))), 1, width)
    return rows.select(key, (F.col("first") + F.col("pos") + 1).alias("row_number"), "header", padded.alias("cells"), F.size("body").alias("n_cells"))


def text_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, chars, lines of whole texts (S5); null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return files.select(key, t.alias("text"), F.char_length(t).cast("long").alias("chars"), F.size(F.split(t, "\n", -1)).cast("long").alias("lines"))


def json_records(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, record (map of strings, keys lower case with _ for spaces): objects of a JSON array, or one object."""
    t = F.trim(F.col(text))
    whole = F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    items = F.from_json(whole, "array<string>")
    rows = files.select(key, F.posexplode(items).alias("position", "item")).where("ltrim(item) LIKE '{%'")
    record = F.from_json("item", "map<string,string>")
    return rows.select(key, "position", F.transform_keys(record, lambda k, v: F.replace(F.lower(k), F.lit(" "), F.lit("_"))).alias("record"))


def replace_partitions(df: DataFrame, path: str, by: str = "case_id") -> None:
    """Writes df, replacing only the partitions it has rows for; a repeated write leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without_documents(table: DataFrame, retried: DataFrame, column: str = "source_document_id") -> DataFrame:
    """table without the rows that stem from the retried documents."""
    return table.hint("merge").join(retried.select(F.col(column)).distinct().hint("merge"), column, "left_anti")


def merge_by_key(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Upsert (S7): new rows win over old rows of the same key; of several new rows of a key the last in `order` (all columns if none is given). Null keys are left out."""
    cells = F.struct(*[c for c in new.columns if c != key])
    at = F.struct(*(order or [c for c in new.columns if c != key]))
    last = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(cells, at).alias("c"))
    last = last.select(*[F.col(key) if c == key else F.col("c")[c].alias(c) for c in new.columns])
    stays = old.hint("merge").join(last.select(key).hint("merge"), key, "left_anti").where(F.col(key).isNotNull())
    return stays.select(old.columns).unionByName(last)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Merges nodes and edges (each with id) into the tables at path/nodes and path/edges (S7); a repeated write leaves the same tables.

    Each write makes a new version beside the old one and then points to it, so a failed write leaves the old tables.
    """
    spark = nodes.sparkSession
    for name, df in (("nodes", nodes), ("edges", edges)):
        known = read_graph(spark, path, name)
        merged = merge_by_key(df.limit(0) if known is None else known, df, "id")
        version = uuid.uuid4().hex[:12]
        merged.write.parquet(f"{path}/{name}/{version}")
        number = spark.createDataFrame([(version, 0 if known is None else _versions(spark, path, name)[0] + 1)], "version string, number long")
        number.coalesce(1).write.mode("append").parquet(f"{path}/{name}-versions")


def _versions(spark: SparkSession, path: str, name: str) -> tuple[int, str] | None:
    try:
        rows = spark.read.schema("version string, number long").parquet(f"{path}/{name}-versions").orderBy(F.desc("number"), "version").limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return (rows[0]["number"], rows[0]["version"]) if rows else None


def read_graph(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The current nodes or edges at path, or None before the first write."""
    found = _versions(spark, path, name)
    return None if found is None else spark.read.parquet(f"{path}/{name}/{found[1]}")
