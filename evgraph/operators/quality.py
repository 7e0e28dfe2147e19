"""Import quality (Q1-Q11). Null texts count as empty; tables without rows give reports without rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.session import stored
from evgraph.sources.files import csv_shape

MAX_BYTES = 25 * 1024 * 1024
#: Canonical field -> header cells that name it, in order of precedence of the fields.
ALIASES = {
    "caller_name": ["caller_name", "caller", "calling_name", "calling_party", "calling_party_name", "source_name", "from_name", "name_a", "party_a_name", "a_name", "aname", "caller_name_party_a"],
    "caller_phone": ["caller_phone", "caller_number", "calling_number", "caller_mobile", "calling_mobile", "from", "source_number", "msisdn_a", "a_number", "a_phone", "party_a", "party_a_number", "callerid", "cli"],
    "callee_name": ["callee_name", "callee", "called_name", "called_party", "called_party_name", "receiving_party", "receiving_party_name", "to_name", "name_b", "party_b_name", "b_name", "bname", "callee_name_party_b"],
    "callee_phone": ["callee_phone", "callee_number", "called_number", "called_mobile", "dialled_number", "dialed_number", "receiving_number", "to", "destination_number", "msisdn_b", "b_number", "b_phone", "party_b", "party_b_number", "called_party_number"],
    "duration": ["duration", "duration_sec", "call_duration", "duration_s", "talk_time", "talktime", "seconds"],
    "sender_name": ["sender_name", "sender", "remitter", "payer", "from_party", "debit_name", "account_holder_from"],
    "sender_account": ["sender_account", "from_account", "account_from", "debit_account", "source_account", "sender_acct", "from_acct"],
    "receiver_name": ["receiver_name", "receiver", "payee", "beneficiary", "beneficiary_name", "credit_name", "recipient", "to_party", "account_holder_to"],
    "receiver_account": ["receiver_account", "to_account", "account_to", "credit_account", "beneficiary_account", "receiver_acct", "to_acct"],
    "amount": ["amount", "amt", "value", "txn_amount", "transaction_amount", "transfer_amount", "credit_amount", "debit_amount", "sum"],
    "transaction_id": ["transaction_id", "txn_id", "transactionid", "txnid", "ref_no", "reference", "reference_no", "utr", "receipt_no", "trn_id"],
    "person_name": ["person_name", "name", "person", "full_name", "customer_name", "account_holder", "suspect", "accused", "subject", "complainant"],
    "phone": ["phone", "phone_number", "mobile", "mobile_number", "contact_number", "contact_no", "tel", "telephone", "msisdn", "cell", "cell_number"],
    "vehicle": ["vehicle", "vehicle_number", "reg_number", "registration_number", "reg_no", "vrn", "car_number", "bike_number", "vehicle_reg"],
    "account": ["account", "account_number", "acct_no", "acc_no", "bank_account", "account_no", "a_c_no"],
    "location": ["location", "place", "address", "city", "area", "station", "site", "branch", "scene"],
    "date": ["date", "day", "call_date", "txn_date", "transaction_date", "event_date", "record_date", "timestamp_date"],
    "time": ["time", "call_time", "txn_time", "transaction_time", "start_time", "event_time", "timestamp_time"],
    "timestamp": ["timestamp", "datetime", "date_time", "ts", "call_timestamp", "event_timestamp", "date_and_time", "start_datetime"],
}
CALL_FIELDS = ("caller_name", "caller_phone", "callee_name", "callee_phone")
NUMBER_CELLS = ["mobile_no", "mobile", "mobile_number", "phone_no", "phone", "contact_number", "contact_no", "number", "telephone", "dialled_number", "dialed_number", "called_number", "receiving_number", "other_number", "other_phone", "peer_number", "opposite_number"]
CALLEE_STARTS = ("dial", "called", "receiving", "other", "peer", "opposite")
SHAPES = (
    ("call", (*CALL_FIELDS, "duration")),
    ("transaction", ("sender_name", "sender_account", "receiver_name", "receiver_account", "amount", "transaction_id")),
    ("person", ("person_name", "phone", "vehicle", "account", "location", "date", "time", "timestamp")),
)


def norm_header(c) -> Column:
    """Lower case, runs of other characters as one _, none at the ends (Q1)."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def alias_rows() -> list[tuple[str, int, str]]:
    return [(field, k, cell) for k, (field, cells) in enumerate(ALIASES.items()) for cell in cells]


def map_columns(headers: DataFrame) -> DataFrame:
    """headers (dataset, ordinal, cell) -> (dataset, field, ordinal, cell) (Q2).

    Fields are served in their fixed order and take the first column that names them; an alias belongs to one field, so
    columns never compete. In call-like files the generic number columns that are left over fill the phone fields, those
    that sound like the callee's last.
    """
    spark = headers.sparkSession
    aliases = F.broadcast(spark.createDataFrame(alias_rows(), "field string, field_no int, col string"))  # fixed size
    named = stored(headers.withColumn("col", norm_header(F.col("cell"))), "headers")
    hits = named.join(aliases, "col")
    first = F.row_number().over(Window.partitionBy("dataset", "field").orderBy("ordinal"))
    chosen = stored(hits.withColumn("n", first).where("n = 1").select("dataset", "field", "ordinal", "cell"), "headers-chosen")
    flags = chosen.groupBy("dataset").agg(
        F.bool_or(F.col("field").isin(*CALL_FIELDS)).alias("callish"),
        F.bool_or(F.col("field") == "caller_phone").alias("has_caller"),
        F.bool_or(F.col("field") == "callee_phone").alias("has_callee"),
    )
    left = named.where(F.col("col").isin(*NUMBER_CELLS)).hint("merge").join(chosen.select("dataset", "ordinal").hint("merge"), ["dataset", "ordinal"], "left_anti")
    is_callee = F.lit(False)
    for start in CALLEE_STARTS:
        is_callee = is_callee | F.col("col").startswith(start)
    order = F.row_number().over(Window.partitionBy("dataset").orderBy(is_callee, "ordinal"))
    left = left.hint("merge").join(flags.where("callish").hint("merge"), "dataset").withColumn("n", order)
    to_caller = ~F.col("has_caller") & (F.col("n") == 1)
    to_callee = ~F.col("has_callee") & (F.col("n") == F.when(F.col("has_caller"), 1).otherwise(2))
    second = left.withColumn("field", F.when(to_caller, "caller_phone").when(to_callee, "callee_phone")).where("field is not null")
    return chosen.unionByName(second.select("dataset", "field", "ordinal", "cell"))


def check_mapping(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """User mappings (dataset, field, cell) -> dataset, field, cell, ordinal, error (Q3).

    cell names a column, or is its index from 0 if it has digits only. error: unknown field, index out of range, missing column, or null; ordinal is the
    column meant (the first of several with one name), null with an error.
    """
    named = stored(headers.select("dataset", "ordinal", norm_header(F.col("cell")).alias("col")), "mapping-headers")
    by_name = named.groupBy("dataset", "col").agg(F.min("ordinal").alias("named"))
    widths = named.groupBy("dataset").agg((F.max("ordinal") + 1).alias("width"))
    at = F.when(F.trim("cell").rlike("^[0-9]+$"), F.trim("cell").try_cast("long"))
    is_index = F.trim("cell").rlike("^[0-9]+$")
    met = mapping.withColumn("col", norm_header(F.col("cell"))).hint("merge").join(by_name.hint("merge"), ["dataset", "col"], "left").hint("merge").join(widths.hint("merge"), "dataset", "left")
    error = (
        F.when(~F.coalesce(F.col("field").isin(*ALIASES), F.lit(False)), "unknown field")
        .when(is_index & ~F.coalesce(at < F.col("width"), F.lit(False)), "index out of range")
        .when(~F.coalesce(is_index, F.lit(False)) & F.col("named").isNull(), "missing column")
    )
    ordinal = F.when(error.isNull(), F.when(is_index, at).otherwise(F.col("named")))
    return met.select("dataset", "field", "cell", ordinal.cast("long").alias("ordinal"), error.alias("error"))


def record_shape(mapping: DataFrame) -> DataFrame:
    """dataset, shape: call, transaction, person or unknown, by the mapped fields (Q4)."""
    shape = F
    for label, fields in SHAPES:
        shape = shape.when(F.bool_or(F.col("field").isin(*fields)), label)
    return mapping.groupBy("dataset").agg(shape.otherwise("unknown").alias("shape"))


def validate_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (id, kind, text) -> id, errors, warnings: arrays of what is wrong (Q5). Commas and line feeds inside quotes are part of a cell."""
    text, records = F.coalesce("text", F.lit("")), F.col("__csv.records")
    csv = F.col("kind") == "csv"
    header = F.transform("__csv.header", lambda x: F.lower(x))
    errors = F.array_compact(F.array(
        F.when(~F.col("kind").isin("pdf", "csv", "json", "txt"), "unsupported"),
        F.when(F.octet_length(text) > max_bytes, "too large"),
        F.when(F.length(F.trim(text)) == 0, "empty"),
        F.when((F.col("kind") == "json") & ~F.ltrim(text).rlike(r"^[{\[]"), "type mismatch"),
        F.when(text.contains("\x00"), "binary"),
        F.when(F.col("__csv.error").isNotNull(), "malformed"),
        F.when(csv & F.col("__csv.error").isNull() & (records < 2), "no rows"),
    ))
    warnings = F.array_compact(F.array(
        F.when(csv & (F.size(F.array_distinct(header)) < F.size(header)), "duplicate headers"),
        F.when(csv & (records > 1) & (F.col("__csv.ragged") * 2 > records - 1), "ragged rows"),
    ))
    return files.withColumn("__csv", csv_shape(F.when(csv, text))).select("id", errors.alias("errors"), warnings.alias("warnings"))


def duplicate_content(files: DataFrame, case: str = "case_id", sha: str = "sha", key: str = "doc_id") -> DataFrame:
    """Adds duplicate_of: the first document of the case with that content, null for itself (Q6)."""
    first = files.groupBy(case, sha).agg(F.min(key).alias("first"))
    return files.hint("merge").join(first.hint("merge"), [case, sha]).withColumn("duplicate_of", F.when(F.col("first") != F.col(key), F.col("first"))).drop("first")


def batch_gate(files: DataFrame, batch: str = "batch", error: str = "error") -> DataFrame:
    """batch, n_files, n_errors, status: 200, or 409 if all errors are duplicates, else 400 (Q7)."""
    bad, twice = F.count_if(F.col(error).isNotNull()), F.count_if(F.col(error) == "duplicate")
    return files.groupBy(batch).agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_errors"), F.when(bad == 0, 200).when(bad == twice, 409).otherwise(400).alias("status"))


COUNTERS = ("entities", "events", "persons", "evidence", "relationships")


def import_totals(docs: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: documents, total size, newest document, and, where docs has them, completed and active documents and sums of COUNTERS (Q8)."""
    more = []
    if "status" in docs.columns:
        more += [F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(~F.col("status").isin("completed", "failed")).alias("n_active")]
    more += [F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in COUNTERS if c in docs.columns]
    return docs.groupBy(case).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("total_size"), F.max("doc_id").alias("newest"), *more)


def import_history(docs: DataFrame, case=None) -> DataFrame:
    """Documents of a case, or of all, newest first (created_at, then doc_id) (Q8)."""
    rows = docs if case is None else docs.where(F.col("case_id") == case)
    return rows.orderBy("case_id", F.desc_nulls_last("created_at"), F.desc("doc_id"))


def discovery_counts(events: DataFrame, document: str, a: str, b: str) -> DataFrame:
    """Per document: events and distinct unordered pairs (Q9)."""
    pair = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.least(a, b), F.greatest(a, b)))
    return events.groupBy(document).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(pair).alias("n_pairs"))


def growth(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Rows per key before and after an import and what is new (Q9); a key on one side only counts 0 on the other."""
    a, b = (df.groupBy(by).agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    rows = a.hint("merge").join(b.hint("merge"), by, "full_outer").na.fill(0, ["n_before", "n_after"])
    return rows.withColumn("n_new", F.col("n_after") - F.col("n_before"))


def recent_jobs(jobs: DataFrame, last: int = 50) -> DataFrame:
    """The last jobs by id, newest first (Q10)."""
    return jobs.orderBy(F.desc("id")).limit(last)


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that comes first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def preview(rows: DataFrame, key: str, order: str, text: str, first: int = 3, width: int = 300) -> DataFrame:
    """The first rows of each key, with the text cut to width (Q11)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("n", n).where(F.col("n") <= first).select(key, "n", F.substring(text, 1, width).alias("preview"))
