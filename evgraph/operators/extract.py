"""Extraction.

Record functions return a Bundle of three tables: events, entities and mentions, each with the record's key and position, so that every row
names its source. Blank cells are null and never get a default; records without any known value give nothing; repeated records count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions import scalars as C
from evgraph.session import few, stored

#: Patterns and the group that holds the value.
PATTERNS = {
    "PHONE": (r"(?:\+91[\s\-]?)?([6-9]\d{4}[\s\-]?\d{5})", 0),
    "VEHICLE": (r"\b[A-Z]{2}\s?\d{2}\s?[A-Z]{1,2}\s?\d{1,4}\b", 0),
    "BANK_ACCOUNT": (r"(?i)\b(?:A/C|ACCOUNT|Acct)[\s:#]*(\d{6,20})\b", 1),
    "DATE": (r"\b\d{1,2}[-/][A-Za-z]{3,9}[-/]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b", 0),
    "TIME": (r"(?i)\b\d{1,2}:\d{2}(?:\s?(?:AM|PM))?\b", 0),
    "TRANSACTION": (r"(?i)(?:₹|Rs\.?|INR)\s?([\d,]+(?:\.\d+)?)", 1),
}
CONFIDENCE = 0.95
#: Characters of names that one automaton holds.
AUTOMATON_CHARS = 1 << 24


def values_of(kind: str, text: Column) -> Column:
    """All values of one kind in a text, as the entity keeps them."""
    pattern, group = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    keep = {
        "PHONE": lambda v: F.regexp_replace(v, "[^0-9]", ""),
        "VEHICLE": lambda v: F.trim(v),
        "DATE": C.norm_date,
        "TIME": C.norm_time,
        "TRANSACTION": lambda v: F.concat(F.lit("₹"), F.replace(v, F.lit(","), F.lit(""))),
    }.get(kind)
    return F.transform(found, keep) if keep else found


def entities(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, type, position, value, confidence, method: every entity of every text in one pass."""
    each = [_tagged(k, F.col(text)) for k in PATTERNS]
    rows = docs.select(key, F.explode(F.concat(*each)).alias("e"))
    return rows.select(key, "e.type", "e.position", "e.value", F.lit(CONFIDENCE).alias("confidence"), F.lit("regex").alias("method"))


def _tagged(kind: str, text: Column) -> Column:
    return F.transform(values_of(kind, text), lambda v, i: F.struct(F.lit(kind).alias("type"), i.alias("position"), v.alias("value")))


def text_events(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """A date and an amount make a TRANSACTION, a date alone a CASE_EVENT; the first of each counts."""
    first = lambda kind: F.get(values_of(kind, F.col(text)), F.lit(0))
    rows = docs.select(key, first("DATE").alias("date"), first("TIME").alias("time"), first("TRANSACTION").alias("amount")).where("date is not null")
    return rows.select(key, F.when(F.col("amount").isNotNull(), "TRANSACTION").otherwise("CASE_EVENT").alias("type"), "date", "time", C.precision_tag(F.col("date"), F.col("time")).alias("precision"), "amount")


def dictionary_matches(docs: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", name: str = "name", words: int | None = None, longest: bool = False) -> DataFrame:
    """key, name, position, original: dictionary entries that occur in the text as words (X2), by an equi-join on its n-grams of up to `words` words.

    words is that of the longest entry unless it is given; longer entries than that are left out. position is the word where the first occurrence
    starts (from 0), original its words there with a blank between. longest: of the entries that start at one word only the longest stays.
    Null texts and names, and names without letters or digits, match nothing. name_substrings finds names anywhere, as they stand in the text.
    """
    cut = r"[^\p{L}\p{N}]+"
    parts = F.filter(F.split(text, cut), lambda x: x != "")
    rows = docs.select(key, parts.alias("w")).where("size(w) > 0")
    form = F.filter(F.split(F.lower(F.col(name)), cut), lambda x: x != "")
    if words is None:
        words = dictionary.agg(F.max(F.size(form))).first()[0] or 1
    grams = F.flatten(F.array(*[F.transform(_grams(n), lambda g, i: F.struct(i.alias("position"), g.alias("original"))) for n in range(1, words + 1)]))
    held = rows.select(key, F.explode(grams).alias("g")).select(key, F.lower("g.original").alias("gram"), "g.position", "g.original")
    known = dictionary.select(F.array_join(form, " ").alias("gram"), F.col(name).alias("name")).where("gram <> ''").distinct()
    known = stored(known, "dictionary")
    held = held.join(few(known.select("gram").distinct(), "dictionary-grams"), "gram", "left_semi")  # before anything is shuffled: most n-grams are no entry
    held = held.groupBy(key, "gram").agg(F.min(F.struct("position", "original")).alias("g"))
    found = held.hint("merge").join(known.hint("merge"), "gram").select(key, "name", "g.position", "g.original")
    if not longest:
        return found
    best = F.max_by(F.struct("name", "original"), F.struct(F.length("original"), "name")).alias("b")
    return found.groupBy(key, "position").agg(best).select(key, "b.name", "position", "b.original")


def name_substrings(docs: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", name: str = "name", most: int = AUTOMATON_CHARS) -> DataFrame:
    """key, name, position, original: dictionary entries of any length that occur anywhere in the text, whatever their case.

    position is the character where the first occurrence starts (from 0), original what stands there. One pass over each text with an Aho-Corasick
    automaton of all names; a dictionary of more than `most` characters is dealt out to several automata, each with its pass over the texts.
    Null texts, null names and empty names match nothing; names that differ in case alone are found both.
    """
    names = dictionary.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    names = stored(names, "dictionary")
    shards = -(-(names.agg(F.sum(F.length("name"))).first()[0] or 0) // most)
    rows = docs.select(key, F.col(text).alias("text")).where("text IS NOT NULL")
    kind = rows.schema[key].dataType.simpleString()
    spec, spark = f"`{key}` {kind}, name string, position int, original string", docs.sparkSession

    def finder(shared):
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            forms: dict[str, list[str]] = {}
            for x in shared.value:
                forms.setdefault(x.lower(), []).append(x)
            known = ahocorasick.Automaton()
            for form in forms:
                known.add_word(form, form)
            known.make_automaton()
            for pdf in batches:
                found = []
                for k, t in zip(pdf[key], pdf["text"]):
                    first: dict[str, int] = {}
                    for end, form in known.iter(t.lower()):
                        first.setdefault(form, end + 1 - len(form))
                    found += [(k, x, at, t[at : at + len(form)]) for form, at in first.items() for x in forms[form]]
                yield pd.DataFrame(found, columns=[key, "name", "position", "original"])

        return find

    parts = [rows.select(key, F.lit("").alias("name"), F.lit(0).alias("position"), F.lit("").alias("original")).limit(0)]
    for k in range(shards):
        held = names.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == k).toPandas()["name"].tolist()  # about `most` characters
        if held:
            parts.append(rows.mapInPandas(finder(spark.sparkContext.broadcast(held)), spec))
    return reduce(DataFrame.unionByName, parts)


def _grams(n: int) -> Column:
    at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice("w", i, n), " "))


class Bundle(NamedTuple):
    """What records say: events (key, position, type, a_name, b_name, date, time, precision, description, details), entities (key, position,
    type, value, confidence, method, date, time) and mentions (key, position, name, phone, account, vehicle, location)."""

    events: DataFrame
    entities: DataFrame
    mentions: DataFrame


def _cell(name: str | None) -> Column:
    return F.lit(None).cast("string") if name is None else C.blank_to_null(F.col(name).cast("string"))


def _moment(columns: dict[str, str]) -> tuple[Column, Column]:
    """(date, time) of a row: the timestamp's, or those of the date and time cells."""
    at, day, clock = (_cell(columns.get(c)) for c in ("timestamp", "date", "time"))
    return split_datetime(F.coalesce(at, day))[0], split_datetime(F.when(at.isNotNull(), at).otherwise(clock))[1]


def _exploded(rows: DataFrame, key: str, cells: Column) -> DataFrame:
    return rows.select(key, "position", F.explode(cells).alias("m"), "date", "time")


def _bundle(rows: DataFrame, key: str, kind: Column, label: Column, event: Column, parties: list[tuple[Column, dict[str, Column]]], entities: list[tuple[str, Column, float]], method: str, details: dict[str, Column]) -> Bundle:
    """rows have key, position, date, time and the cells that the columns refer to; event says which rows are events."""
    names = [p[0] for p in (*parties, (F.lit(None).cast("string"), {}))[:2]]
    events = rows.where(event).select(
        key, "position", kind.alias("type"), names[0].alias("a_name"), names[1].alias("b_name"), "date", "time", C.precision_tag(F.col("date"), F.col("time")).alias("precision"),
        label.alias("description"), F.struct(*[v.cast("string").alias(k) for k, v in details.items()]).alias("details"),
    )
    values = F.array(*[F.struct(F.lit(k).alias("type"), v.cast("string").alias("value"), F.lit(c).cast("double").alias("confidence")) for k, v, c in entities])
    found = _exploded(rows, key, values).where("m.value IS NOT NULL").select(key, "position", "m.*", F.lit(method).alias("method"), "date", "time")
    kinds = ("phone", "account", "vehicle", "location")
    people = F.array(*[F.struct(name.alias("name"), *[ids.get(k, F.lit(None)).cast("string").alias(k) for k in kinds]) for name, ids in parties])
    mentions = _exploded(rows, key, people).where("m.name IS NOT NULL").select(key, "position", "m.*")
    return Bundle(events, found, mentions)


def _prepared(rows: DataFrame, key: str, columns: dict[str, str], position: str | None, needs: tuple[str, ...]) -> DataFrame:
    date, time = _moment(columns)
    cells = [_cell(columns.get(c)).alias(c) for c in needs]
    at = (F.col(position) if position else F.lit(None)).cast("long").alias("position")
    return rows.select(F.col(key), at, date.alias("date"), time.alias("time"), *cells)


def call_rows(rows: DataFrame, key: str, columns: dict[str, str], position: str | None = None) -> Bundle:
    """Call records (X4); columns: field -> column of caller_name, caller_phone, callee_name, callee_phone, duration, timestamp, date, time. Rows without any party are skipped."""
    r = _prepared(rows, key, columns, position, ("caller_name", "caller_phone", "callee_name", "callee_phone", "duration"))
    r = r.where("coalesce(caller_name, caller_phone, callee_name, callee_phone) IS NOT NULL")
    c = F.col
    label = C.event_label(F.lit("CALL"), F.coalesce("caller_name", "caller_phone"), F.coalesce("callee_name", "callee_phone"), F.lit(None).cast("string"))
    return _bundle(
        r, key, F.lit("CALL"), label, F.lit(True), [(c("caller_name"), {"phone": c("caller_phone")}), (c("callee_name"), {"phone": c("callee_phone")})],
        [("PHONE", c("caller_phone"), 1.0), ("PHONE", c("callee_phone"), 1.0)], "csv", {k: c(k) for k in ("caller_phone", "callee_phone", "duration")},
    )


def transaction_rows(rows: DataFrame, key: str, columns: dict[str, str], position: str | None = None) -> Bundle:
    """Transaction records (X5); columns: field -> column of sender_name, sender_account, receiver_name, receiver_account, amount, transaction_id, location, timestamp, date, time.

    Rows that name neither a party, an amount nor an id are no events, though a location among them is an entity.
    """
    needs = ("sender_name", "sender_account", "receiver_name", "receiver_account", "amount", "transaction_id", "location")
    r, c = _prepared(rows, key, columns, position, needs), F.col
    label = C.event_label(F.lit("TRANSACTION"), c("sender_name"), c("receiver_name"), c("amount"))
    event = F.coalesce(*needs[:-1]).isNotNull()
    return _bundle(
        r, key, F.lit("TRANSACTION"), label, event, [(c("sender_name"), {"account": c("sender_account")}), (c("receiver_name"), {"account": c("receiver_account")})],
        [("BANK_ACCOUNT", c("sender_account"), 1.0), ("BANK_ACCOUNT", c("receiver_account"), 1.0), ("LOCATION", c("location"), 1.0)], "csv",
        {k: c(k) for k in ("amount", "transaction_id", "sender_account", "receiver_account", "location")},
    )


def registry_rows(rows: DataFrame, key: str, columns: dict[str, str], position: str | None = None) -> Bundle:
    """Registry records (X6); columns: field -> column of person_name, phone, vehicle, account, location, timestamp, date, time. Dated rows are CASE_EVENTs as well."""
    needs = ("person_name", "phone", "vehicle", "account", "location")
    r, c = _prepared(rows, key, columns, position, needs), F.col
    r = r.where(F.coalesce(*needs).isNotNull())
    ids = {k: c(k) for k in needs[1:]}
    label = F.concat(F.lit("Dataset record — "), F.coalesce(*needs))
    return _bundle(
        r, key, F.lit("CASE_EVENT"), label, c("date").isNotNull(), [(c("person_name"), ids)],
        [("PHONE", c("phone"), 1.0), ("VEHICLE", c("vehicle"), 1.0), ("BANK_ACCOUNT", c("account"), 1.0), ("LOCATION", c("location"), 1.0)], "csv", ids,
    )


#: Record types, alias keys in their order, and what the types become.
TOGETHER = ("location_observation", "sighting", "cctv", "co_location")
TRANSFERS = ("transaction", "payment", "transfer")
CALLS = ("call",)
OTHERS = ("case_event", "event", "incident", "record")
KEYS = {
    "person": ("person", "person_name", "subject"),
    "other": ("other_person", "with", "accompanied_by"),
    "place": ("location", "place"),
    "phone": ("phone", "mobile"),
    "moment": ("timestamp", "date", "datetime"),
    "sender": ("sender", "sender_name", "from_name"),
    "receiver": ("receiver", "receiver_name", "to_name"),
    "sender_account": ("sender_account", "from_account", "account_from"),
    "receiver_account": ("receiver_account", "to_account", "account_to"),
    "amount": ("amount",),
    "transaction_id": ("transaction_id", "txn_id", "reference_no", "utr"),
    "city": ("location", "city"),
    "vehicle": ("vehicle",),
    "text": ("description", "summary"),
}


def json_bundle(records: DataFrame, key: str, position: str = "position", record: str = "record") -> Bundle:
    """JSON records (key, position, map of strings with keys in lower case and _) -> events, entities, mentions.

    Observations of two persons are LOCATION_OBSERVATIONs; of one, they give entities and a mention. Records without a type are transactions; other
    known types are transactions, calls or CASE_EVENTs; unknown types, a null type among them, give entities and mentions only. positions count from 1.
    """
    value = lambda n: F.nullif(F.try_element_at(F.col(record), F.lit(n)), F.lit(""))
    given = lambda n: F.lower(F.coalesce(F.try_element_at(F.col(record), F.lit(n)), F.lit("none")))
    has = lambda n: F.map_contains_key(F.col(record), n)
    said = F.when(has("type"), given("type")).when(has("record_type"), given("record_type")).otherwise("transaction")
    cells = [F.coalesce(*map(value, names)).alias(c) for c, names in KEYS.items()]
    rows = records.select(key, (F.col(position) + 1).cast("long").alias("position"), said.alias("said"), *cells)
    date, time = split_datetime(F.col("moment"))
    rows = rows.withColumns({"date": date, "time": time})
    c, method = F.col, "json"
    seen = rows.where(c("said").isin(*TOGETHER))
    label = F.concat(F.coalesce("person", F.lit("None")), F.lit(" and "), c("other"), F.lit(" observed together at "), F.coalesce("place", F.lit("None")))
    together = _bundle(
        seen, key, F.lit("LOCATION_OBSERVATION"), label, c("other").isNotNull(),
        [(c("person"), {"location": c("place"), "vehicle": c("vehicle"), "phone": c("phone")}), (c("other"), {"location": c("place"), "vehicle": c("vehicle")})],
        [("LOCATION", c("place"), 0.9), ("VEHICLE", c("vehicle"), 0.9), ("PHONE", c("phone"), 0.95)], method, _details(location=c("place"), vehicle=c("vehicle")),
    )
    rest = rows.where(~c("said").isin(*TOGETHER))
    kind = F.when(c("said").isin(*TRANSFERS), "TRANSACTION").when(c("said").isin(*CALLS), "CALL").otherwise("CASE_EVENT")
    text = F.substring(F.coalesce("text", F.concat(F.lit("Dataset record "), c("position").cast("string"))), 1, 500)
    label = F.when(kind == "CASE_EVENT", text).otherwise(C.event_label(kind, c("sender"), c("receiver"), c("amount")))
    dealt = _bundle(
        rest, key, kind, label, c("said").isin(*TRANSFERS, *CALLS, *OTHERS),
        [(c("sender"), {"account": c("sender_account"), "vehicle": c("vehicle")}), (c("receiver"), {"account": c("receiver_account")})],
        [("BANK_ACCOUNT", c("sender_account"), 1.0), ("BANK_ACCOUNT", c("receiver_account"), 1.0), ("LOCATION", c("city"), 0.9), ("VEHICLE", c("vehicle"), 0.9)], method,
        _details(amount=c("amount"), transaction_id=c("transaction_id"), sender_account=c("sender_account"), receiver_account=c("receiver_account"), location=c("city")),
    )
    return Bundle(*[a.unionByName(b) for a, b in zip(together, dealt)])


def _details(**known: Column) -> dict[str, Column]:
    names = ("amount", "transaction_id", "sender_account", "receiver_account", "location", "vehicle")
    return {n: known.get(n, F.lit(None).cast("string")) for n in names}


TIME_ONLY = r"(?i)^\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:am|pm))?$"


def split_datetime(cell: Column) -> tuple[Column, Column]:
    """(date, time) of a cell; what is neither stays null."""
    s = F.trim(cell)
    several = s.rlike("[T ]")
    parts = F.filter(F.split(s, "[T ]+"), lambda p: p != "")
    times, dates = F.filter(parts, lambda p: p.rlike(TIME_ONLY)), F.filter(parts, lambda p: ~p.rlike(TIME_ONLY))
    date = F.when(~s.rlike(TIME_ONLY) & (s != ""), C.norm_date(F.when(several, F.element_at(dates, -1)).otherwise(s)))
    time = F.when(several | s.rlike(TIME_ONLY), C.norm_time(F.when(several & ~s.rlike(TIME_ONLY), F.element_at(times, -1)).otherwise(s)))
    return date, time


def merge_mentions(mentions: DataFrame, file: str, name: str, position: str, **identifiers: str) -> DataFrame:
    """One mention per file and lower-cased name (X10): first spelling, sorted distinct identifiers and positions, number of rows. Blank names are left out."""
    key = F.lower(F.trim(name))
    sets = [F.array_sort(F.collect_set(c)).alias(kind) for kind, c in identifiers.items()]
    rows = mentions.where(F.coalesce(F.trim(name), F.lit("")) != "")
    merged = [F.min_by(F.trim(name), position).alias("name"), *sets, F.array_sort(F.collect_set(position)).alias("positions"), F.count(F.lit(1)).alias("n_rows")]
    return rows.groupBy(F.col(file), key.alias("name_key")).agg(*merged)
