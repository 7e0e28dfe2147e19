"""Column -> Column normalisers, similarity and labels (C1-C15). Null stays null unless said otherwise."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evgraph.functions.arrays import let

#: Fixed values.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
STRENGTHS = ((0.7, "STRONG"), (0.45, "MODERATE"), (0.2, "WEAK"))
NO_STRENGTH = "INSUFFICIENT EVIDENCE"
SIGNALS = ("calls", "transactions", "locations", "shared_ids", "cases")


def _text(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def norm_phone(c) -> Column:
    """Digits; one leading 0 goes, then 91 before ten digits. Null is the empty string."""
    digits = F.regexp_replace(F.regexp_replace(_text(c), "[^0-9]", ""), "^0", "")
    return F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)


def norm_name(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def norm_vehicle(c) -> Column:
    return F.upper(F.regexp_replace(_text(c), r"[\s.\-]", ""))


def norm_account(c) -> Column:
    return F.upper(F.regexp_replace(_text(c), "[^a-zA-Z0-9]", ""))


def norm_location(c) -> Column:
    """Single spaces, and a capital at every start of letters (after apostrophes and hyphens too)."""
    words = F.split(F.trim(F.regexp_replace(_text(c), r"\s+", " ")), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def _iso_date(s: Column) -> Column:
    """ISO date of a text that is one of the known date formats as a whole, else null."""
    names = {m: k + 1 for k, m in enumerate(MONTHS)} | {m: k + 1 for k, m in enumerate(MONTH_NAMES)}
    month_of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])

    def dated(v: Column) -> Column:
        a, b, c = (F.get(v["parts"], F.lit(k)) for k in range(3))
        month = lambda name: F.try_element_at(month_of, F.lower(name)).cast("string")
        century = F.concat(F.when(c >= "69", "19").otherwise("20"), c)
        is_a = lambda pattern: v["s"].rlike(pattern)
        shape = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        found = (
            F.when(is_a(r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"), shape(a, b, c))
            .when(is_a(r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"), shape(c, b, a))
            .when(is_a(r"^\d{1,2}([-/])\d{1,2}\1\d{2}$"), shape(century, b, a))
            .when(is_a(r"^\d{1,2}[-/ ]+[A-Za-z]{3,9}[-/ ]+\d{4}$"), shape(c, month(b), a))
            .when(is_a(r"^\d{1,2} +[A-Za-z]{3} +\d{2}$"), shape(century, month(b), a))
            .when(is_a(r"^[A-Za-z]{3,9} +\d{1,2} +\d{4}$"), shape(c, month(a), b))
        )
        made = lambda x: F.concat(x["y"], F.lit("-"), F.lpad(x["m"], 2, "0"), F.lit("-"), F.lpad(x["d"], 2, "0"))  # noqa: E731  null if a part is
        return let(let(found, made), lambda x: F.when(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull(), x))

    return let(F.struct(s.alias("s"), F.split(s, "[-/ ]+").alias("parts")), dated)


def norm_date(c) -> Column:
    """ISO date of the whole text, else of the part before the first space or T; what is no date stays as that part; blank is null."""
    s = F.trim(c if isinstance(c, Column) else F.col(c))
    tries = F.when(s.rlike("[T ]"), F.array(s, F.element_at(F.split(s, "[T ]+", 2), 1))).otherwise(F.array(s))
    first = lambda v: F.coalesce(F.get(F.filter(F.transform(v, _iso_date), lambda x: x.isNotNull()), F.lit(0)), F.element_at(v, -1))
    return F.when(s != "", F.nullif(let(tries, first), F.lit("")))


TIME = r"(?:^|[T ])(\d{1,2}):(\d{2})(?::\d{2})?\s*((?:[aA]|[pP])[mM])?$"


def norm_time(c) -> Column:
    """HH:MM of the time at the end of the text; without one, the last part as it is."""
    s = F.trim(c if isinstance(c, Column) else F.col(c))
    hour, half = F.regexp_extract(s, TIME, 1).try_cast("int"), F.lower(F.regexp_extract(s, TIME, 3))
    hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(s.rlike(TIME), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(s, TIME, 2))).otherwise(F.regexp_extract(s, "([^T ]*)$", 1))


def norm_value(kind: Column, value: Column) -> Column:
    """The normaliser of the entity type; other types are trimmed."""
    return (
        F.when(kind == "PHONE", norm_phone(value))
        .when(kind.isin("PERSON", "ORGANIZATION", "CASE"), norm_name(value))
        .when(kind == "VEHICLE", norm_vehicle(value))
        .when(kind.isin("BANK_ACCOUNT", "ACCOUNT"), norm_account(value))
        .when(kind == "LOCATION", norm_location(value))
        .when(kind == "DATE", norm_date(value))
        .when(kind == "TIME", norm_time(value))
        .otherwise(F.trim(_text(value)))
    )


def json_value(c, path: str) -> Column:
    """The value at a JSON path as text; null where the text is no JSON or has no such path (C14)."""
    return F.get_json_object(c, path)


def json_text(*fields: Column) -> Column:
    """Compact JSON text of named columns; null fields are left out (C14)."""
    return F.to_json(F.struct(*fields))


def sequence_ratio(a: Column, b: Column) -> Column:
    """2 M / (length of a + length of b), M being the characters in matching blocks: the longest common run (the first of equal ones), then the
    same on both sides of it (C9). 1 for two empty texts, null for a null; a and b may not be exchanged. One call for each row, so meant for pairs that are few."""

    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


def name_similarity(a: Column, b: Column, exact: bool = False) -> Column:
    """1 equal; same first token .9 (one side a single token, or same second initial) or .8; else 1 - edit distance / longer length.

    exact takes the ratio of matching blocks instead of the edit distance, of a and b in this order.
    """
    na, nb = norm_name(a), norm_name(b)
    pa, pb = F.split(na, " "), F.split(nb, " ")
    initial = lambda p: F.substring(F.get(p, F.lit(1)), 1, 1)
    longer = F.greatest(F.length(na), F.length(nb))
    return (
        F.when((na == "") | (nb == ""), 0.0)
        .when(na == nb, 1.0)
        .when((pa[0] == pb[0]) & ((F.size(pa) == 1) | (F.size(pb) == 1) | (initial(pa) == initial(pb))), 0.9)
        .when(pa[0] == pb[0], 0.8)
        .otherwise(sequence_ratio(na, nb) if exact else F.round(1 - F.levenshtein(na, nb) / longer, 6))
    )


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def strength(score: Column) -> Column:
    out = F
    for least, label in STRENGTHS:
        out = out.when(score >= least, label)
    return out.otherwise(NO_STRENGTH)


def person_id(name: Column) -> Column:
    return F.concat(F.lit("P-"), F.substring(F.replace(norm_name(name), F.lit(" "), F.lit("_")), 1, 60))


def relationship_types(**counts: Column) -> Column:
    """Names of the signals that are not zero."""
    return F.array_compact(F.array(*[F.when(c > 0, F.lit(n)) for n, c in counts.items()]))


def precision_tag(date: Column, time: Column) -> Column:
    return F.when(time.isNotNull(), "exact").when(date.isNotNull(), "date_only").otherwise("unknown")


def event_label(kind: Column, a: Column, b: Column, amount: Column) -> Column:
    """What an event says in words (C15); an absent party leaves its place empty."""
    arrow = F.concat(_text(a), F.lit(" → "), _text(b))
    return (
        F.when(kind == "CALL", F.concat(F.lit("Call "), arrow))
        .when(kind == "TRANSACTION", F.concat(F.lit("Transaction "), arrow, F.coalesce(F.concat(F.lit(" ₹"), amount), F.lit(""))))
        .otherwise(F.concat(F.lit("Observed "), arrow))
    )


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
