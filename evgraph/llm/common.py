"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions.arrays import let, running  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in; other texts go letter by letter."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def column(name: str) -> Column:
    """A column by its plain name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that they cannot clash with an operator's own."""
    return F.struct(*[column(c).alias(c) for c in docs.columns])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty: other columns cannot clash with an operator's own."""
    return docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))


def row_key(id_col: Column, text: Column) -> Column:
    """Names a document: rows with one id and one text have one key."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("\x00")), F.coalesce(text, F.lit("")))


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with length_col, where there is one, in step with a changed text."""
    if length_col not in docs.columns:
        return docs
    return docs.withColumn(length_col, F.char_length(column(text_col)).cast(docs.schema[length_col].dataType))
