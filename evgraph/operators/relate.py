"""Relationships and evidence.

A pair is unordered (a < b). Events without one of the two persons, or of a person with itself, make no pair. Null types, dates and sources are counted
as unknown: they add an event, but no signal, date or source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions import scalars as C
from evgraph.operators.numbering import numbered
from evgraph.operators.pairs import pair_signals
from evgraph.operators.resolve import shared_values
from evgraph.session import dealt, stored

#: Weight of each signal; kinds that count as observations; evidence kind and confidence per event type.
WEIGHTS = {"calls": 0.5, "transactions": 0.8, "locations": 0.5, "cases": 0.4, "shared_ids": 1.0}
OBSERVATIONS = ("LOCATION_OBSERVATION", "CCTV", "SIGHTING")
EVIDENCE = {"CALL": ("CALL_RECORD", 0.94), "TRANSACTION": ("TRANSACTION_RECORD", 0.92), "LOCATION_OBSERVATION": ("LOCATION_RECORD", 0.88)}
OTHER_EVIDENCE = ("CASE_RECORD", 0.70)


def _two(events: DataFrame, a: str, b: str) -> DataFrame:
    return events.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def _paired(events: DataFrame, a: str, b: str) -> DataFrame:
    return _two(events, a, b).withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})


def event_signals(events: DataFrame, a: str = "person_a", b: str = "person_b", persons: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Per unordered pair: calls, transactions, locations, sources, first and last date (E1). persons (person): others are unknown and drop out.

    rows: the number of events, if many and most pairs have few; they are moved once then and not grouped before.
    """
    count = lambda cond: F.count_if(cond)
    t = F.col("event_type")
    paired = _paired(events, a, b).select("a", "b", "event_type", "source", "date")
    found = (dealt(paired, rows, "a", "b") if rows else paired).groupBy("a", "b").agg(
        count(t == "CALL").alias("calls"), count(t == "TRANSACTION").alias("transactions"), count(t.isin(*OBSERVATIONS)).alias("locations"),
        F.count_distinct("source").alias("sources"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    for c in ("a", "b") if persons is not None else ():  # after the aggregation, so that a busy pair is one row here
        found = stored(found, "signals").hint("merge").join(persons.select(F.col("person").alias(c)).distinct().hint("merge"), c, "left_semi")
    return found


def shared_counts(links: DataFrame, name: str, value: list[str], person: str = "person") -> DataFrame:
    """Per pair the number of values that both persons have (E2 shared_ids, E3 locations)."""
    return shared_values(links, person, value).groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))


def in_several(members: DataFrame, person: str, case: str) -> DataFrame:
    """person, value, strong: the distinct members of cases, and whether the person is in more than one."""
    k = stored(members.select(F.col(person).alias("person"), F.col(case).alias("value")).na.drop().distinct(), "members")
    several = k.groupBy("person").agg((F.count(F.lit(1)) > 1).alias("strong"))
    return k.hint("merge").join(several.hint("merge"), "person")


def shared_cases(members: DataFrame, person: str = "person", case: str = "case_id") -> DataFrame:
    """Per pair the cases both are in, if one of them is in more than one."""
    return pair_signals(in_several(members, person, case), ["value"], strong="strong", cases=F.lit(1))


def link_classes(links: DataFrame, value: list[str], person: str = "person", **counts: Column) -> DataFrame:
    """person, class, values and `counts`: persons with the same set of values are one class, named by its least person.

    Members of a class share all its values, and share with others what its least person shares, so pairs of least persons and this table hold every
    pair. counts are aggregates over a person's distinct values, alike within a class. Null persons and values are left out.
    """
    k = links.select(F.col(person).alias("person"), *value).na.drop().distinct()
    sets = k.groupBy("person").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct(*value)))), 256).alias("set"), F.count(F.lit(1)).alias("values"), *[c.alias(n) for n, c in counts.items()])
    sets = stored(sets, "link-sets")
    least = stored(sets.groupBy("set").agg(F.min("person").alias("class")), "link-classes")
    return stored(sets.hint("merge").join(least.hint("merge"), "set").select("person", "class", "values", *counts), "link-members")


def of_least(links: DataFrame, classes: DataFrame, person: str = "person") -> DataFrame:
    """The links of the least person of each class."""
    least = classes.where("person = class").select(F.col("person").alias(person))
    return links.hint("merge").join(least.hint("merge"), person, "left_semi")


def with_members(pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """pairs (a, b, count `name`) of least persons, and a row for each other person b of a class a, with the values they share; member tells them apart."""
    inside = classes.where("person <> class").select(F.col("class").alias("a"), F.col("person").alias("b"), F.col("values").alias(name), F.lit(True).alias("member"))
    return pairs.select("a", "b", name, F.lit(False).alias("member")).unionByName(inside)


def by_class(own: DataFrame, classes: DataFrame, between: DataFrame) -> DataFrame:
    """Signals of all pairs, without a row for each pair of members: level, a, b and the signals of union_signals.

    own: signals of pairs of persons; classes: person, class and, for signals that come from classes, their count within a class; between: those
    signals for pairs of least persons. level pair: a pair of own, with what its classes share; class: any two persons of the classes a and b that are no
    `pair`; member: likewise any two persons of class a, of which b is one.
    """
    names = [c for c in classes.columns if c not in ("person", "class")]
    classes, rows = classes.select("person", "class", *names), own
    for c in ("a", "b"):
        side = classes.select(F.col("person").alias(c), F.col("class").alias(f"__{c}"), *[F.col(n).alias(f"__{c}_{n}") for n in names])
        rows = stored(rows.hint("merge").join(side.hint("merge"), c, "left"), "signals-of-classes")
    met = between.select(F.col("a").alias("__x"), F.col("b").alias("__y"), *[F.col(n).alias(f"__m_{n}") for n in names])
    rows = rows.withColumns({"__x": F.least("__a", "__b"), "__y": F.greatest("__a", "__b")}).hint("merge").join(met.hint("merge"), ["__x", "__y"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    more = {n: F.col(n) + F.when(F.col("__a") == F.col("__b"), zero(f"__a_{n}")).otherwise(zero(f"__m_{n}")) for n in names}
    pairs = rows.withColumns(more).select(F.lit("pair").alias("level"), *own.columns)
    known = lambda df, level, a, b: df.select(F.lit(level).alias("level"), F.col(a).alias("a"), F.col(b).alias("b"), *[(F.col(n) if n in names else F.lit(0)).cast("long").alias(n) for n in own.columns[2:]])
    return pairs.unionByName(known(between, "class", "a", "b")).unionByName(known(classes.where("person <> class"), "member", "class", "person"))


def weight(calls: Column, transactions: Column, locations: Column, cases: Column, shared_ids: Column) -> Column:
    """Evidence weight in tenths, a whole number, so that sums do not depend on order."""
    return calls * 5 + transactions * 8 + locations * 5 + cases * 4 + shared_ids * 10


def scored(signals: DataFrame) -> DataFrame:
    """Adds score (rounded to 3) and strength (from the unrounded score); pairs without weight go (E5)."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)) if n in signals.columns else F.lit(0)
    tenths = weight(*[zero(n) for n in ("calls", "transactions", "locations", "cases", "shared_ids")])
    w = tenths / 10.0
    raw = F.least(F.lit(1.0), w / (w + 4) + F.least(zero("sources"), F.lit(3)) * 0.1)
    rows = signals.withColumn("tenths", tenths).where("tenths > 0").withColumn("__raw", raw)
    fine = F.col("__raw") * 1000
    near_half = F.abs(fine - F.floor(fine) - 0.5) < 1e-6  # round goes by decimals, which takes longer than all the rest; away from a half the nearest is the same
    return rows.withColumn("score", F.when(near_half, F.round("__raw", 3)).otherwise(F.floor(fine + 0.5) / 1000.0)).withColumn("strength", C.strength(F.col("__raw"))).drop("__raw")


def union_signals(*parts: DataFrame) -> DataFrame:
    """Signals of several kinds -> one row per pair; counts add up, the most sources hold."""
    names = ("calls", "transactions", "locations", "cases", "shared_ids", "sources")
    padded = [p.select("a", "b", *[(F.col(n) if n in p.columns else F.lit(0)).cast("long").alias(n) for n in names]) for p in parts]
    rows = padded[0]
    for p in padded[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in names[:-1]], F.max("sources").alias("sources"))


def provenance(events: DataFrame, a: str = "person_a", b: str = "person_b") -> DataFrame:
    """Sorted distinct sources and dates per pair."""
    return _paired(events, a, b).groupBy("a", "b").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("date")).alias("dates"))


def evidence_rows(events: DataFrame, case: str, order: list[str], a: str = "person_a", b: str = "person_b") -> DataFrame:
    """One evidence row per two-party event, E{n}-{case}, with kind and confidence."""
    t = F.col("event_type")
    kind, conf = F.lit(OTHER_EVIDENCE[0]), F.lit(OTHER_EVIDENCE[1])
    for name, (k, c) in EVIDENCE.items():
        kind, conf = F.when(t == name, k).otherwise(kind), F.when(t == name, c).otherwise(conf)
    rows = _two(events, a, b)
    rows = numbered(rows.select(*dict.fromkeys([a, b, case, "event_type", "date", "source", *order])), [case], order, "n").withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})
    name = F.concat(F.lit("E"), F.col("n").cast("string"), F.lit("-"), F.coalesce(F.col(case).cast("string"), F.lit("")))
    return rows.select(name.alias("evidence_id"), case, "a", "b", kind.alias("kind"), conf.alias("confidence"), "date", "source")


def with_evidence(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attaches the number of evidence rows, and their distinct sources, dates and cases, to each pair (E8). Pairs without evidence get nulls."""
    gathered = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  distinct values, not rows
    e = evidence.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_evidence"), gathered("source").alias("sources"), gathered("date").alias("dates"), gathered("case_id").alias("cases"))
    return relationships.hint("merge").join(e.hint("merge"), ["a", "b"], "left")


def filter_evidence(evidence: DataFrame, case=None, evidence_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Evidence rows by case, id and kind; what is left out does not matter."""
    for c, v in (("case_id", case), ("evidence_id", evidence_id), ("kind", kind)):
        evidence = evidence if v is None else evidence.where(F.col(c) == v)
    return evidence


def latest_decisions(feedback: DataFrame, relationship: str, decision: str, *order: str) -> DataFrame:
    """Per relationship: the last decision, how many there are, and how many of each kind (E11). order tells which row is last."""
    last = F.max_by(decision, F.struct(*order)).alias("decision")
    kinds = [F.count_if(F.col(decision) == x).alias(f"n_{x}") for x in ("relevant", "incorrect", "needs_review")]
    return feedback.groupBy(relationship).agg(last, F.count(F.lit(1)).alias("n_decisions"), *kinds)


def filter_relationships(rel: DataFrame, strength: str | None = None, signal: str | None = None, evidence: DataFrame | None = None, case=None) -> DataFrame:
    """By strength, by a signal that is present, by case through the evidence."""
    if strength:
        rel = rel.where(F.col("strength") == strength)
    if signal:
        rel = rel.where(F.col(signal) > 0)
    if case is not None:
        rel = rel.hint("merge").join(evidence.where(F.col("case_id") == case).select("a", "b").distinct().hint("merge"), ["a", "b"], "left_semi")
    return rel


def upsert(old: DataFrame, new: DataFrame, keep: str = "decision") -> DataFrame:
    """New scores, strengths and signals replace old ones; the analyst's decision stays (E10). Every other column of new is carried along."""
    cells = [c for c in new.columns if c not in ("a", "b")]
    o = old.select("a", "b", keep, *[(F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType)).alias(f"old_{c}") for c in cells], F.lit(True).alias("__old"))
    met = new.withColumn("__new", F.lit(True)).hint("merge").join(o.hint("merge"), ["a", "b"], "full_outer")
    return met.select("a", "b", *[F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in cells], keep)
