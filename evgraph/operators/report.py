"""Reports (T1-T16): timelines, search, profiles, top-k, access and activity.

What is not known stays null; empty tables give empty reports. Sections whose size grows with a person or case are rows, never one nested value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.functions import scalars as C
from evgraph.session import few


def timeline(events: DataFrame, person=None, case=None, kind: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Dated events, filtered; position in the order of date, time (null last in its day) and id."""
    rows = events.where(F.col("date").isNotNull())
    if person is not None:
        rows = rows.where((F.col("person_a") == person) | (F.col("person_b") == person))
    for c, v in (("case_id", case), ("event_type", kind)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    rows = rows if first is None else rows.where(F.col("date") >= first)
    return rows if last is None else rows.where(F.col("date") <= last)



def sort_timeline(rows: DataFrame, *ids: str) -> DataFrame:
    time = F.coalesce("time", F.lit("99:99")) if "time" in rows.columns else F.lit("99:99")
    return rows.orderBy("date", time, *ids)


def _when(ids: list[str]) -> list[Column]:
    return [F.coalesce("date", F.lit("")).alias("d"), F.coalesce("time", F.lit("")).alias("t"), *map(F.col, ids)]


def temporal_summary(events: DataFrame, by: str, ids: list[str], first: int = 50) -> DataFrame:
    """Per key (T2): events, timed_events (with a date or time), earliest and latest of them, and the first `first` in order of date, time and ids.

    events has date and time; ids tells events of one moment apart. Keys without timed events have nulls and an empty list.
    """
    cells = [c for c in ("date", "time", *ids)]
    timed = F.col("date").isNotNull() | F.col("time").isNotNull()
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.count_if(timed).alias("timed_events"))
    rows = events.where(timed).withColumn("at", F.struct(*_when(ids))).withColumn("cell", F.struct(*cells))
    ends = rows.groupBy(by).agg(F.min_by("cell", "at").alias("earliest"), F.max_by("cell", "at").alias("latest"))
    n = F.row_number().over(Window.partitionBy(by).orderBy("at"))  # each task keeps its first few before the shuffle
    head = rows.select(by, "at", "cell").withColumn("n", n).where(F.col("n") <= first)
    head = head.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "cell"))), lambda x: x["cell"]).alias("sequence"))
    out = counts
    for part in (ends, head):
        part = part.withColumnRenamed(by, "__by")
        out = out.hint("merge").join(part.hint("merge"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    empty = F.array().cast(out.schema["sequence"].dataType)
    return out.withColumn("sequence", F.coalesce("sequence", empty))


def search(term: str, limit: int | None = None, **parts: tuple[DataFrame, str, str]) -> DataFrame:
    """kind, id, value of rows whose text contains term in any case."""
    rows = None
    for kind, (df, key, text) in parts.items():
        hit = df.where(F.lower(text).contains(term.lower())).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(text).alias("value"))
        rows = hit if rows is None else rows.unionByName(hit)
    return rows.orderBy("kind", "id").limit(limit) if limit else rows


def write_search_index(path: str, parts: int = 256, **tables: tuple[DataFrame, str, str]) -> None:
    """Writes postings for search_index(): every row of the tables under each trigram of its text, so meant for names and other short texts.

    Postings are dealt out to `parts` folders by trigram and lie in order of trigram within a file, so a probe opens one folder and skips what is beside
    it. Texts of less than three characters have one posting under the text itself; null texts have none. A repeated write replaces the index.
    """
    rows = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(text).alias("value")) for kind, (df, key, text) in tables.items()]
    rows = reduce(DataFrame.unionByName, rows).where("value IS NOT NULL").withColumn("form", F.lower("value"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("form") - 2, F.lit(1))), lambda at: F.col("form").substr(at, F.lit(3)))
    rows = rows.select("kind", "id", "value", F.explode(F.array_distinct(cut)).alias("gram")).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int"))
    rows = rows.hint("rebalance", "part").sortWithinPartitions("part", "gram", "kind", "id")  # a trigram that many rows have is split
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    held = rows.sparkSession.read.schema("gram string, part int").parquet(f"{path}/postings")
    held.groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts")


def search_index(spark: SparkSession, path: str, term: str, parts: int = 256) -> DataFrame:
    """kind, id, value of rows whose text contains term in any case, as search() gives them: the term's rarest trigram is probed, then verified.

    parts is that of the index. A term of less than three characters is looked for in all postings, each row once.
    """
    term = term.lower()
    postings = spark.read.schema("kind string, id string, value string, gram string, part int").parquet(f"{path}/postings")
    if len(term) < 3:
        return postings.where(F.lower("value").contains(term) & (F.col("gram") == F.substring(F.lower("value"), 1, 3))).select("kind", "id", "value")
    grams = sorted({term[k : k + 3] for k in range(len(term) - 2)})
    place = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int").alias("part"))
    part = {r["gram"]: r["part"] for r in place.collect()}
    counts = spark.read.schema("gram string, n long, part int").parquet(f"{path}/counts")
    known = counts.where(F.col("part").isin(sorted(set(part.values()))) & F.col("gram").isin(grams)).collect()  # a row a trigram of the term
    rarest = min(known, key=lambda r: (r["n"], r["gram"]))["gram"] if len(known) == len(grams) else None
    if rarest is None:
        return postings.where(F.lit(False)).select("kind", "id", "value")
    found = postings.where((F.col("part") == part[rarest]) & (F.col("gram") == rarest))
    return found.where(F.lower("value").contains(term)).select("kind", "id", "value")


def _sides(rows: DataFrame, a: str, b: str, *cells: str) -> DataFrame:
    """One row per person of a pair: person, other, cells."""
    side = lambda x, y: rows.select(F.col(x).alias("person"), F.col(y).alias("other"), *cells)
    return side(a, b).unionByName(side(b, a).where(F.col("person") != F.col("other"))).where("person IS NOT NULL")


def profile(events: DataFrame, identifiers: DataFrame, relationships: DataFrame) -> DataFrame:
    """Per person: cases, events by kind, identifiers, relationships and best score; what is not known stays null (T4)."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    sides = _sides(events, "person_a", "person_b", "event_type", "case_id")
    by_event = sides.groupBy("person").agg(F.count_distinct("case_id").alias("n_cases"), F.count(F.lit(1)).alias("events"), n("CALL").alias("calls"), n("TRANSACTION").alias("transactions"))
    by_id = identifiers.groupBy("person").agg(F.count_distinct("kind", "value").alias("n_identifiers"))
    by_rel = _sides(relationships, "a", "b", "score").groupBy("person").agg(F.count(F.lit(1)).alias("n_relationships"), F.max("score").alias("best"))
    for part in (by_id, by_rel):
        by_event = by_event.hint("merge").join(part.hint("merge"), "person", "left")
    return by_event


def profile_details(events: DataFrame, identifiers: DataFrame, relationships: DataFrame, evidence: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """What a profile lists, as rows (T4): person, section, kind, value, other, date, score.

    Sections: identifier (kind and value, once each), case (of events and, with entities (person, case_id), of linked entities, once each), event (kind, the other person,
    date), relationship (value is the strength) and evidence (kind, value is its id).
    """
    no = {"kind": "string", "value": "string", "other": "string", "date": "string", "score": "double"}

    def section(name: str, rows: DataFrame, **cells: str | Column) -> DataFrame:
        found = [(F.col(cells[c]) if isinstance(cells.get(c), str) else cells.get(c, F.lit(None))).cast(t).alias(c) for c, t in no.items()]
        return rows.select(F.col("person").cast("string").alias("person"), F.lit(name).alias("section"), *found)

    sides = _sides(events, "person_a", "person_b", "event_type", "case_id", "date")
    cases = sides.select("person", "case_id")
    if entities is not None:
        cases = cases.unionByName(entities.select("person", "case_id"))
    parts = [
        section("identifier", identifiers.select("person", "kind", "value").distinct(), kind="kind", value="value"),
        section("case", cases.where("case_id IS NOT NULL").distinct(), value="case_id"),
        section("event", sides, kind="event_type", other="other", date="date"),
        section("relationship", _sides(relationships, "a", "b", "score", "strength"), value="strength", other="other", score="score"),
        section("evidence", _sides(evidence, "a", "b", "evidence_id", "kind", "date", "confidence"), kind="kind", value="evidence_id", other="other", date="date", score="confidence"),
    ]
    return reduce(DataFrame.unionByName, parts)


def case_context(events: DataFrame, evidence: DataFrame, relationships: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per case: people, events, evidence, relationships with evidence in it, sources and days (T5); cases (case_id) limits them."""
    if cases is not None:
        wanted = few(cases.select("case_id").distinct(), "cases")
        events, evidence = (df.join(wanted, "case_id", "left_semi") for df in (events, evidence))
    sides = _sides(events, "person_a", "person_b", "case_id")
    people = sides.groupBy("case_id").agg(F.count_distinct("person").alias("people"))
    base = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("source").alias("sources"), F.count_distinct("date").alias("days"))
    proof = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence"))
    pairs = evidence.select("case_id", "a", "b").distinct().hint("merge").join(relationships.select("a", "b").hint("merge"), ["a", "b"], "left_semi")
    links = pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("relationships"))
    for part in (people, proof, links):
        base = base.hint("merge").join(part.hint("merge"), "case_id", "left")
    return base.na.fill(0, ["people", "evidence", "relationships"])


def first_rows(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first k rows of each key in order, numbered (T5, the capped lists of a context)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))  # each task keeps its first few before the shuffle
    return rows.withColumn("n", n).where(F.col("n") <= k)


def cross_case(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per case the relationships with evidence in it, by strength."""
    cases = evidence.select("case_id", "a", "b").distinct()
    n = lambda s: F.count_if(F.col("strength") == s)
    met = cases.hint("merge").join(relationships.select("a", "b", "strength").hint("merge"), ["a", "b"])
    return met.groupBy("case_id").agg(n("STRONG").alias("strong"), n("MODERATE").alias("moderate"), n("WEAK").alias("weak"))


def entity_detail(entities: DataFrame, cases: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """Entities (id, type, normalized, case_id, document_id) with case_name, document_name and the number of linked people (T9); unknown ones are null, no people 0."""
    people = links.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("person").alias("people"))
    named = cases.select("case_id", F.col("name").alias("case_name")), documents.select("document_id", F.col("name").alias("document_name")), people
    rows = entities
    for key, part in zip(("case_id", "document_id", "id"), named):
        rows = rows.hint("merge").join(part.hint("merge"), key, "left")
    return rows.na.fill(0, ["people"])


def find_entity(entities: DataFrame, kind: str, value: str) -> DataFrame:
    """The entity of that type and normalised value, of several the one with the lowest id."""
    return entities.where((F.col("type") == kind) & (F.col("normalized") == C.norm_value(F.lit(kind), F.lit(value)))).orderBy("id").limit(1)


def top_k(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in order."""
    return rows.orderBy(*order).limit(k)


def most_connected(relationships: DataFrame) -> DataFrame:
    """The person with the most links, ties to the least id."""
    both = relationships.select(F.col("a").alias("person")).union(relationships.select("b"))
    return both.groupBy("person").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "person").limit(1)


def in_scope(rows: DataFrame, assigned: DataFrame, case: str = "case_id", user=None, admin: bool = False) -> DataFrame:
    """Rows of the cases that a user is assigned to (T10); assigned has the case and, if `user` is given, user_id. Admins see all rows, those without a case too."""
    if admin:
        return rows
    mine = assigned if user is None else assigned.where(F.col("user_id") == user)
    return rows.join(few(mine.select(case).distinct(), "assigned"), case, "left_semi")


def latest_activity(log: DataFrame, user: str = "user_id", action: str = "action", login: str = "login") -> DataFrame:
    """Per user: last_login and last_activity (T11); users who never logged in have a null."""
    return log.groupBy(user).agg(F.max(F.when(F.col(action) == login, F.col("ts"))).alias("last_login"), F.max("ts").alias("last_activity"))


def status_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts per value, with subtotals and the grand total as nulls."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """table, n: the size of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def audit_tail(log: DataFrame, users: DataFrame, last: int = 500) -> DataFrame:
    """The latest rows of the log with the user's name, "system" where there is none (T14). log: event_id, ts, user_id, action; users: user_id, name."""
    tail = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    rows = tail.join(users.select("user_id", "name"), "user_id", "left")
    return rows.select("event_id", "ts", F.coalesce("name", F.lit("system")).alias("who"), "action").orderBy(F.desc("ts"), F.desc("event_id"))


def overview(log: DataFrame, assigned: DataFrame, recent: int = 5, **names: str) -> DataFrame:
    """Per user (T15): assigned cases, last login and activity, last action and the `recent` cases worked on last, newest first.

    log: user_id, action, item, ts, event_id; assigned: user_id, case_id. Users without activity have nulls and an empty list.
    """
    cases = assigned.groupBy("user_id").agg(F.count_distinct("case_id").alias("cases"))
    last = log.groupBy("user_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("last_action"))
    items = recent_distinct(log.where("item IS NOT NULL"), "user_id", "item", recent).groupBy("user_id")
    items = items.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("recent"))
    rows = cases
    for part in (latest_activity(log, **names), last, items):
        rows = rows.hint("merge").join(part.hint("merge"), "user_id", "full_outer")
    return rows.withColumn("recent", F.coalesce("recent", F.array().cast(rows.schema["recent"].dataType))).na.fill(0, ["cases"])


def recent_distinct(log: DataFrame, user: str, item: str, k: int = 5) -> DataFrame:
    """The k newest distinct items of each user."""
    last = log.groupBy(user, item).agg(F.max(F.struct("ts", "event_id")).alias("at"))
    n = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("at")))
    return last.withColumn("n", n).where(F.col("n") <= k).select(user, item, "n")


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Parents with their children as a sorted array (T16); parents without any have an empty one."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children"))
    empty = F.array().cast(rows.schema["children"].dataType)
    return parents.hint("merge").join(rows.hint("merge"), key, "left").withColumn("children", F.coalesce("children", empty))
