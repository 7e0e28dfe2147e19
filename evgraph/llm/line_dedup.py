"""Line dedup by winnowing [native].

A text is cut before every line that has a word, so a segment is a line and the blank lines behind it. Each segment is
hashed (two 64-bit hashes of the trimmed line) and counted in words.

- A gram is the shortest run of segments from some line on with `noise_words` words or more; its hash covers all its lines.
- A window is the shortest run with `sure_words` words or more, from some line on or up to some line; of the grams inside it, the one
  with the least hash is selected. Equal windows select equal grams, so every repeated run of `sure_words` words consists of windows
  whose fingerprints are held at several places, and no run below `noise_words` words is ever deleted.
- Windows with such a fingerprint (only those) are joined by the hash of all their lines to the first document of the corpus that holds the
  whole window (least doc_id, then position), not to each other; inside a document to the place before. Both places' line hashes are laid
  side by side at that offset. Matching lines extend the window both ways, and matching runs of noise_words or more are the later
  repeats, which are deleted. So every window that occurred before goes as a whole, whatever other places share a part of it.

A gram that a third of the documents share is one row per document in the join and one row after partial aggregation; nothing
is gathered but the runs of one document.

Defined cases: a null text stays null; a text without words stays as it is; documents that share both id and text are one document
(each row of it loses the same lines, none loses them to the other); ties go to the smaller id, null first; a text may become empty; columns and rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, let, row_key, running, whole_row
from evgraph.session import stored

NOISE_WORDS, SURE_WORDS = 40, 50
CUT = r"\n(?=[ \t\x0B\f\r]*[^ \t\x0B\f\r\n])"
WORD = r"[^\x20\x09-\x0D]+"
EDGES = " \t\n\x0b\f\r"


def _reach(words: Column, start: Column, least: int) -> Column:
    """Segments from start (0-based) until their words reach least; null if they never do. Each has a word, so `least` segments are enough."""
    sums = F.aggregate(
        F.slice(words, start + 1, least),
        F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")),
        lambda acc, x: F.when(acc["w"] >= least, acc).otherwise(F.struct((acc["w"] + x).alias("w"), (acc["n"] + 1).alias("n"))),
    )
    return F.when(sums["w"] >= least, sums["n"])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, id, h and g (two hashes of each segment), w (its words); texts without words are left out."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(row_key(F.col("id"), F.col("text")).alias("key"), "id", F.split("text", CUT, -1).alias("segments"))
    line = lambda s: F.btrim(s, F.lit(EDGES))
    return rows.select(
        "key", "id",
        F.transform("segments", lambda s: F.xxhash64(line(s))).alias("h"),
        F.transform("segments", lambda s: F.xxhash64(F.lit(1), line(s))).alias("g"),
        F.transform("segments", lambda s: F.regexp_count(s, F.lit(WORD)).cast("int")).alias("w"),
    )


def selections(signed: DataFrame, noise_words: int, sure_words: int) -> DataFrame:
    """signed with s: start and stop of each window and its selected gram (f, two hashes; pos)."""
    at = lambda a: F.sequence(F.lit(0), F.size(a) - 1)
    reach = lambda i: F.struct(_reach(F.col("w"), i, noise_words).alias("n"), _reach(F.col("w"), i, sure_words).alias("on"), _reach(F.col("v"), F.size("v") - 1 - i, sure_words).alias("back"))
    rows = signed.withColumn("v", F.reverse("w")).withColumn("r", F.transform(at("w"), reach))

    def gram(r: Column, i: Column) -> Column:
        cut = lambda c: F.slice(c, i + 1, F.coalesce(r["n"], F.lit(0)))
        return F.struct(F.xxhash64(cut("h")).alias("f"), F.xxhash64(cut("g")).alias("f2"), i.alias("pos"), r["n"].alias("n"))

    span = lambda start, stop: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))
    new = lambda r, i: ~F.get("r", i + 1 - r["back"])["on"].eqNullSafe(r["back"])  # noqa: E731  no forward window as well
    spans = F.concat(F.transform("r", lambda r, i: span(i, i + r["on"])), F.transform("r", lambda r, i: F.when(new(r, i), span(i + 1 - r["back"], i + 1))))
    spans = F.filter(spans, lambda x: x["start"].isNotNull() & x["stop"].isNotNull())
    rows = rows.select(*signed.columns, F.transform("r", gram).alias("grams"), spans.alias("spans"))
    spans = F.filter("spans", lambda x: x["stop"] <= F.size("grams"))  # all; grams used twice is computed once, not in each step of the lambda

    def select(x: Column) -> Column:
        inside = F.filter(F.slice("grams", x["start"] + 1, x["stop"] - x["start"]), lambda y: y["pos"] + y["n"] <= x["stop"])
        least = F.array_min(F.transform(inside, lambda y: F.struct(y["f"].alias("f"), y["f2"].alias("f2"), y["pos"].alias("pos"))))
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), least.alias("gram"))

    return rows.select(*signed.columns, F.transform(spans, select).alias("s"))


def fingerprints(signed: DataFrame, noise_words: int, sure_words: int) -> DataFrame:
    """key, f, f2 and pos of the selected grams."""
    grams = let(F.array_sort(F.transform("s", lambda x: x["gram"])), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))
    return selections(signed, noise_words, sure_words).select("key", F.explode(grams).alias("m")).select("key", "m.*")


def _of_shared(s: Column, shared: Column) -> Column:
    """The windows of s whose gram is in `shared`, found by sorting both together: what is shared comes before the windows that have it."""
    ends = F.concat(
        F.transform(shared, lambda f: F.struct(f.alias("f"), F.lit(-1).alias("at"))), F.transform(s, lambda x, i: F.struct(x["gram"]["f"].alias("f"), i.cast("int").alias("at"))),
    )

    def found(a: Column) -> Column:
        marks = running(F.transform(a, lambda x, i: F.when(x["at"] < 0, i.cast("int")).otherwise(-1)), lambda x, y: F.greatest(x, y), -1)
        pick = lambda m: F.filter(F.transform(a, lambda x, i: F.when(F.get(a, F.get(m, i))["f"] == x["f"], x["at"])), lambda at: at >= 0)
        return let(marks, pick)

    return F.transform(let(F.array_sort(ends), found), lambda at: F.get(s, at))


def windows(signed: DataFrame, noise_words: int, sure_words: int) -> DataFrame:
    """key, id, f (two hashes of the whole window), pos and before (the place of the same window before it in the document, or null), where the gram is in `shared`."""
    cut = lambda c, x: F.slice(c, x["start"] + 1, x["stop"] - x["start"])
    hashed = F.transform(_of_shared(F.col("s"), F.col("shared")), lambda x: F.struct(F.xxhash64(cut("h", x)).alias("f"), F.xxhash64(cut("g", x)).alias("f2"), x["start"].alias("pos")))
    rows = selections(signed, noise_words, sure_words).select("key", "id", F.array_sort(hashed).alias("s"))  # by hash, then position
    same = lambda x, y: (x["f"] == y["f"]) & (x["f2"] == y["f2"])
    before = lambda x, i: F.when((i > 0) & same(F.get("s", i - 1), x), F.get("s", i - 1)["pos"])
    marked = F.transform("s", lambda x, i: F.struct(x["f"].alias("f"), x["f2"].alias("f2"), x["pos"].alias("pos"), before(x, i).alias("before")))
    return rows.select("key", "id", F.explode(marked).alias("m")).select("key", "id", "m.*")


def _equal_runs(noise_words: int) -> Column:
    """Runs (start, stop) of segments that equal those of the earlier place at the same offset, of noise_words or more."""
    start = F.greatest(F.lit(0), F.col("shift"))
    count = F.least(F.size("h") - start, F.size("h0") - (start - F.col("shift")))
    side = lambda c, at: F.slice(c, at + 1, count)
    pairs = F.arrays_zip(
        side("h", start).alias("a"), side("h0", start - F.col("shift")).alias("b"), side("g", start).alias("c"), side("g0", start - F.col("shift")).alias("d"), side("w", start).alias("w")
    )
    none = F.array().cast("array<struct<start:int,stop:int>>")
    state = lambda at, run, words, out: F.struct(at.alias("at"), run.alias("run"), words.alias("words"), out.alias("out"))
    closed = lambda acc: F.when(acc["words"] >= noise_words, F.concat(acc["out"], F.array(F.struct((acc["at"] - acc["run"]).alias("start"), acc["at"].alias("stop"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        equal = (x["a"] == x["b"]) & (x["c"] == x["d"])
        return F.when(equal, state(acc["at"] + 1, acc["run"] + 1, acc["words"] + x["w"], acc["out"])).otherwise(state(acc["at"] + 1, F.lit(0), F.lit(0), closed(acc)))

    return F.aggregate(pairs, state(start, F.lit(0), F.lit(0), none), step, closed)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise_words: int = NOISE_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """key, runs: the segments (start, stop) of each document that repeat earlier ones. Documents without any are left out."""
    signed = stored(signatures(docs, id_col, text_col), "line-signatures")
    prints = stored(fingerprints(signed, noise_words, sure_words), "line-fingerprints")
    several = prints.groupBy("f", "f2").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("f", "f2")
    several = stored(several, "line-several")  # bare join sides here and below: a fingerprint that many texts hold can be split
    several = prints.select("f", "f2", "key").distinct().hint("merge").join(several.hint("merge"), ["f", "f2"]).groupBy("key").agg(F.collect_set("f").alias("shared"))
    held = signed.dropDuplicates(["key"]).hint("merge").join(stored(several, "line-shared").hint("merge"), "key")
    places = stored(windows(held, noise_words, sure_words), "line-windows")
    own = places.where("before IS NOT NULL").select("key", F.col("key").alias("key0"), (F.col("pos") - F.col("before")).alias("shift"))

    leads = places.where("before IS NULL").select("f", "f2", "key", "id", "pos")
    first = leads.groupBy("f", "f2").agg(F.min(F.struct("id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1").select("f", "f2", "first")
    first = stored(first, "line-first")
    meet = leads.hint("merge").join(first.hint("merge"), ["f", "f2"]).where(F.col("key") != F.col("first.key"))
    pairs = meet.select("key", F.col("first.key").alias("key0"), (F.col("pos") - F.col("first.pos")).alias("shift")).unionByName(own).distinct()
    pairs = stored(pairs, "line-pairs")

    lines = stored(signed.select("key", "h", "g", "w").dropDuplicates(["key"]), "line-hashes")  # bare sides: either join can be split where a key is hot
    left = stored(pairs.hint("merge").join(lines.hint("merge"), "key"), "line-left")
    both = left.hint("merge").join(lines.select(F.col("key").alias("key0"), F.col("h").alias("h0"), F.col("g").alias("g0")).hint("merge"), "key0")
    extended = stored(both.select("key", F.explode(_equal_runs(noise_words)).alias("run")), "line-extended")
    return extended.distinct().groupBy("key").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise_words: int = NOISE_WORDS, sure_words: int = SURE_WORDS, removed_col: str | None = None
) -> DataFrame:
    """docs with later repeated runs deleted from the text, plus removed_col, if named (segments deleted from that row)."""
    runs = stored(repeated_runs(docs, id_col, text_col, noise_words, sure_words), "line-runs")
    keyed = docs.select(whole_row(docs).alias("row"), row_key(column(id_col), column(text_col)).alias("key"))
    met = keyed.hint("merge").join(runs.hint("merge"), "key", "left")
    text = F.col("row")[text_col]
    known = F.struct(F.split(text, CUT, -1).alias("segments"), F.col("runs").alias("runs"), running(F.transform("runs", lambda r: r["stop"]), lambda x, y: F.greatest(x, y)).alias("stops"))

    def stay(v: Column) -> Column:
        """The segments between the runs, which are in order of start and may overlap."""
        before = lambda k: F.when(k > 0, F.get(v["stops"], k - 1)).otherwise(F.lit(0))
        parts = F.transform(v["runs"], lambda r, k: F.slice(v["segments"], before(k) + 1, F.greatest(r["start"] - before(k), F.lit(0))))
        last = F.element_at(v["stops"], -1)
        left = F.concat(F.flatten(parts), F.slice(v["segments"], last + 1, F.greatest(F.size(v["segments"]) - last, F.lit(0))))
        return F.struct(F.array_join(left, "\n").alias("text"), (F.size(v["segments"]) - F.size(left)).cast("long").alias("removed"))

    met = met.select("row", F.when(F.col("runs").isNotNull(), let(known, stay)).alias("stay"))
    kept = F.when(F.col("stay").isNotNull(), F.col("stay.text")).otherwise(text)
    removed = F.coalesce("stay.removed", F.lit(0).cast("long"))
    columns = [(kept if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    return met.select(*columns, *([removed.alias(removed_col)] if removed_col else []))
