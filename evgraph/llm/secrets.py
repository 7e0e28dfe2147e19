"""Secret scans [native]: known patterns and sliding-window Shannon entropy.

Everything is a Spark column expression. Spans are code points, end exclusive.

Base spans per kind are the leftmost non-overlapping matches: the pieces between matches (split) and the matches
themselves (regexp_extract_all) give every position by prefix sums, so many matches in one text cost little more than few. Matches that fail a
length rule are dropped after matching, so they still use up their text.

Entropy spans come from what base spans leave of the text: candidates are maximal runs of token characters, in addresses and paths their
segments. A candidate counts if one window of `WINDOW` characters has a Shannon entropy that reaches the limit of the candidate's
character class (hexadecimal, letters only, or mixed). The window slides by incremental counts: five bits per character of the alphabet hold how often the window
has it, and the sum of c*log2(c) changes only by the terms of the character that leaves and the one that enters. These sums are whole numbers (scaled by 2^20),
so nothing depends on the order of additions. Candidates on the allow-list (UUIDs, plain numbers, ordered alphabets, placeholders) add nothing.

Defined cases: a null text counts as empty; empty texts have no spans; every input row gives one row; texts are read whole;
other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, id_and_text, let, running, whole_row

#: Kinds in their order, with pattern, least length, and the group that it counts for.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"  # a run of fewer hexadecimal digits fails as a whole, so it need not match
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

RUN_CHARS = "A-Za-z0-9+/_=-"
RUN = f"(?<![{RUN_CHARS}])[{RUN_CHARS}]{{20,}}"
WINDOW, SCALE = 20, 1 << 20
HEX_LIMIT, LETTERS_LIMIT, MIXED_LIMIT = 3.0, 3.9, 3.7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PER_WORD = 12  # counters of five bits in a word of 60
#: What looks random and is not secret.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|placeholder|changeme|your[_-]|xxxx",
    "(?i)0123456789|abcdefghij|qwertyuiop",
    "^[0-9+/_=-]+$",
)
#: A run that looks like an address or a path is judged by its segments.
PATH = "//|/[a-z]+/|^/"
BLOCK = 1024
TERMS = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]


def _term(count: Column) -> Column:
    """c*log2(c), scaled."""
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in TERMS]), (count + 1).cast("int"))


def _placed(gaps_and_hits: Column) -> Column:
    """array<struct<gap, hit>> -> array<struct<start, end, hit>>."""
    n = lambda m: m["gap"] + F.char_length(m["hit"])
    ends = running(F.transform(gaps_and_hits, n), lambda x, y: x + y)
    return F.zip_with(gaps_and_hits, ends, lambda m, e: F.struct((e - F.char_length(m["hit"])).alias("start"), e.alias("end"), m["hit"].alias("hit")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches."""
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    cells = let(both, lambda v: F.zip_with(F.slice(v["pieces"], 1, F.size(v["hits"])), v["hits"], lambda p, h: F.struct(F.char_length(p).alias("gap"), h.alias("hit"))))
    return let(cells, _placed)


def _spans(found: Column, kind: int, holds: Callable[[Column], Column]) -> Column:
    kept = F.filter(found, lambda m: holds(m["hit"]))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with every span (in order of start) replaced by mark(its length beyond earlier spans).

    The text is held in blocks of BLOCK characters, so that a piece is found without reading the text from its start.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    known = F.struct(blocks.alias("blocks"), spans.alias("spans"), running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)).alias("ends"))

    def piece(v: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        joined = F.array_join(F.slice(v["blocks"], first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, joined.substr(a - first * BLOCK + 1, b - a)).otherwise("")

    def cell(v: Column, s: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(v["ends"], k - 1)).otherwise(F.lit(0))
        return F.when(s["end"] > before, F.concat(piece(v, before, s["start"]), mark(s["end"] - F.greatest(s["start"], before)))).otherwise("")

    def whole(v: Column) -> Column:
        tail = piece(v, F.element_at(v["ends"], -1), F.lit(1 << 30))
        return F.concat(F.array_join(F.transform(v["spans"], lambda s, k: cell(v, s, k)), ""), tail)

    return F.when(F.size(spans) > 0, let(known, whole)).otherwise(text)


def _least_sum(run: Column) -> Column:
    """The least scaled sum of c*log2(c) over all windows: where entropy is highest."""

    def slot(ch: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), ch) - 1
        return F.struct(F.floor(at / PER_WORD).cast("int").alias("word"), (at % PER_WORD * 5).alias("shift"))

    def windows(chars: Column) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])
        count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["word"]), x["shift"]).bitwiseAND(F.lit(31))
        put = lambda counts, x, sign: F.transform(counts, lambda c, k: F.when(k == x["word"], c + bit(x) * sign).otherwise(c))
        state = lambda counts, now, least: F.struct(counts.alias("counts"), now.alias("now"), least.alias("least"))

        def leave(acc: Column, x: Column) -> Column:
            c = count(acc["counts"], x)
            return state(put(acc["counts"], x, -1), acc["now"] - _term(c) + _term(c - 1), acc["least"])

        def enter(acc: Column, x: Column) -> Column:
            c = count(acc["counts"], x)
            return state(put(acc["counts"], x, 1), acc["now"] - _term(c) + _term(c + 1), acc["least"])

        def step(acc: Column, i: Column) -> Column:
            left = F.when(i >= WINDOW, leave(acc, F.get(chars, i - WINDOW))).otherwise(acc)
            full = lambda s: F.when(i >= WINDOW - 1, state(s["counts"], s["now"], F.least(s["least"], s["now"]))).otherwise(s)
            return let(let(left, lambda s: enter(s, F.get(chars, i))), full)

        none = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER_WORD))
        start = state(none, F.lit(0).cast("long"), F.lit(1 << 62))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: acc["least"])

    return let(F.transform(F.split(run, ""), slot), windows)


def _is_random(run: Column) -> Column:
    limit = lambda bits: round((math.log2(WINDOW) - bits) * WINDOW * SCALE)  # noqa: E731  H >= bits, as a bound on the sum
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    most = F.when(run.rlike("^[0-9a-fA-F]+$"), limit(HEX_LIMIT)).when(run.rlike("^[A-Za-z+/_=-]+$"), limit(LETTERS_LIMIT)).otherwise(limit(MIXED_LIMIT))
    return F.when(allowed, F.lit(False)).otherwise(_least_sum(run) <= most)


def _candidates(runs: Column) -> Column:
    """Runs, those that look like a path as their segments of WINDOW characters or more."""

    def segments(m: Column) -> Column:
        cells = F.transform(F.split(m["hit"], "/", -1), lambda x, k: F.struct(F.when(k > 0, 1).otherwise(0).alias("gap"), x.alias("hit")))
        moved = F.transform(let(cells, _placed), lambda x: F.struct((x["start"] + m["start"]).alias("start"), (x["end"] + m["start"]).alias("end"), x["hit"].alias("hit")))
        return F.filter(moved, lambda x: F.char_length(x["hit"]) >= WINDOW)

    return F.flatten(F.transform(runs, lambda m: F.when(m["hit"].rlike(PATH), segments(m)).otherwise(F.array(m))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and spans: arrays of struct(start, kind, end), in order of start, then kind (index of KINDS)."""
    t = F.col("text")
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    guarded = lambda test, text, pattern: F.when(test, matches(text, pattern)).otherwise(empty)
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text",
        guarded((t.contains(":") | t.contains("=")) & t.rlike(ASSIGN), t, ASSIGN).alias("m0"),
        guarded(t.contains("AKIA"), t, ACCESS).alias("m1"),
        guarded(t.rlike(HEX), t, HEX).alias("m2"),
    )
    base = F.array_sort(F.concat(
        _spans(F.col("m0"), 0, lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_LEAST),
        _spans(F.col("m1"), 1, lambda h: F.char_length(h) >= ACCESS_LEAST),
        _spans(F.col("m2"), 2, lambda h: F.lit(True)),
    ))
    rows = rows.select("doc_id", "text", base.alias("base"))
    rows = rows.select("doc_id", "text", "base", replaced(t, F.col("base"), lambda n: F.repeat(F.lit(" "), n)).alias("rest"))
    rest = F.col("rest")
    rows = rows.select("doc_id", "text", "base", guarded(rest.rlike(RUN), rest, RUN).alias("m3"))
    more = _spans(_candidates(F.col("m3")), 3, _is_random)
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs, id_col, text_col)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of every text replaced by mark; rows, order of columns and null texts stay."""
    found = scan(docs.select(whole_row(docs).alias("__row"), column(text_col).alias("text")), "__row", "text")
    row = lambda c: F.col("doc_id")[c]
    clean = F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"), lambda n: F.lit(mark))).otherwise(row(text_col))
    return found.select(*[(clean if c == text_col else row(c)).alias(c) for c in docs.columns])
