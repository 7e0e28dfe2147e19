"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprints: 64 bits, the majority of the XXH64 hashes of a text's word shingles (numpy inside tasks).
2. Candidates: `cuts` blocks of bits; two fingerprints that differ in at most `radius` bits agree on cuts - radius blocks
   at least, so each choice of that many blocks is one table, and every pair within the radius meets in a bucket.
   Buckets of one fingerprint go; a bucket of more than `unit` is divided into chunks, and each pair of chunks is a
   unit of work of its own, so no task holds a whole hot bucket.
3. Comparison: the fingerprints of a unit are stored as vertical bit planes. The differences of 64 lanes at a time are counted in
   carry-save bitwise counters, plane by plane, and words are abandoned once all their lanes exceed the radius.
4. Links: a unit returns each fingerprint's least linked one, not its pairs; connected components join them up.

Equal fingerprints are one row throughout, so exact copies never meet each other.

keep_one goes further: its fingerprints only propose pairs of texts, and a pair counts if the exact Jaccard similarity of the two sets of
5-word shingles reaches 0.8. Two fingerprints of 64 bits each give TABLES keys of KEY_BITS bits; a key also holds the power of two that the size of the
set lies in (or nearly reaches). A bit differs with p = acos(2 J / (1 + J)) / pi, so a pair meets in one table with (1 - p) ** KEY_BITS: at J = 0.8 in one
of 23. By chance N texts meet in TABLES * N^2 / 2^(KEY_BITS + 1) pairs (N^2 / 2^13.6) of one band of sizes, and in about a fifth of that over all bands.
The bits and the sizes drop most others inside the unit. Where a unit holds many pairs (a large group of near copies), each text
is first verified against the least one. What this leaves in different groups is compared in chunks of texts of at most CHUNK_BYTES: a
task holds the shingles of two chunks, measures the proposed pairs that are not joined yet, and returns a forest of links, never pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; with fewer words than a
shingle the whole sequence is hashed; every input row gives one row; a null id is never a component's name unless all
are null; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import column, id_and_text, row_key, whole_row
from evgraph.operators.components import connected_components
from evgraph.session import stored

SHINGLE, SEED, RADIUS, CUTS, UNIT = 4, 42, 4, 6, 4096
NEAR_SHINGLE, NEAR, KEY_BITS, TABLES, WIDE, BOTH, NEAR_UNIT, BUFFER, CHUNK_BYTES, DENSE = 5, 0.8, 19, 84, 18, 34, 16384, 1 << 17, 1 << 25, 1
TASK_ROWS, FOREST_ROWS, BROADCAST_ROWS = 1 << 20, 1 << 22, 1 << 20
ONE = np.uint64(1)


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, bytes]:
    """The hash of every shingle, in order, and the normalised words as one string."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the ASCII blanks only
    if not words:
        return np.zeros(0, "<u8"), b""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], "<u8"), joined


def _majority(h: np.ndarray) -> int:
    ones, n = np.zeros(64, np.int64), len(h)
    for k in range(0, n, 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    return _majority(shingle_hashes(text, shingle, seed)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, key (of id and text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "fp": fp.view(np.int64)})

    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 x words: plane b holds bit b of every fingerprint, 64 lanes to a word."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-len(fp) // 64) * 64, 64), np.uint8)
    padded[: len(fp)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


class Counters:
    """Carry-save counters over words of 64 lanes: ones, twos, fours, and `out` for lanes that exceed the radius."""

    def __init__(self, out: np.ndarray, radius: int):
        self.out, self.radius = out, radius
        self.c = [np.zeros_like(out) for _ in range(radius.bit_length())]

    def add(self, difference: np.ndarray) -> None:
        carry = difference
        for c in self.c:
            both = c & carry
            c ^= carry
            carry = both
        self.out |= carry

    def exceed(self) -> np.ndarray:
        """Marks and returns the lanes that count more than radius."""
        above, equal = np.zeros_like(self.out), ~np.zeros_like(self.out)
        for k in reversed(range(len(self.c))):
            if self.radius >> k & 1:
                equal &= self.c[k]
            else:
                above |= equal & self.c[k]
                equal &= ~self.c[k]
        self.out |= above
        return self.out

    def keep(self, where: np.ndarray) -> None:
        self.out, self.c = self.out[where], [c[where] for c in self.c]


def _lanes(word_index: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in word_index, lane) of every set bit of words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return word_index[at], lane


def _query_blocks(fp: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within radius of one large unit: blocks of queries against all lanes."""
    planes = _planes(fp)
    n, words = len(fp), planes.shape[1]
    for q in range(0, n, block):
        query = fp[q : q + block]
        row, col = (x.ravel() for x in np.indices((len(query), words)))
        live = col * 64 + 63 > q + row  # words that hold a later lane
        row, col = row[live], col[live]
        count = Counters(np.zeros(len(row), np.uint64), radius)
        for b in range(64):
            mask = (~(query >> np.uint64(b) & ONE) + ONE)[row]  # all ones where the query has the bit
            count.add(planes[b][col] ^ mask)
            if b % 6 == 5:
                live = ~count.exceed() != 0
                if not live.all():
                    count.keep(live)
                    row, col = row[live], col[live]
                if not len(row):
                    break
        at, lane = _lanes(np.arange(len(row)), ~count.exceed()) if len(row) else (np.zeros(0, int), np.zeros(0, int))
        i, j = q + row[at], col[at] * 64 + lane
        right = (j > i) & (j < n)
        yield i[right], j[right]


def _query_pairs(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*_query_blocks(fp, radius)))


def _lag_pairs(fp: np.ndarray, unit: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within radius of many small units that lie one after the other: lane i against lane i + lag."""
    planes, found, lag = _planes(fp), [], 1
    while True:
        same = unit[lag:] == unit[:-lag]
        if not same.any():
            break
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[: len(same)] = same
        out = ~np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(~out)
        count = Counters(out[at], radius)
        skip, shift = divmod(lag, 64)
        for b in range(64):
            ahead = np.append(planes[b][skip:], np.zeros(skip + 1, np.uint64))
            moved = ahead[at] if not shift else (ahead[at] >> np.uint64(shift)) | (ahead[at + 1] << np.uint64(64 - shift))
            count.add(planes[b][at] ^ moved)
            if b % 6 == 5:
                live = ~count.exceed() != 0
                if not live.all():
                    count.keep(live)
                    at = at[live]
                if not len(at):
                    break
        if len(at):
            word, lane = _lanes(at, ~count.exceed())
            found.append((word * 64 + lane, word * 64 + lane + lag))
        lag += 1
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def pairs_of(fp: np.ndarray, unit: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of whole units, in order -> places (i, j), i < j, of all pairs within radius that share a unit."""
    edges = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    sizes = np.diff(np.append(edges, len(unit)))
    is_small = np.repeat(sizes <= small, sizes)
    at = np.flatnonzero(is_small)
    pairs = [tuple(at[x] for x in _lag_pairs(fp[at], unit[at], radius))] if len(at) else []
    for a, size in zip(edges[sizes > small], sizes[sizes > small]):
        pairs.append(tuple(a + x for x in _query_pairs(fp[a : a + size], radius)))
    return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))


def _least_label(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the least one that the pairs (i, j) lead to."""
    label = np.arange(size)
    while True:  # least label over links, with shortcuts
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of(fp: np.ndarray, unit: np.ndarray, radius: int, small: int = 64) -> pd.DataFrame:
    """Fingerprints of whole units, in order -> (src, dst): each fingerprint with the least one that its unit links it to."""
    label = _least_label(len(fp), *pairs_of(fp, unit, radius, small))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    signed = fp.view(np.int64)
    return pd.DataFrame({"src": signed[linked], "dst": signed[label[linked]]}).drop_duplicates()


def _keyed(rows: DataFrame, radius: int, cuts: int) -> DataFrame:
    """rows once per table t with the key of their bucket there."""
    edge = [round(64 * k / cuts) for k in range(cuts + 1)]
    tables = []
    for number, chosen in enumerate(combinations(range(cuts), cuts - radius)):
        mask = sum(((1 << edge[k + 1]) - (1 << edge[k])) for k in chosen)
        tables.append(F.struct(F.lit(number).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return rows.select(*rows.columns, F.explode(F.array(*tables)).alias("k")).select(*rows.columns, "k.t", "k.key")


def near_links(distinct: DataFrame, radius: int = RADIUS, cuts: int = CUTS, unit: int = UNIT) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) whose components are those of all pairs within radius."""
    keyed = _keyed(distinct, radius, cuts)
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.hint("merge").join(sizes.hint("merge"), ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / unit).cast("int"))
    mine = F.pmod(F.xxhash64("fp", "t"), F.col("chunks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("fp", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "unit").sortWithinPartitions("unit", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["unit"].to_numpy() == pdf["unit"].iloc[-1]  # may go on in the next batch
            rest, whole = pdf[last], pdf[~last]
            if len(whole):
                yield links_of(whole["fp"].to_numpy().astype(np.int64).view(np.uint64), whole["unit"].to_numpy(), radius)
        if rest is not None:
            yield links_of(rest["fp"].to_numpy().astype(np.int64).view(np.uint64), rest["unit"].to_numpy(), radius)

    return met.mapInPandas(compare, "src long, dst long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, how: dict) -> DataFrame:
    """doc_id, key, fp, component (its least fingerprint), component_id (its least doc_id)."""
    prints = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    component = connected_components(near_links(distinct.select("fp"), radius, **how)).withColumnRenamed("id", "fp")
    tied = distinct.hint("merge").join(component.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    tied = stored(tied, "simhash-tied")  # bare join sides: a hot component can be split
    names = stored(tied.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-names")
    of_fp = stored(tied.hint("merge").join(names.hint("merge"), "component").select("fp", "component", "component_id"), "simhash-components")
    return prints.hint("merge").join(of_fp.hint("merge"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **how) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id of its near-duplicate component)."""
    return _grouped(docs, id_col, text_col, radius, how).select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash from the first (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, node (hash of the normalised words), fp, fp2 (two fingerprints), n (different shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, fp, fp2, n = [], [], [], []
            for text in pdf["text"]:
                h, words = shingle_hashes(text, shingle)
                node.append(xxhash.xxh64_intdigest(words, 1))
                fp.append(_majority(h))
                fp2.append(_majority(_mixed(h)))
                n.append(len(np.unique(h)))
            signed = {c: np.array(x, np.uint64).view(np.int64) for c, x in (("node", node), ("fp", fp), ("fp2", fp2))}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], **signed, "n": np.array(n, np.int32)})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, node long, fp long, fp2 long, n int")


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node, s (its different shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingle_hashes(text, shingle) for text in pdf["text"]]
            node = np.array([xxhash.xxh64_intdigest(words, 1) for _, words in found], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": node, "s": [np.unique(h).view(np.int64) for h, _ in found]})

    return rows.mapInPandas(run, "node long, s array<long>")


def _whole_units(batches: Iterator[pd.DataFrame], least_rows: int = BUFFER) -> Iterator[pd.DataFrame]:
    """Batches in order of unit -> larger ones that end with a unit."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= least_rows:
            pdf = pd.concat(held, ignore_index=True)
            last = pdf["unit"].to_numpy() == pdf["unit"].iloc[-1]
            held, size = [pdf[last]], 0
            if not last.all():
                yield pdf[~last].reset_index(drop=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def _allowed(i: np.ndarray, j: np.ndarray, fp: np.ndarray, fp2: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Which pairs both fingerprints and the sizes of the shingle sets allow."""
    bits = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)).astype(int) + np.bitwise_count((fp2[i] ^ fp2[j]).view(np.uint64))
    return (bits <= BOTH) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)


def _proposed(pdf: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different texts that are worth a look."""
    fp, fp2, n = (pdf[c].to_numpy() for c in ("fp", "fp2", "n"))
    i, j = pairs_of(fp.astype(np.int64).view(np.uint64), pdf["unit"].to_numpy(), WIDE, small=512)
    right = _allowed(i, j, fp, fp2, n, least)
    return i[right], j[right]


def contracted(pairs: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) -> fewer pairs with the same components: each task joins up FOREST_ROWS pairs at a time, those of one b together, and returns forests."""

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in chain(batches, [None]):
            if pdf is not None and len(pdf):
                held.append(pdf)
                rows += len(pdf)
            if held and (pdf is None or rows >= FOREST_ROWS):
                ends = pd.concat(held)
                held, rows = [], 0
                node, place = np.unique(np.concatenate([ends["a"], ends["b"]]), return_inverse=True)
                label = _least_label(len(node), place[: len(ends)], place[len(ends) :])
                tied = np.flatnonzero(label != np.arange(len(node)))
                yield pd.DataFrame({"a": node[label[tied]], "b": node[tied]})

    return pairs.repartition(parts, "b").mapInPandas(forest, "a long, b long").distinct()


def _common(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], column: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """How many shingles the sets of each pair (i, j) share; many pairs by products of 0/1 matrices, a range of shingles at a time.

    column and owner are those of every shingle that two or more sets hold, in order of column.
    """
    if len(i) <= 2048:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    low, high = int(i.min()), int(i.max()) + 1
    total = np.zeros((high - low, len(sets)), np.float32)
    step = max(64, (1 << 23) // len(sets))
    for at in range(0, width, step):
        a, b = np.searchsorted(column, (at, at + step))
        held = np.zeros((len(sets), min(step, width - at)), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        total += held[low:high] @ held.T
    return total[i - low, j].astype(np.int64)


def forest_of(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """One unit of two chunks (or one) -> links (a, b) that join what its similar pairs join; pairs of one group or, of two chunks, one chunk are left out."""
    fp, fp2, n, node, side = (pdf[c].to_numpy() for c in ("fp", "fp2", "n", "node", "mine"))
    sets = [np.asarray(x, np.int64) for x in pdf["s"]]
    one = (side == side[0]).all()
    label = np.unique(pdf["group"].to_numpy(), return_inverse=True)[1]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    several = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner, width = column[order], owner[order], int((times > 1).sum())
    speaks = np.zeros(label.max() + 1, np.int64)  # a place of each label
    speaks[label[::-1]] = np.arange(len(label))[::-1]
    links = []
    for i, j in _query_blocks(fp.astype(np.int64).view(np.uint64), WIDE):
        right = (label[i] != label[j]) & (one | (side[i] != side[j]))
        i, j = i[right], j[right]
        right = _allowed(i, j, fp, fp2, n, least)
        i, j = i[right], j[right]
        if not len(i):
            continue
        both = _common(i, j, sets, column, owner, width)
        same = both >= least * (n[i] + n[j] - both) - 1e-9
        to = _least_label(len(speaks), label[i[same]], label[j[same]])
        moved = np.unique(label[np.concatenate([i[same], j[same]])])
        moved = moved[to[moved] != moved]
        links.append(np.stack([node[speaks[to[moved]]], node[speaks[moved]]]))
        label = to[label]
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _masks(tables: int = TABLES, bits: int = KEY_BITS) -> list[tuple[int, int]]:
    """The bits of the two fingerprints that each table looks at: disjoint ones of one shuffle of all 128, then of the next."""
    rng, out = np.random.default_rng(42), []
    while len(out) < tables:
        order = rng.permutation(128)
        for k in range(128 // bits):
            chosen = order[k * bits : (k + 1) * bits].tolist()
            signed = [sum(1 << (x % 64) for x in chosen if x // 64 == half) for half in (0, 1)]
            out.append(tuple(m - (1 << 64) if m >> 63 else m for m in signed))
    return out[:tables]


def _tables(nodes: DataFrame, least: float) -> DataFrame:
    """node, fp, fp2, n of each text with the name of its bucket in every table: one of its band of sizes, another where n / least lies in the next."""
    band = lambda n: F.length(F.bin(n))
    n = F.greatest("n", F.lit(1)).cast("long")
    bands = F.array_distinct(F.array(band(n), band(F.floor(n / least + 1e-9))))
    rows = nodes.select("node", "fp", "fp2", "n", F.explode(bands).alias("band"))
    keys = [F.xxhash64(F.lit(t), "band", F.col("fp").bitwiseAND(F.lit(one)), F.col("fp2").bitwiseAND(F.lit(two))) for t, (one, two) in enumerate(_masks())]
    return rows.select("node", "fp", "fp2", "n", F.explode(F.array(*keys)).alias("key"))


def _beside(rows: DataFrame) -> DataFrame:
    """A written table of few columns as the right side of a join: broadcast up to BROADCAST_ROWS (some 60 MB), so that texts stay where they are; merged beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def near_pairs(docs: DataFrame, nodes: DataFrame, shingle: int = NEAR_SHINGLE, least: float = NEAR, dense: int = DENSE, unit: int = NEAR_UNIT) -> DataFrame:
    """Links (a, b) between texts of a similarity of `least` or more, whose components are those of all such pairs that the tables propose.

    docs has key and text; nodes has node, key (of one of its documents), fp, fp2 and n. Units with more than `dense` pairs a text go through the groups.
    Only buckets of more than `unit` texts are divided, into chunks that meet in pairs.
    """
    keyed = _tables(nodes, least)
    hot = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > unit), "near-hot")
    met = keyed.join(_beside(hot), "key", "left")
    met = met.withColumn("chunks", F.ceil(F.coalesce("m", F.lit(1)) / unit).cast("int"))
    mine = F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("node", "fp", "fp2", "n", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TABLES // TASK_ROWS)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_units(batches):
            i, j = _proposed(pdf, least)
            node, of = pdf["node"].to_numpy(), pdf["unit"].to_numpy()
            number = np.cumsum(np.append(False, of[1:] != of[:-1]))
            lanes = np.zeros(len(pdf), bool)
            lanes[i] = lanes[j] = True
            many = np.bincount(number[i], minlength=number[-1] + 1) > dense * np.bincount(number[lanes], minlength=number[-1] + 1)
            few = ~many[number[i]]
            label = _least_label(len(pdf), i[~few], j[~few])
            star = np.flatnonzero(label != np.arange(len(pdf)))
            a, b = np.concatenate([node[i[few]], node[label[star]]]), np.concatenate([node[j[few]], node[star]])
            out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "dense": np.repeat([False, True], [int(few.sum()), len(star)])})
            yield out.drop_duplicates()

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_units(batches, 1):
            for _, part in pdf.groupby("unit", sort=False):
                yield forest_of(part, least)

    sorted_units = lambda rows: rows.repartition(parts, "unit").sortWithinPartitions("unit", "node")
    beside = Window.partitionBy("unit").orderBy("node")
    met = met.repartition(parts, "unit").withColumns({"before": F.lag("node").over(beside), "after": F.lead("node").over(beside)})
    met = met.where("before IS NOT NULL OR after IS NOT NULL").drop("before", "after")  # most texts are alone; still in order of unit and node
    found = stored(met.mapInPandas(compare, "a long, b long, dense boolean"), "near-found")
    first = stored(found.select("a", "b").distinct(), "near-first")
    wanted = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    keys = stored(wanted.hint("merge").join(nodes.select("node", "key").hint("merge"), "node").select("key"), "near-keys")
    sets = stored(_shingle_sets(docs.select("key", "text").join(_beside(keys), "key", "left_semi"), shingle).dropDuplicates(["node"]), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
        both = left.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common / (F.size("sa") + F.size("sb") - common) >= least).select("a", "b")

    links = stored(verified(first), "near-links")
    crowded = found.where("dense").select(F.col("a").alias("node")).distinct()
    if crowded.isEmpty():
        return links

    def parts_of(pairs: DataFrame, name: str) -> DataFrame:
        return stored(connected_components(contracted(pairs, parts), "a", "b").select(F.col("id").alias("node"), F.col("component").alias(name)), "near-known")

    cluster, group = parts_of(first, "cluster"), parts_of(links, "group")  # what proposals join, and what similar pairs join so far
    full = stored(crowded.hint("merge").join(cluster.hint("merge"), "node").select("cluster").distinct(), "near-full")
    lanes = stored(cluster.hint("merge").join(full.hint("merge"), "cluster", "left_semi"), "near-lanes")  # all texts of a crowded cluster
    lanes = lanes.hint("merge").join(nodes.select("node", "fp", "fp2", "n").hint("merge"), "node").hint("merge").join(group.hint("merge"), "node", "left")
    lanes = stored(lanes.withColumn("group", F.coalesce("group", "node")), "near-lanes")
    open_ = lanes.groupBy("cluster").agg(F.sum("n").alias("size"), F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1")
    open_ = stored(open_.select("cluster", F.ceil(F.col("size") * 8 / CHUNK_BYTES).cast("int").alias("chunks")), "near-open")
    lanes = lanes.hint("merge").join(open_.hint("merge"), "cluster").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    lanes = lanes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit")
    lanes = stored(lanes.select("node", "fp", "fp2", "n", "group", "mine", unit), "near-lanes")
    rest = sorted_units(lanes.hint("merge").join(sets.hint("merge"), "node")).mapInPandas(across, "a long, b long").distinct()
    return links.unionByName(stored(rest, "near-links"))


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """doc_id, key, component (its least node), component_id (its least doc_id)."""
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    prints = stored(_sketches(rows, shingle), "near-sketches")
    nodes = prints.groupBy("node").agg(F.min("key").alias("key"), *[F.min(c).alias(c) for c in ("fp", "fp2", "n")], F.min("doc_id").alias("least"))
    nodes = stored(nodes, "near-nodes")
    component = connected_components(near_pairs(rows, nodes, shingle, least), "a", "b").withColumnRenamed("id", "node")
    tied = nodes.select("node", "least").hint("merge").join(component.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    tied = stored(tied, "near-tied")
    names = stored(tied.groupBy("component").agg(F.min("least").alias("component_id")), "near-names")
    of_node = stored(tied.hint("merge").join(names.hint("merge"), "component").select("node", "component", "component_id"), "near-components")
    return prints.select("doc_id", "key", "node").hint("merge").join(of_node.hint("merge"), "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR) -> DataFrame:
    """docs with one row of each component of texts whose shingles are similar: that of the least id, of several such the one with the least key.

    Only the keys that go, or of which rows are repeated, meet the rows; all others pass as they are.
    """
    found = stored(_similar(docs, id_col, text_col, shingle, least).select("doc_id", "key", "component", "component_id"), "simhash-found")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("key").alias("key"))
    stays = stored(stays.select("key", F.lit(True).alias("stays")), "simhash-stays")
    times = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "simhash-times")
    named = times.hint("merge").join(stays.hint("merge"), "key", "left").where("m > 1 OR stays IS NULL")
    named = stored(named.select("key", F.coalesce("stays", F.lit(False)).alias("stays")), "simhash-named")
    rows = docs.select(whole_row(docs).alias("row"), row_key(column(id_col), column(text_col)).alias("key")).join(_beside(named), "key", "left")
    kept = rows.where("stays IS NULL").select("row")
    if not named.where("stays").isEmpty():  # repeated rows: the first of each in its task, then one of all
        kept = kept.union(rows.where("stays").dropDuplicates(["key"]).select("row"))
    return kept.select("row.*")
