"""How many similar pairs meet in the tables of near-dedup, by similarity and length of text."""

import random

import numpy as np
import pytest

from evgraph.llm import simhash
from evgraph.llm.simhash import BOTH, WIDE, _majority, _masks, _mixed, _tables, shingle_hashes


def pairs(words, least, most, count, seed=0):
    """Made pairs of texts whose 5-word shingles have a similarity in [least, most)."""
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        copy, cut = list(base), rng.randint(0, max(1, words // 8))
        for at in rng.sample(range(words), rng.randint(0, max(1, words // 25))):
            copy[at] = f"x{rng.randrange(10**6)}"
        copy = copy[cut:] if rng.random() < 0.5 else copy + [f"y{rng.randrange(10**6)}" for _ in range(cut)]
        h, k = (shingle_hashes(" ".join(x), 5)[0] for x in (base, copy))
        both = len(np.intersect1d(h, k))
        if least <= both / (len(np.unique(h)) + len(np.unique(k)) - both) < most:
            out.append((h, k))
    return out


def meets(h, k):
    bits = [(_majority(f(h)) ^ _majority(f(k))) for f in (lambda x: x, _mixed)]
    apart = [x.bit_count() for x in bits]
    return apart[0] <= WIDE and sum(apart) <= BOTH and any(not (bits[0] & m % (1 << 64)) and not (bits[1] & n % (1 << 64)) for m, n in _masks())


@pytest.mark.parametrize("words", [30, 150, 2000])
@pytest.mark.parametrize("least, most, recall", [(0.8, 0.85, 0.9), (0.85, 0.9, 0.98), (0.9, 1.0, 0.995)])
def test_recall(words, least, most, recall):
    found = [meets(*p) for p in pairs(words, least, most, 100 if words == 2000 else 200)]
    print(f"{words} words, {least}-{most}: {np.mean(found):.3f}")
    assert np.mean(found) >= recall


def test_masks_are_disjoint_within_a_shuffle():
    masks = [(m % (1 << 64)) | (n % (1 << 64)) << 64 for m, n in _masks()]
    assert len(set(masks)) == simhash.TABLES and {m.bit_count() for m in masks} == {simhash.KEY_BITS}
    assert sum(masks[:6]).bit_count() == 6 * simhash.KEY_BITS


def test_sizes_within_the_ratio_share_a_band(spark):
    sizes = [*range(0, 70), 127, 128, 129, 511, 640, 1000, 1024, 1250, 1280]
    nodes = spark.createDataFrame([(n, 5, 7, n) for n in sizes], "node long, fp long, fp2 long, n int")
    keys = {}
    for r in _tables(nodes, 0.8).collect():
        keys.setdefault(r["n"], set()).add(r["key"])
    assert all(keys[a] & keys[b] for a in sizes for b in sizes if a and b and min(a, b) >= 0.8 * max(a, b))
    assert not keys[100 - 36] & keys[1000]


def test_hot_buckets_are_divided(spark, monkeypatch):
    """The same texts in chunks of three, with either join, give the same components."""
    from evgraph.llm.simhash import keep_one

    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(40):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{k}"
        docs.append((k, " ".join(copy)))
    docs += [(100 + k, " ".join(f"z{rng.randrange(9999)}" for _ in range(60))) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {0, *range(100, 120)}
    assert {r["doc_id"] for r in keep_one(df).collect()} == want
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(simhash.near_pairs, "__defaults__", (5, 0.8, 1, 3))
    assert {r["doc_id"] for r in keep_one(df).collect()} == want
