import re

import numpy as np
import pytest
import xxhash

from compare import SMALL
from evgraph.llm.queries import queries
from evgraph.llm.simhash import fingerprint, keep_one, links_of, near_groups


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp, radius=4):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fp = np.array(fp, np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= radius):
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_query_equals_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = [slow_fingerprint(t) for _, t in docs]
    found = sorted(map(tuple, queries()["op1_simhash"](spark, SMALL).collect()))
    assert found == [(d, f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, want, slow_components(want))]


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    fps, unit = [], []
    for u, size in enumerate([1, 2, 3, 64, 65, 200, 5]):
        centre = int(rng.integers(0, 2**63))
        x = np.unique(np.array([centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(size)], np.uint64))
        fps.append(x)
        unit += [u] * len(x)
    fp = np.concatenate(fps)
    want, at = set(), 0
    for x in fps:
        roots = slow_components(x.tolist(), radius)
        want |= {(int(x.view(np.int64)[k]), int(x.view(np.int64)[r])) for k, r in enumerate(roots) if k != r}
    assert set(map(tuple, links_of(fp, np.array(unit), radius).to_numpy().tolist())) == want


def test_hot_buckets_are_divided_without_loss(spark):
    """A dense group in units of 8: chunks of one bucket meet pair by pair."""
    from evgraph.llm.simhash import near_links
    from evgraph.operators.components import connected_components

    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (120, 2))})
    got = connected_components(near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), unit=8))
    assert {r["component"] for r in got.collect()} == {fps[0]} and got.count() == len(fps)


def test_defined_cases(spark, odd, none):
    got = near_groups(odd).collect()
    assert len(got) == odd.count() and near_groups(none).count() == 0
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert of[1] == of[2] == of[3] == [(0, 1)] and of[7] == [of[5][0]] * 2 and of[5][0][1] == 5
    assert fingerprint("one") == slow_fingerprint("one")
    kept = keep_one(odd)
    assert kept.columns == odd.columns and len({(r["doc_id"]) for r in kept.collect()}) == kept.count()
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 8, 9, 10, 11]
    assert keep_one(none).count() == 0
