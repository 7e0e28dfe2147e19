"""keep_one against all pairs: exact Jaccard of 5-word shingles."""

import random

import numpy as np

from evgraph.llm import simhash
from evgraph.llm.simhash import SHINGLE, fingerprint, keep_one


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def kept(docs):
    """Ids of the least document of each component of all pairs of similarity 0.8 or more, and those pairs."""
    sets, root, pairs = [shingles(t) for _, t in docs], list(range(len(docs))), []
    for i in range(len(docs)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                pairs.append((j, i))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {docs[k][0] for k in range(len(docs)) if find(k) == k}, pairs


def corpus(seed, bases, copies, edits, words=150):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        out.append(base)
        for _ in range(copies):
            copy = list(base)
            for at in rng.sample(range(words), rng.randint(*edits)):
                copy[at] = f"x{rng.randrange(10**6)}"
            out.append(copy)
    rng.shuffle(out)
    return [(k, " ".join(x)) for k, x in enumerate(out)]


def test_pairs_of_all_distances_are_found_and_verified(spark):
    docs = corpus(1, 150, 1, (1, 5))
    want, pairs = kept(docs)
    far = [p for p in pairs if (fingerprint(docs[p[0]][1], SHINGLE) ^ fingerprint(docs[p[1]][1], SHINGLE)).bit_count() > 4]
    assert len(pairs) > 60 and len(far) > 40 and len(want) > 160  # most are beyond 4 bits, and there are pairs below 0.8
    got = {r["doc_id"] for r in keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert want <= got  # nothing goes that is not similar
    assert len(docs) - len(got) >= 0.95 * (len(docs) - len(want))  # recall


def test_a_large_group_of_near_copies(spark):
    """Units with many pairs: least text first, then only between groups."""
    docs = corpus(2, 2, 150, (0, 4))
    want, _ = kept(docs)
    got = {r["doc_id"] for r in keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_a_large_group_that_is_hardly_similar(spark, monkeypatch):
    """Copies that differ too much from each other, compared chunk by chunk."""
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 1 << 15)
    docs = corpus(3, 2, 130, (1, 6))
    want, _ = kept(docs)
    assert len(want) > 40
    got = {r["doc_id"] for r in keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_pairs_by_products(monkeypatch):
    """Counts by matrices equal those by sets."""
    rng = random.Random(4)
    sets = [np.unique([rng.randrange(300) for _ in range(60)]) for _ in range(90)]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(90), [len(x) for x in sets])
    order = np.argsort(column, kind="stable")
    i, j = np.triu_indices(90, 1)
    got = simhash._common(i, j, sets, column[order], owner[order], len(times))
    assert len(i) > 2048 and got.tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]


def test_repeated_rows_and_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = corpus(4, 40, 2, (1, 1))  # similarities of 0.87 and more
    want = kept(docs)[0]
    rows = [(k, t, {"a": k}) for k, t in docs] + [(k, t, {"a": k}) for k, t in docs[:50]] + [(None, "", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, stays map<string, long>")
    for bound in (simhash.BROADCAST_ROWS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
        result = keep_one(df)
        got = [r["doc_id"] for r in result.collect()]
        assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1
        assert result.columns == df.columns
