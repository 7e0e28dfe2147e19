"""Rounds over a graph have as many tasks and rows as its edges need, whatever the session's number of shuffle partitions."""

from collections import deque

from pyspark.sql import functions as F

from evgraph.operators import graph as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark, parts=3, size=150):
    """Rings with chords, larger than `exact`, and a short path."""
    pairs = {(min(a, b), max(a, b)) for p in range(parts) for k in range(size) for a, b in ((1000 * p + k, 1000 * p + (k + 1) % size), (1000 * p + k, 1000 * p + (k * 7 + 3) % size)) if a != b}
    return spark.createDataFrame([(a, b, 1) for a, b in sorted(pairs | {(9000, 9001), (9001, 9002)})], "src long, dst long, weight long")


def test_pagerank_leaves_hops_where_they_are(spark, monkeypatch):
    e = graph(spark)
    seen = []
    keep = G.stored
    monkeypatch.setattr(G, "stored", lambda df, name, *by: seen.append((name, plan(df))) or keep(df, name, *by))
    few = {r["id"]: r["pagerank"] for r in G.pagerank(e, 10, tolerance=None).collect()}
    rounds = [p for name, p in seen if name == "pagerank"]
    assert rounds and all("InMemoryTableScan" not in p and "BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in rounds)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 10)
    many = {r["id"]: r["pagerank"] for r in G.pagerank(e, 10, tolerance=None).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-12 for k in few) and abs(sum(few.values()) - 1) < 1e-9


def test_landmarks_are_bits(spark, monkeypatch):
    e = graph(spark)
    monkeypatch.setattr(G, "paths_from", None)  # no row for each landmark and node
    near = {}
    for r in e.collect():
        near.setdefault(r["src"], []).append(r["dst"])
        near.setdefault(r["dst"], []).append(r["src"])

    def distances(s):
        out, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in out:
                    out[w] = out[v] + 1
                    todo.append(w)
        return out

    for landmarks, exact in ((32, 120), (70, 2), (0, 2), (1, 200)):
        want, done = {}, set()
        for s in sorted(near):
            if s not in done:
                part = distances(s)
                done |= part.keys()
                marks = sorted(part, key=lambda v: (-len(near[v]), v))[: None if len(part) <= exact else landmarks]
                far = {m: distances(m) for m in marks}
                for v in part:
                    ds = [far[m][v] for m in marks if m != v]
                    want[v] = len(ds) / sum(ds) if ds else 0.0
        for bound in (G.BROADCAST_ROWS, 10) if landmarks == 32 else (G.BROADCAST_ROWS,):
            monkeypatch.setattr(G, "BROADCAST_ROWS", bound)
            got = {r["id"]: r["closeness"] for r in G.closeness_landmarks(e, landmarks, exact).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        monkeypatch.setattr(G, "BROADCAST_ROWS", 1 << 19)
    assert G.closeness_landmarks(e.where(F.lit(False))).count() == 0
