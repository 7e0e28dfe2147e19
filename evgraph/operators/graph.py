"""Graph analytics over undirected weighted edges (src, dst, weight) with src < dst.

Every measure is a DataFrame of nodes; a node is what has an edge. Edges are taken as given: repeated pairs count as several edges, so dedup them first
(P6 does); loops and null ends have to be gone. No edges give no rows. Iterations write their rounds to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators.components import connected_components
from evgraph.operators.numbering import numbered
from evgraph.session import BROADCAST_ROWS, few, stored


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """id, degree, weight, centrality = degree / (n - 1); 1 for a single node."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("id", "degree", "weight", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))  # one row


def _sender(nodes: int) -> Callable[[DataFrame], DataFrame]:
    """What a round sends over the edges, at most a row a node, as a side of a join: to all tasks up to BROADCAST_ROWS nodes, so that edges stay where they are; merged beyond."""
    return F.broadcast if nodes <= BROADCAST_ROWS else lambda rows: rows.hint("merge")


def degree_ranking(edges: DataFrame, top: int | None = 50) -> DataFrame:
    """id, degree, weight: the heaviest nodes first, then those of most edges, then the least id."""
    rows = degree(edges).select("id", "degree", "weight").orderBy(F.desc("weight"), F.desc("degree"), "id")
    return rows if top is None else rows.limit(top)


def pivot_count(nodes: int) -> int | None:
    """How many pivots betweenness takes: all (None) up to 40 nodes, then twice the root of their number, 8 to 32."""
    return None if nodes <= 40 else min(32, max(8, math.floor(2 * math.sqrt(nodes))))


def paths_from(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(s, v, dist, paths): hop distance and number of shortest paths from every source, level by level.

    Rows are sources x reached nodes: give all nodes as sources on small graphs only, pivots on large ones.
    """
    hop = both_ways(edges).select("src", "dst")
    reached = stored(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths")), "paths")
    frontier, level = reached, 0
    while max_hops is None or level < max_hops:
        level += 1
        step = frontier.join(hop, frontier.v == hop.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        new = step.join(reached.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(level).alias("dist"), "paths")
        frontier = stored(new, "paths")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def closeness(edges: DataFrame, paths: DataFrame | None = None, scope: str = "graph") -> DataFrame:
    """(r - 1)/D * (r - 1)/(n - 1) over the whole graph, or (r - 1)/D within each component."""
    nodes = both_ways(edges).select(F.col("src").alias("id")).distinct()
    paths = paths if paths is not None else paths_from(edges, nodes)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    d = paths.groupBy(F.col("v").alias("id")).agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("dist").alias("d"))
    share = F.col("r") / F.col("d") * (F.col("r") / (F.col("n") - 1) if scope == "graph" else F.lit(1.0))
    return d.crossJoin(F.broadcast(n)).select("id", F.when(F.col("d") > 0, share).otherwise(0.0).alias("closeness"))  # one row


def closeness_landmarks(edges: DataFrame, landmarks: int = 32, exact: int = 120, known: DataFrame | None = None) -> DataFrame:
    """Closeness within components (G6): exact in components of up to `exact` nodes; in larger ones by `landmarks` nodes of
    highest degree (then least id): landmarks reached / sum of distances, the node itself not counted. 0 where there are none.

    Every landmark of a component is a bit, so a level sends a node's new bits over its edges once, not a row for each landmark.
    known: the components (id, component), if they are at hand.
    """
    known = stored(connected_components(edges) if known is None else known, "landmark-components")
    sizes = stored(known.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "landmark-sizes")
    d = degree(edges).select("id", "degree").hint("merge").join(known.hint("merge"), "id")
    d = stored(d.hint("merge").join(sizes.hint("merge"), "component"), "landmark-nodes")
    k = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "id"))  # each task keeps its first few before the shuffle
    most = max(landmarks, exact)
    first = d.withColumn("k", k).where(F.col("k") <= most).where((F.col("size") <= exact) | (F.col("k") <= landmarks)).select("id", F.col("k") - 1)
    first = stored(first.toDF("id", "bit"), "landmarks")
    words = range(-(-most // 64))
    own = [F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(0) for w in words]  # no landmark: 0
    state = d.select("id").hint("merge").join(first.hint("merge"), "id", "left").select("id", *[x.alias(f"new{w}") for w, x in zip(words, own)])
    state = state.select("*", *[F.col(f"new{w}").alias(f"seen{w}") for w in words], F.lit(0).cast("long").alias("samples"), F.lit(0).cast("long").alias("d"))
    state, hop, level = stored(state, "landmark-bits"), stored(both_ways(edges).select("src", "dst"), "landmark-hops"), 0
    side = _sender(d.count())
    while True:
        level += 1
        sent = state.where(" OR ".join(f"new{w} <> 0" for w in words)).select(F.col("id").alias("src"), *[f"new{w}" for w in words])
        got = hop.hint("merge").join(side(sent), "src").groupBy(F.col("dst").alias("id")).agg(*[F.bit_or(f"new{w}").alias(f"got{w}") for w in words])
        met = state.drop(*[f"new{w}" for w in words]).hint("merge").join(got.hint("merge"), "id", "left")
        met = met.withColumns({f"new{w}": F.coalesce(F.col(f"got{w}"), F.lit(0)).bitwiseAND(F.bitwise_not(f"seen{w}")) for w in words})
        fresh = sum((F.bit_count(f"new{w}").cast("long") for w in words), F.lit(0).cast("long"))
        met = met.withColumns({f"seen{w}": F.col(f"seen{w}").bitwiseOR(F.col(f"new{w}")) for w in words} | {"samples": F.col("samples") + fresh, "d": F.col("d") + level * fresh})
        state = stored(met.select(state.columns), "landmark-bits")
        if state.where(" OR ".join(f"new{w} <> 0" for w in words)).isEmpty():
            break
    return state.select("id", F.when(F.col("d") > 0, F.col("samples") / F.col("d")).otherwise(0.0).alias("closeness"))


def betweenness(edges: DataFrame, pivots: int | str | None = None) -> DataFrame:
    """Normalised, undirected; exact, or from `pivots` nodes chosen by hash of their id and scaled up; "auto" by pivot_count.

    Dependencies are passed back along shortest paths level by level, so the work is sources x edges.
    """
    nodes = stored(both_ways(edges).select(F.col("src").alias("id")).distinct(), "between-nodes")
    n = nodes.count()
    pivots = pivot_count(n) if pivots == "auto" else pivots
    sources = nodes.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(pivots) if pivots else nodes
    k = min(pivots or n, n)
    paths = stored(paths_from(edges, sources), "between-paths")
    hop = both_ways(edges).select(F.col("src").alias("v"), F.col("dst").alias("w"))
    deep = paths.agg(F.max("dist")).first()[0] or 0
    done = paths.where("false").select("s", F.col("v").alias("w"), F.lit(0.0).alias("delta"))
    for level in range(deep, 1, -1):
        low = paths.where(F.col("dist") == level).select("s", F.col("v").alias("w"), F.col("paths").alias("below")).join(done, ["s", "w"], "left")
        share = low.withColumn("share", (1 + F.coalesce("delta", F.lit(0.0))) / F.col("below"))
        up = paths.where(F.col("dist") == level - 1).select("s", "v", "paths")
        got = share.join(hop, "w").join(up, ["s", "v"]).groupBy("s", F.col("v").alias("w")).agg(F.sum(F.col("paths") * F.col("share")).alias("delta"))
        done = stored(done.unionByName(got), "between-delta")
    total = done.groupBy(F.col("w").alias("id")).agg(F.sum("delta").alias("sum"))
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(total, "id", "left").select("id", (F.coalesce("sum", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def pagerank(edges: DataFrame, rounds: int = 50, damping: float = 0.85, tolerance: float | None = 1e-5, every: int = 5) -> DataFrame:
    """Weighted PageRank, normalised to 1 (G7). Every node has an edge, so no rank dangles.

    It ends after `rounds`, or once the ranks change by less than tolerance times the number of nodes in sum, looked at each `every` rounds. A round moves
    only the ranks: up to BROADCAST_ROWS nodes they are sent to all tasks, of which there are as many as the hops need; beyond, hops stay dealt out by their source.
    """
    hop = both_ways(edges)
    out = stored(hop.groupBy("src").agg(F.sum("weight").alias("out")), "pagerank-weights")
    hop = hop.hint("merge").join(out.hint("merge"), "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    hop, n = stored(hop, "pagerank-hops"), out.count()
    side = _sender(n)
    if n > BROADCAST_ROWS:
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hop = hop.repartition(parts, "src").sortWithinPartitions("src").persist()
    rank = out.select(F.col("src").alias("id"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        before = rank
        got = hop.hint("merge").join(side(rank), hop.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        rank = got.select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("got")).alias("rank"))
        if k % every == every - 1 or k == rounds - 1:
            if tolerance is not None:
                rank = rank.join(before.withColumnRenamed("rank", "was"), "id")
            rank = stored(rank, "pagerank")
            if tolerance is not None:
                change = rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
                rank = rank.select("id", "rank")
                if (change or 0.0) < n * tolerance:
                    break
    hop.unpersist()
    total = rank.agg(F.sum("rank").alias("total"))
    return rank.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("pagerank"))  # one row


def components(edges: DataFrame) -> DataFrame:
    """id, component: 0-based, in order of the components' least ids."""
    found = stored(connected_components(edges), "graph-components")
    names = stored(numbered(found.select("component").distinct(), [], ["component"], "no"), "component-numbers")
    return found.hint("merge").join(names.hint("merge"), "component").select("id", (F.col("no") - 1).cast("int").alias("component"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Synchronous weighted label propagation; a node's own label weighs as its heaviest edge; ties to the least label."""
    hop = stored(both_ways(edges), "community-hops")
    own = hop.groupBy(F.col("src").alias("id")).agg(F.max("weight").alias("self"))
    label = stored(own.select("id", F.col("id").alias("label")), "community")
    side = _sender(label.count())
    for _ in range(rounds):
        heard = hop.join(side(label), hop.dst == label.id).select(F.col("src").alias("id"), "label", "weight")
        mine = label.join(own, "id").select("id", "label", F.col("self").alias("weight"))
        votes = heard.unionByName(mine).groupBy("id", "label").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("b"))
        label = stored(best.select("id", F.col("b.label").alias("label")), "community")
    least = stored(numbered(label.groupBy("label").agg(F.min("id").alias("least")), [], ["least"], "no"), "community-numbers")
    return label.hint("merge").join(least.hint("merge"), "label").select("id", (F.col("no") - 1).cast("int").alias("community"))


def community_sizes(communities: DataFrame) -> DataFrame:
    """community, members."""
    return communities.groupBy("community").agg(F.count(F.lit(1)).alias("members"))


def jaccard(edges: DataFrame, max_degree: int | None = None, top: int | None = None) -> DataFrame:
    """(a, b, common, similarity) of nodes with a common neighbour, a < b.

    With max_degree, larger hubs propose no pairs but count in `common` and the degrees: candidates are made from the others first, so no pair of a
    hub's neighbours is ever built. Without it every pair is returned, which is quadratic in the largest degree. top: the most similar pairs only.
    """
    hop = stored(both_ways(edges).select(F.col("src").alias("n"), F.col("dst").alias("x")), "jaccard-hops")
    d = stored(hop.groupBy("n").agg(F.count(F.lit(1)).alias("deg")), "jaccard-degrees")
    side = lambda h, c: h.select("x", F.col("n").alias(c)).hint("merge")
    if max_degree:
        low = stored(hop.hint("merge").join(d.where(F.col("deg") <= max_degree).select(F.col("n").alias("x")).hint("merge"), "x", "left_semi"), "jaccard-low")
        pairs = stored(side(low, "a").join(side(low, "b"), "x").where("a < b").select("a", "b").distinct(), "jaccard-pairs")
        met = stored(pairs.hint("merge").join(side(hop, "a"), "a"), "jaccard-met")  # (a, b, each neighbour of a)
        met = met.hint("merge").join(side(hop, "b"), ["b", "x"], "left_semi")
    else:
        met = side(hop, "a").join(side(hop, "b"), "x").where("a < b")
    common = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    for c in ("a", "b"):
        common = common.hint("merge").join(d.select(F.col("n").alias(c), F.col("deg").alias(f"d{c}")).hint("merge"), c)
    rows = common.select("a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("similarity"))
    return rows if top is None else rows.orderBy(F.desc("similarity"), "a", "b").limit(top)


def measures(edges: DataFrame, pivots: int | str | None = "auto", rounds: int = 50, tolerance: float | None = 1e-5, known: DataFrame | None = None) -> DataFrame:
    """id, degree (centrality), betweenness, closeness, pagerank, community of every node. known: the components (id, component), if they are at hand."""
    rows = degree(edges).select("id", F.col("centrality").alias("degree"))
    for part in (betweenness(edges, pivots), closeness_landmarks(edges, known=known), pagerank(edges, rounds, tolerance=tolerance), communities(edges)):
        rows = rows.hint("merge").join(part.hint("merge"), "id")
    return stored(rows, "graph-measures")


def combined(measured: DataFrame, places: int | None = None, top: int | None = 50) -> DataFrame:
    """The rows of measures() by falling pagerank, betweenness and degree, then id (G12); rounded to `places` before they are compared."""
    names = ("pagerank", "betweenness", "degree", "closeness")
    rows = measured if places is None else measured.withColumns({c: F.round(c, places) for c in names})
    rows = rows.orderBy(F.desc("pagerank"), F.desc("betweenness"), F.desc("degree"), "id")
    return rows if top is None else rows.limit(top)


def multi_hop(edges: DataFrame, sources: DataFrame, hops: int = 5, top: int | None = 100) -> DataFrame:
    """s, id, hops: least hop count, 1 to hops (at most 5), the nearest first per source."""
    p = paths_from(edges, sources, max(1, min(5, hops))).where("dist > 0").select("s", F.col("v").alias("id"), F.col("dist").alias("hops"))
    if top is None:
        return p
    n = F.row_number().over(Window.partitionBy("s").orderBy("hops", "id"))
    return p.withColumn("__n", n).where(F.col("__n") <= top).drop("__n")


def shortest_path(edges: DataFrame, source, target, max_hops: int = 20) -> DataFrame:
    """hops, nodes: the least shortest path from source to target by node order; no row if there is none."""
    spark = edges.sparkSession
    hop = both_ways(edges).select("src", "dst")
    kind = edges.schema["src"].dataType.simpleString()
    front = spark.createDataFrame([(source, [source])], f"v {kind}, nodes array<{kind}>")
    seen = front.select("v")
    for level in range(max_hops + 1):
        found = front.where(F.col("v") == target)
        if not found.isEmpty():
            return found.select(F.lit(level).alias("hops"), "nodes")
        step = front.join(hop, front.v == hop.src).groupBy("dst").agg(F.min("nodes").alias("nodes"))
        front = stored(step.select(F.col("dst").alias("v"), F.concat("nodes", F.array("dst")).alias("nodes")).join(seen, "v", "left_anti"), "path")
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front.select("v")), "path-seen")
    return spark.createDataFrame([], f"hops int, nodes array<{kind}>")


def neighbours(edges: DataFrame, nodes: DataFrame, of: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Direct neighbours (G15): id, neighbour, label, node_type, type, score, strength.

    edges: src, dst, type, score, strength; nodes: id, type, label, case_id; of: id of those asked about; cases: case_id that the asker may see (all if left out).
    A neighbour without a node row has null label and type, and is not shown under `cases`.
    """
    cells = ["type", "score", "strength"]
    both = edges.select("src", "dst", *cells).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cells))
    both = both.hint("merge").join(of.select(F.col("id").alias("src")).distinct().hint("merge"), "src", "left_semi")
    seen = nodes.select(F.col("id").alias("dst"), "label", F.col("type").alias("node_type"), "case_id")
    how = "left"
    if cases is not None:
        seen, how = seen.join(few(cases.select("case_id").distinct(), "cases"), "case_id", "left_semi"), "inner"
    rows = both.hint("merge").join(seen.hint("merge"), "dst", how)
    return rows.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "label", "node_type", *cells)


def summary(edges: DataFrame, measured: DataFrame, places: int = 6, known: DataFrame | None = None) -> DataFrame:
    """One row (G16): nodes, edges, components and the highest value of each measure. known: the components (id, component), if they are at hand."""
    best = lambda c: F.round(F.max(c), places).alias(f"top_{c}")
    a = measured.agg(F.count(F.lit(1)).alias("nodes"), *[best(c) for c in ("degree", "betweenness", "closeness", "pagerank")])
    c: Column = F.count_distinct("component").alias("components")
    return a.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin((connected_components(edges) if known is None else known).agg(c))  # one row each
