"""Pairs of the members of a class are told by the class, not by a row each."""

from pyspark.sql import functions as F

from compare import SMALL
from evgraph.operators import relate as E
from evgraph.plans import QUERIES
from evgraph.plans import views as V


def members(rows):
    out = {}
    for r in rows:
        out.setdefault(r["a"], {r["a"]}).add(r["b"])
    return out


def expanded(found, value):
    """(a, b) -> value of all pairs of persons."""
    of = members(r for r in found if r["member"])
    out = {}
    for r in found:
        if r["member"]:
            out |= {(x, y): r[value] for x in of[r["a"]] for y in of[r["a"]] if x < y}
        else:
            out |= {(min(x, y), max(x, y)): r[value] for x in of.get(r["a"], {r["a"]}) for y in of.get(r["b"], {r["b"]})}
    return out


def test_every_pair_is_told(spark):
    rows = [(f"p{k:03}", v) for k in range(200) for v in (("x", "y") if k % 4 == 0 else ("x",) if k % 4 < 3 else ("y", "z", "w"))] + [("lone", "q"), (None, "x"), ("p001", None)]
    links = spark.createDataFrame(rows, "person string, value string")
    classes = E.link_classes(links, ["value"])
    for name, whole, pairs in (("n", E.shared_counts(links.na.drop(), "n", ["value"]), lambda x: E.shared_counts(x, "n", ["value"])), ("cases", E.shared_cases(links, case="value"), lambda x: E.shared_cases(x, case="value"))):
        kept = classes if name == "n" else classes.where("values > 1")
        found = E.with_members(pairs(E.of_least(links, classes)), kept, name).collect()
        told = expanded(found, name) if name == "n" else None
        want = {(r["a"], r["b"]): r[name] for r in whole.collect()}
        if told is None:  # members of classes of one case share it with others, but not with each other
            of = members({"a": r["class"], "b": r["person"]} for r in classes.collect())
            told = {}
            for r in found:
                for x in of[r["a"]]:
                    for y in of[r["a"]] if r["member"] else of[r["b"]]:
                        if x != y:
                            told[min(x, y), max(x, y)] = r[name]
        assert told == want and len(found) < 210 < len(want)


def test_all_signals_are_told(spark):
    t = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").unionByName(copies(spark, name))

    def copies(spark, name):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        shift = {"customer": "c_custkey + 10000 AS c_custkey", "orders": "o_orderkey + 100000 AS o_orderkey, o_custkey + 10000 AS o_custkey"}.get(name)
        return df.where("false") if shift is None else df.selectExpr(*[x if x not in shift else next(e for e in shift.split(", ") if e.endswith(x)) for x in df.columns])

    import tempfile

    path = tempfile.mkdtemp(prefix="evgraph-copies-")
    for name in ("customer", "orders", "lineitem", "supplier", "nation"):
        t(name).write.parquet(f"{path}/{name}.parquet")
    t = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    links = V.links(t)
    of_kind = lambda kind, name, *by: E.shared_counts(links.where(f"kind = '{kind}'"), name, list(by))
    whole = E.scored(E.union_signals(E.event_signals(V.events(t)), E.shared_cases(links.where("kind = 'case'"), case="value"), of_kind("account", "shared_ids", "kind", "value"), of_kind("location", "locations", "value")))
    want = {(r["a"], r["b"]): r[2:] for r in whole.collect()}
    assert {(r["a"], r["b"]): r[2:] for r in QUERIES["e5_all_signals"](spark, path).collect()} == want  # the query has a row for each
    social, case = links.where("kind <> 'account'"), F.count_if(F.col("kind") == "case")
    classes = E.link_classes(social, ["kind", "value"], locations=F.count_if(F.col("kind") == "location"), cases=F.when(case > 1, case).otherwise(0)).drop("values")
    least = E.of_least(social, classes)
    between = E.union_signals(E.shared_cases(least.where("kind = 'case'"), case="value"), E.shared_counts(least.where("kind = 'location'"), "locations", ["value"]))
    found = E.scored(E.by_class(E.union_signals(E.event_signals(V.events(t)), of_kind("account", "shared_ids", "kind", "value")), classes, between)).collect()
    of = members(r for r in found if r["level"] == "member")
    told = {}
    for level in ("member", "class", "pair"):
        for r in found:
            if r["level"] == level:
                one, other = of.get(r["a"], {r["a"]}), of.get(r["b"], {r["b"]})
                both = [(r["a"], r["b"])] if level == "pair" else [(x, y) for x in one for y in (one if level == "member" else other)]
                told |= {(min(p), max(p)): r[3:] for p in both if p[0] != p[1]}
    assert told == want and len(found) < len(want)
