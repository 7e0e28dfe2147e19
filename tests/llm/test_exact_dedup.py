from pyspark.sql import functions as F

from compare import SMALL, assert_same
from evgraph.llm.exact_dedup import exact_dedup
from evgraph.llm.oracle import oracle_sql
from evgraph.llm.queries import queries


def test_query_equals_sql(spark, duck):
    assert_same(queries()["op9_exact_dedup"](spark, SMALL), duck.sql(oracle_sql()["op9_exact_dedup"]))


def slow(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(lower), []).append(d)
    out = []
    for ids in groups.values():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        out += [(d, keep, len(ids)) for d in ids]
    return sorted(out, key=repr), len(groups)


def test_defined_cases_in_several_batches(spark, odd, tmp_path):
    path = f"file://{tmp_path}/docs"
    odd.repartition(5).write.parquet(path)
    got = exact_dedup(spark, path, max_bytes=1).collect()
    want, groups = slow([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_digests_that_collide_are_settled_by_bytes(spark, odd, tmp_path):
    path = f"file://{tmp_path}/docs"
    odd.write.parquet(path)
    weak = lambda text: F.unhex(F.hex(F.char_length(text) % 7))
    got = exact_dedup(spark, path, digest=weak).collect()
    want, groups = slow([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == want and sum(r["kept"] for r in got) == groups


def test_empty_table(spark, none, tmp_path):
    path = f"file://{tmp_path}/docs"
    none.write.parquet(path)
    assert exact_dedup(spark, path).count() == 0


def test_a_later_call_goes_on_from_the_state(spark, odd, tmp_path):
    """Hits across batches and calls; the path may end with a slash."""
    path, seen = f"file://{tmp_path}/docs/", []
    for part in (odd.where("doc_id < 6"), odd.where("doc_id >= 6 OR doc_id IS NULL")):
        part.repartition(3).write.mode("append").parquet(path)
        seen += [(r["doc_id"], r["text"]) for r in part.collect()]
        got = exact_dedup(spark, path, max_bytes=1, state=f"file://{tmp_path}/state").collect()
        want, groups = slow(seen)
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == want and sum(r["kept"] for r in got) == groups
