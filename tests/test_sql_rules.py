"""The SQL states the rule of its query on inputs that its first form did not cover."""

import tempfile

import duckdb
import pytest

from compare import assert_same
from evgraph.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def deep(spark):
    """Suppliers in a chain of twelve hops, and pairs of suppliers below the bound of weights."""
    lines, order = [], 0
    for k in range(12):
        for _ in range(5):
            lines += [(order, k, "R"), (order, k + 1, "R")]
            order += 1
    for k in range(40):
        lines += [(order, 100 + k, "R"), (order, 200 + k, "R")]
        order += 1
    path = tempfile.mkdtemp(prefix="evgraph-deep-")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["g5_closeness_component", "g6_closeness_landmarks", "g12_combined"])
def test_paths_of_any_length(spark, deep, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{deep}/lineitem.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, deep), c.sql(SQL[name]))


TEXTS = [
    "a,b\n1,2\n", 'a,b\n"1,5",2\n"x\ny",3', 'a,A\n1,2', 'a,b\n"never closed, 1\n2', "a,b\r\n1,2\r\n", "a\rb\rc", ",\n,\n1", "\t\n\xa0\n", 'a,b\n"say ""x"", y",2', 'a,b\n"q" tail,2', 'a,b\n"q"x"y,2',
    'a,b\n5" wide,2', '"', '""', '"a"\n"b"', "", None, "a,b,\n1,2,\n", "a\n\n\nb", 'h\n""""', "x" * 20001, 'a,"b\n1,2\n3,4', ' "a,b"\n1,2', "a,b\n1\n2\n3,4", "a,a\n", "a,b\n ,　\n1,2",
]


def test_quotes_blanks_and_line_ends(spark):
    path = tempfile.mkdtemp(prefix="evgraph-csv-")
    rows = [(4 * k + kind, t) for k, t in enumerate(TEXTS) for kind in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert_same(QUERIES["q5_validate_files"](spark, path), c.sql(SQL["q5_validate_files"]))
