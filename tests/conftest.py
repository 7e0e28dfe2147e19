import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evgraph.session import get_session  # noqa: E402



@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="evgraph-tests-")
    s = get_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}/checkpoints",
            "spark.sql.warehouse.dir": f"{shared}/warehouse",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for path in sorted(Path("/root/testdata/sf0.001").glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c
