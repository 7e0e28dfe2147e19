import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties and repeated rows, with columns whose names clash with the operators' own."""
    long = " ".join(f"w{k % 997}x{k}" for k in range(40_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\t\n "), (4, long), (5, "The same text here."), (6, "the SAME text here."), (7, "the same text here."), (7, "the same text here."),
        (None, "the same text here."), (None, None), (8, "one"), (9, "x" * 30_000), (10, "É é ß ﬁ 漢字 🙂 <|endoftext|>"), (11, "a\n" * 3000),
    ]
    clash = "key fp h g w row runs spans base kept tie ids length piece q_words segments digest norm n post own".split()
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(i, t, *["?"] * len(clash)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
