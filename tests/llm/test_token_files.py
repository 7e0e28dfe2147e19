import zlib
from array import array

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from compare import SMALL
from evgraph.llm.queries import queries, tokenizer_file
from evgraph.llm.token_files import expand, read_files, squeeze, token_files

BYTES = tokenizer_file("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]))))
def test_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = squeeze(ranks)
    assert expand(control, data, len(ranks)).tolist() == values
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)


def wanted(rows):
    t = Tokenizer.from_file(BYTES)
    t.no_truncation()
    start, out = 0, []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, queries()["op10_token_files"](spark, SMALL).collect())) == wanted(rows)


def test_defined_cases(spark, odd, none, tmp_path):
    out = f"file://{tmp_path}/ids"
    ranks = token_files(odd, BYTES, out, end_id=2)
    got = read_files(spark, out, ranks, with_ids=True).collect()
    assert len(got) == odd.count()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(x[2:] for x in wanted([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert all(zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"] for r in got)
    assert read_files(spark, f"{out}-none", token_files(none, BYTES, f"{out}-none", end_id=2)).count() == 0
