import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from compare import SMALL
from evgraph.llm.packing import Capacity, pack_documents, plan
from evgraph.llm.queries import queries, tokenizer_file

WORDS = tokenizer_file("word_bpe_49k.json")


def pieces(text, end=0, most=2048):
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    ids = t.encode(text or "", add_special_tokens=False).ids + [end]
    return [(n, a, len(ids[a : a + most]), zlib.crc32(array("I", ids[a : a + most]).tobytes())) for n, a in enumerate(range(0, len(ids), most))]


def check(pdf, most=2048):
    pdf = pdf.sort_values(["sequence_id", "offset"])
    ends = pdf.groupby("sequence_id")["length"].cumsum()
    assert (ends - pdf["length"] == pdf["offset"]).all() and ends.max() <= most
    return pdf["sequence_id"].nunique()


def test_query(spark):
    got = queries()["op3_best_fit_packing"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = sorted((r["doc_id"], *p) for r in docs for p in pieces(r["text"]))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert check(got) <= int(np.ceil(got["length"].sum() / 2048)) + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20), st.sampled_from(["norm", "dot"]), st.integers(1, 64))
def test_plan_places_every_piece_within_all_capacities(lengths, by, documents):
    cap = Capacity(64, documents, 64 * 64, by=by)
    steps = plan(lengths, cap)
    bins, ranks = {}, {}
    for length, mine in steps.groupby("length"):
        mine = mine.sort_values("rank").reset_index(drop=True)
        ends = [*mine["rank"][1:], lengths[length]]
        for row, stop in zip(mine.itertuples(), ends):
            for rank in range(row.rank, stop):
                nth = rank - row.rank
                bins.setdefault(row.sequence + nth // row.copies, []).append((row.offset + nth % row.copies * length, length))
        ranks[length] = lengths[length]
    assert ranks == lengths
    for inside in bins.values():
        inside.sort()
        assert len(inside) <= documents and sum(x[1] for x in inside) <= 64
        assert [x[0] for x in inside] == list(np.cumsum([0] + [x[1] for x in inside])[:-1])


def test_a_piece_that_fits_no_bin():
    with pytest.raises(ValueError):
        plan({10: 1}, Capacity(64, 4, 50))


def test_defined_cases(spark, odd, none):
    got = pack_documents(odd, WORDS).toPandas()
    check(got)
    want = sorted(((r["doc_id"] or -1), *p) for r in odd.collect() for p in pieces(r["text"]))
    assert sorted((-1 if d != d else int(d), *rest) for d, *rest in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert pack_documents(none, WORDS).count() == 0
    with_ids = pack_documents(odd.where("doc_id = 8"), WORDS, with_ids=True).first()
    assert len(with_ids["ids"]) == with_ids["length"]
