import hashlib

import pytest
from tokenizers import Tokenizer

from compare import SMALL
from evgraph.llm.bpe import RankBpe, encode_digests, encode_texts
from evgraph.llm.encoding import Encoder
from evgraph.llm.queries import queries, tokenizer_file

WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD = [
    "", "   ", "\n\n a  b\t\tc\u00a0\u3000 d\u2028e", "J̌ ǰ İ ΣΑΣ ς é ẞ ﬁ ²³¼½ª º µ ₂ Ⅷ 12345 don't I'LL they'Re 'sa", "<|endoftext|> a <|startoftext|>b <|EndOfText|> x<|endoftext|>",
    "a" * 3000, "ab" * 2000 + " " + "qx" * 700, "漢字 かな 🙂👍🏽 x\u200dy \x1c\x1d z\x00", "a  \n<|endoftext|>  \n b  ", "_foo_bar__ a-b_c 3.14", "Å\u212b\u030a\u0301 K\u212a \u2126", "!!!''s''t 'S 'T", "   lead", "trail   ",
    "x\r\ny\r\n", "\u0301\u0345a b\u0327\u0301", "word. \n\n next\n line!! (a) b: c; 'quoted' x,y",
]
ODD.append(" ".join(ODD))


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_library(path, texts):
    t, e = library(path), Encoder(path)
    for x in ODD + texts:
        assert e.encode(x) == b"".join(i.to_bytes(4, "little") for i in t.encode(x, add_special_tokens=False).ids), x[:80]


def test_rank_arrays_equal_library(texts):
    t, r = library(WORDS), RankBpe(WORDS)
    for x in ODD + texts[:100]:
        ids = t.encode(x, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert r.encode(x) == ids and r.decode(ids) == decoded
        assert r.digest(x) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_query(spark):
    t = library(WORDS)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries()["op8_rank_bpe"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_defined_cases(odd, none):
    got = encode_digests(odd, WORDS).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == odd.count() and encode_digests(none, WORDS).count() == 0
    assert all(tuple(r)[1:] == (0, empty, empty) for r in got if r["doc_id"] in (1, 2, 3))
    assert encode_texts(odd.where("doc_id = 8"), WORDS).first()["decoded"] == "one</w>"
