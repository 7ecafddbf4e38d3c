import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from amberlog.llm import tokens

PATH = tokens.DEFAULT_VOCABULARY
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def ours(texts):
    out = []
    for _, _, ids, counts in tokens.encode_array(pa.array(texts, pa.string()), tokens.vocabulary(PATH)):
        ends = np.cumsum(counts)
        out += [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    return out


HARD = ["", None, "a", "'s's 're' don't  we'll\n\n  x ''s  ", "a" * 4001, " \n \t x  y é😀😀 ½²٣", "   ", "x   ", "'", "'r", "'re", "0" * 301, "=-" * 77 + "-" * 50, "<|endoftext|>hi", "приве́т  мир  123", " 's", "ab\x00\x01 \x85z", "日本語 テキスト", "\r\n\r\n  a\r"]


def test_hard_texts(public):
    assert ours(HARD) == [public(t) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'srelvtdmLL \n\t1é.ж-😀 ½"), max_size=60), max_size=5))
def test_any_text(public, texts):
    assert ours(texts) == [public(t) for t in texts]


def test_equal_digests_of_different_pieces():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    one, kind = tokens._distinct(data, np.array([0, 3, 6]), np.array([3, 3, 3]))
    assert kind[0] == kind[2] != kind[1] and len(one) == 2


def test_chunks_do_not_matter(public, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 10)
    assert ours(HARD) == [public(t) for t in HARD]


def test_frame(spark, public):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "again", None)], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == sorted([(1, public("Hello world")), (2, []), (3, []), (3, public("again"))])
    assert tokens.token_ids(df.limit(0)).collect() == []
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).where("doc_id < 3").collect()} == {1: 2, 2: 0}


def test_documents(spark, sf, public):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: public(r.text) for r in df.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in tokens.token_ids(df).collect()} == want
