import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from studyframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [int(i) for run in OWN.encode(text) for i in np.frombuffer(run[0], np.int32)]


def test_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.digests(bpe.encode(docs, PATH)).collect()}
    for r in docs.collect():
        want = LIBRARY.encode(r["text"], add_special_tokens=False).ids
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text_equals_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_odd_texts():
    for text in ("", " \n", "<|endoftext|>x<|startoftext|>", "a<|endoftext", "ΑΣ ΣΑΣ", "İI", "don't we'LL", "é", "1234", "a\x1cb\x85c​d", "x" * 4097, "ab" * 3000, "aé" * 2000):
        assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids, text[:20]


def test_null_empty_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (2, "a b", 7), (2, "a b", 7), (None, "z", 8)], "doc_id long, text string, ids int")
    got = sorted(bpe.digests(bpe.encode(docs, PATH)).select("doc_id", "n_tokens").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 0), (1, 0), (2, 2), (2, 2), (None, 1)]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert sorted(bpe.digests(bpe.encode(docs, PATH)).collect(), key=str) == sorted(bpe.digests(bpe.encode(docs, PATH, hashed=True)).collect(), key=str)


def test_small_pieces_and_store(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "STORE_BYTES", 4000)
    own = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    texts = [f"some words {k % 7} come again and {k * k} again " + "z" * (k % 120) for k in range(200)]
    got = [[int(i) for run in runs for i in np.frombuffer(run[0], np.int32)] for runs in own.encode_all(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts] and len(own.store) + len(own.older) < 60
