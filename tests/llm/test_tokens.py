"""Token counts against the library of the same vocabulary file."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowwatch.llm.tokens import Merges, read_merges, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library):
    model = Merges(*read_merges(PATH), most=500)
    rng = random.Random(7)
    letters = [chr(i) for i in range(0x300)] + list(" \n\tsdre'") * 30 + [chr(0x2028), chr(0x1F600), chr(0x3000)]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.2:
            text += "<|endoftext|>" * rng.randint(1, 2) + text
        assert model.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_rows(spark, library):
    long_word, long_text = "abc" * 40_000, "the end of it, " * 60_000
    texts = [None, "", "hello world", "hello world", long_word, long_text, "a<|endoftext|> b"]
    docs = spark.createDataFrame(
        [(i if i != 2 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int"
    )
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    want = set()
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.add((i if i != 2 else None, len((t or "").encode()), n, n > 1024))
    assert got == want
    assert token_counts(docs.limit(0), PATH).collect() == []


def test_query_equals_library(spark, library):
    from flowwatch.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
