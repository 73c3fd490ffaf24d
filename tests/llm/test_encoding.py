import random

import pytest
import tiktoken

from foliograph.llm import encoding as E


@pytest.fixture(scope="module")
def encoder():
    return E.PrefixEncoder(E.read_ranks(E.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    ranks = {b: i for i, b in enumerate(E.read_ranks(E.DEFAULT_VOCABULARY))}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(encoder, reference):
    rng = random.Random(7)
    signs = "ab eéthe ing​\u0301 \n\t 'sll日本語0123₂²½\x1c\x85\xa0—…ÀſK😀"
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "the" * 3000, "<|endoftext|>", "don't we'll\r\n\r\n  x"])
def test_edges(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_every_token_has_its_two_parts(encoder):
    tokens = E.read_ranks(E.DEFAULT_VOCABULARY)
    for i in range(0, len(tokens), 37):
        if len(tokens[i]) > 1:
            assert tokens[encoder.left[i]] + tokens[encoder.right[i]] == tokens[i]


def test_corpus(spark, reference):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x"), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = E.encode_corpus(docs).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((k or 0, reference.encode_ordinary(t or "")) for k, t, _ in rows)
    assert E.encode_corpus(docs.limit(0)).count() == 0


def test_small_caches_change_nothing(reference):
    small = E.PrefixEncoder(E.read_ranks(E.DEFAULT_VOCABULARY), cache_entries=2)
    texts = ["unbelievable outlining of gantries", "unbelievable again"]
    for _ in range(2):
        assert small.encode_batch(texts).to_pylist() == [reference.encode_ordinary(t) for t in texts]
