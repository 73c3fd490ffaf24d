import random

import numpy as np
import pytest

from foliograph.llm import leaks as L


def brute(docs, items, n):
    runs = {}
    for i, t in items:
        w = L.words(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [L.words(t)] for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())}


def corpus(seed, docs=60, items=15):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(6)]
    line = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    bench = [(i, line(rng.randint(0, 25))) for i in range(items)]
    texts = []
    for d in range(docs):
        parts = [line(rng.randint(0, 20))]
        if rng.random() < 0.5:
            w = L.words(rng.choice(bench)[1])
            parts.append(rng.choice([", ", "\n", " _", "—"]).join(w[rng.randint(0, 3) :]).upper())
        texts.append((d, " ".join([*parts, line(5)])))
    return texts, bench


@pytest.mark.parametrize("seed, shard", [(1, 10_000), (2, 50), (3, 1)])
def test_against_brute_force(spark, seed, shard):
    texts, bench = corpus(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for block in (10_000, 40):
        got = L.leaked_items(docs, items, min_words=8, shard_words=shard, block_words=block, blocks_at_once=2).collect()
        assert {tuple(r) for r in got} == brute(texts, bench, 8) and len(got) == len({tuple(r) for r in got})


def test_index_counts_and_locates():
    rng = np.random.default_rng(5)
    seq = np.concatenate(([0], rng.integers(1, 4, 400), [0], rng.integers(1, 4, 300), [0]))
    index = L.FmIndex(seq, 4, sample=5)
    phrases = np.unique(rng.integers(1, 4, (200, 4)), axis=0)
    alive, low, high = index.search(phrases)
    found = {}
    for p, a, b in zip(alive, low, high):
        found[tuple(phrases[p])] = sorted(index.locate(np.arange(a, b)).tolist())
    for p in map(tuple, phrases):
        expected = [i for i in range(len(seq) - 3) if tuple(seq[i : i + 4]) == p]
        assert found.get(p, []) == expected


def test_spans_and_edges(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, f"Intro: {passage.upper()}. End", "x"), (2, passage[: passage.index(" twelve")], "x"), (3, None, None), (4, "", "x"), (1, f"Intro: {passage.upper()}. End", "x"), (None, passage, "x"), (5, passage.replace(" ", "**\n_ "), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, passage), (8, passage + " more"), (9, None), (10, ""), (None, passage)], "item_id long, text string")
    spans = {tuple(r) for r in L.leaked_spans(docs, items).collect()}
    assert spans == {(1, 7, 1, 13), (1, 8, 1, 13), (5, 7, 0, 12), (5, 8, 0, 12)}
    assert L.leaked_items(docs, items).count() == 4
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0


def test_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    text = " ".join(["filler"] * 200_000) + " " + passage
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "filler " + passage)], "item_id long, text string")
    assert L.leaked_spans(docs, items, shard_words=1000).collect()[0]["last_word"] == 200_019
