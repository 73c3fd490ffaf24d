import random
from collections import Counter
from fractions import Fraction

import pytest

from foliograph.llm import frequencies as Q
from foliograph.llm import lookalikes as K
from foliograph.llm import similar_sets as S


def brute(rows, share, least):
    sets = {}
    for k, v in rows:
        s = frozenset(x for x in v or () if x)
        if k is not None and len(s) >= least:
            sets[k] = s
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= Fraction(share) * len(sets[a] | sets[b])}


def records(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            base = list(rng.choice(rows)[1] or [])
            if base and rng.random() < 0.7:
                base[rng.randrange(len(base))] = f"t{rng.randint(0, 12)}"
            if rng.random() < 0.4:
                base.append(f"t{rng.randint(0, 40)}")
        else:
            base = [f"t{int(rng.paretovariate(1)) % 40}" for _ in range(rng.randint(0, 24))]
        rng.shuffle(base)
        rows.append((k, base))
    return [*rows, (900, None), (901, [None, "", "a"]), (None, ["t1", "t2", "t3", "t4", "t5"])]


@pytest.mark.parametrize("seed, share, least, max_subsets", [(1, "0.6", 4, 64), (2, "0.7", 5, 64), (3, "0.7", 5, 3), (4, "0.5", 1, 1), (5, "1.0", 2, 64)])
def test_similar_pairs_against_brute_force(spark, seed, share, least, max_subsets):
    rows = records(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, tags array<string>, items string, class int")
    got = [tuple(r) for r in S.similar_records(df.union(df.limit(20)), "page_id", "tags", share, least, max_subsets).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, share, least)


def test_links_count_all_partners(spark):
    rows = records(8, 60)
    pairs = brute(rows, "0.6", 4)
    df = spark.createDataFrame(rows, "page_id long, tags array<string>")
    got = {r["record"]: r["links"] for r in S.similar_links(df, "page_id", "tags", "0.6", 4).collect()}
    assert {k: v for k, v in got.items() if v} == dict(Counter(x for p in pairs for x in p))
    assert S.similar_records(df.limit(0), "page_id", "tags", "0.6", 4).count() == 0


def test_needed_overlap():
    for a in range(1, 30):
        for b in S.partner_sizes(a, Fraction("0.7"), 1):
            c = S.needed_overlap(a, b, Fraction("0.7"))
            assert c * 10 >= 7 * (a + b - c) and (c - 1) * 10 < 7 * (a + b - c + 1)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_frequencies(spark, partitions):
    rng = random.Random(3)
    rows = [(k, [rng.choice(["hot", "hot", f"t{rng.randint(0, 30)}", "Ä", None, ""]) for _ in range(rng.randint(0, 6))], rng.choice(["c1", "c2", None, "", "hot"])) for k in range(300)]
    rows += [(1000, None, None), (None, ["x"], "y")]
    df = spark.createDataFrame([(*r, "f", "t") for r in rows], "page_id long, tags array<string>, category string, field string, term string")
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in Q.term_frequencies(df, "page_id", {"tags": "array", "category": "string"}, partitions).collect()}
    n, d = Counter(), Counter()
    for k, t, c in rows:
        if k is not None:
            for field, values in (("tags", t or []), ("category", [c])):
                values = [v for v in values if v]
                n.update((field, v) for v in values)
                d.update((field, v) for v in set(values))
    assert got == {k: (n[k], d[k]) for k in n}


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("tags", "a", 9, 2), ("tags", "b", 9, 3), ("tags", "c", 9, 21), ("tags", "d", 9, 20)], "field string, term string, occurrences long, records long")
    assert {r["term"]: r["mark"] for r in Q.mark_terms(df, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}
    none = spark.createDataFrame([], "page_id long, tags array<string>")
    assert Q.term_frequencies(none, "page_id", {"tags": "array"}).count() == 0


@pytest.mark.parametrize(
    "other, plain",
    [
        ("Ｅａｒｌｙ　Ｔ１", "Early T1"),
        ("Re\u0301sume\u0301", "Résumé"),
        ("N\u200d\u034fi\ufeffk\u00ad", "Nik"),
        ("a\u00a0b\u2009c\u3000d", "a b c d"),
        ("ﬁlter ﬂow", "filter flow"),
        ("Кіln", "Kiln"),
        ("\u212ailn", "Kiln"),
        ("e\u200b\u0301", "é"),
        ("ｶﾞ", "ガ"),
    ],
)
def test_same_look(other, plain):
    assert K.one_form(other) == K.one_form(plain) == plain


@pytest.mark.parametrize("a, b", [("Layer²", "Layer2"), ("œuvre", "oeuvre"), ("a‐b", "a-b"), ("Cafe", "Café"), ("A", "a"), ("Обзор", "Обзоры"), ("①", "1")])
def test_different_look(a, b):
    assert K.one_form(a) != K.one_form(b)


def test_forms_are_final():
    for source, to in K.mapping().items():
        assert K.one_form(to) == to and source != to
    assert K.one_form(None) is None and K.one_form("") == "" and K.one_form("x" * 100_000 + "é") == "x" * 100_000 + "é"


def test_look_alike_pairs(spark):
    entries = spark.createDataFrame([("g", 1, "Kiln"), ("g", 2, "Кiln"), ("g", 3, "Kiln"), ("h", 4, "Кiln"), ("g", 5, None), (None, 6, "Kiln"), ("g", 7, ""), ("g", 1, "Kiln")], "scope string, id long, text string")
    links = spark.createDataFrame([("g", 100, "Ｋiln"), ("g", 100, "Kiln"), ("g", 101, "Kiln"), ("g", 102, "Other"), ("g", None, "Кiln")], "scope string, id long, text string")
    got = [tuple(r) for r in K.look_alike_pairs(entries, links).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("title_title", 1, 2), ("title_title", 2, 3), ("link_title", 1, 100), ("link_title", 2, 100), ("link_title", 3, 100), ("link_title", 2, 101)}
    assert K.look_alike_pairs(entries.limit(0), links).count() == 0
