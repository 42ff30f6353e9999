"""Winnowing against all word spans, and mixing against its conditions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import leakage, mixing


def words(text):
    w, begin = leakage.words_of(pa.array([text]))
    return list(w)


def test_words_ignore_case_punctuation_spacing_and_look():
    a = words("The Quick—brown fox, n°7!  ЕЛКА’s ﬁne")
    b = words("the quick brown FOX n 7 елка s fine")
    assert a == b and len(a) == 9
    assert words("") == [] and words("... !") == []
    assert words("Нос нОС") == [words("нос")[0]] * 2 and words("abc") != words("abd") and words("ab c") != words("a bc")


def test_words_keep_to_their_texts():
    w, begin = leakage.words_of(pa.array(["a b", None, "", "c", " - ", "a"]))
    assert list(begin) == [0, 2, 2, 2, 3, 3, 4] and w[0] == w[3]


def test_every_long_shared_span_has_a_common_fingerprint():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    for _ in range(300):
        span = rng.choices(vocabulary, k=10)
        texts = [" ".join([*rng.choices(vocabulary, k=rng.randint(0, 25)), *span, *rng.choices(vocabulary, k=rng.randint(0, 25))]) for _ in range(2)]
        w, begin = leakage.words_of(pa.array(texts))
        hashes, owner = leakage.winnow(w, begin)
        assert set(hashes[owner == 0]) & set(hashes[owner == 1])
    w, begin = leakage.words_of(pa.array(["a b c d e f g h i", "one"]))
    assert len(leakage.winnow(w, begin)[0]) == 0
    assert len(leakage.winnow(*leakage.words_of(pa.array([], pa.string())))[0]) == 0


def test_longest_shared_against_loops():
    rng = np.random.default_rng(3)
    for _ in range(150):
        a, b = (rng.integers(0, 2, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
        assert leakage.longest_shared(a, b, 5) == (best if best >= 5 else 0)


def test_leaks_against_all_spans(spark):
    rng = random.Random(6)
    vocabulary = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([8, 10, 30])))) for k in range(40)]
    items += [(100, None), (101, ""), (None, items[0][1]), (102, items[5][1])]
    documents = []
    for k in range(200):
        own = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.5:
            source = rng.choice(items[:40])[1].split()
            n = rng.choice([9, 10, 11, 30])
            at = rng.randint(0, max(0, len(source) - n))
            own[5:5] = [w.upper() if rng.random() < 0.2 else w for w in source[at : at + n]]
        documents.append((k, rng.choice([" ", ", ", " "]).join(own)))
    documents += [(900, None), (901, ""), (902, "x " * 50_000 + items[2][1]), (None, items[1][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in documents], "doc_id long, text string, item_id int").drop("item_id")
    e = spark.createDataFrame([(i, t, "en") for i, t in items], "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id): r.words for r in leakage.leaked_items(d, e).collect()}
    spans = lambda t: {tuple(x) for x in (lambda w: [w[k : k + 10] for k in range(len(w) - 9)])((t or "").lower().replace(",", " ").split())}
    have = {i: spans(t) for i, t in items if i is not None}
    want = {(i, k) for i, t in documents if i is not None for k, s in have.items() if spans(t) & s}
    assert set(got) == want and min(got.values()) >= 10
    report = {r.item_id: r for r in leakage.leak_report(d, e).collect()}
    assert set(report) == {i for i, _ in items if i is not None} and report[100].documents == 0
    assert all(r.documents == sum(k == i for _, k in want) for i, r in report.items())
    assert leakage.leaked_items(d.where("false"), e).count() == 0 == leakage.leaked_items(d, e.where("false")).count()


# ---- mixing
def test_water_filling():
    assert mixing.water_fill([10, 10], [0.5, 0.5], [2, 2], 20) == [10, 10]
    assert mixing.water_fill([2, 100, 100], [0.5, 0.25, 0.25], [2, 1, 1], 100) == [4, 48, 48]
    assert mixing.water_fill([1, 2], [0.5, 0.5], [1, 1], 100) == [1, 2]
    assert mixing.water_fill([0, 5], [0.5, 0.5], [3, 4], 10) == [0, 10]
    assert mixing.water_fill([5, 5], [0.0, 1.0], [1, 1], 4) == [0, 4]
    assert mixing.water_fill([], [], [], 5) == []
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        sizes, shares, repeats = rng.integers(0, 100, n), rng.dirichlet(np.ones(n)), rng.integers(1, 5, n)
        total = float(rng.integers(1, 400))
        given = mixing.water_fill(list(map(float, sizes)), list(shares), list(map(float, repeats)), total)
        caps = sizes * repeats
        assert (np.array(given) <= caps + 1e-9).all() and np.isclose(sum(given), min(total, caps.sum()))
        level = [g / s for g, s, c in zip(given, shares, caps) if g < c - 1e-9]
        assert np.allclose(level, level[:1] * len(level))


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(k, "some words here " * (1 + k % 5), "Big") for k in range(400)] + [(1000 + k, "few words", " small\t") for k in range(20)]
    rows += [(2000, "x", "other"), (2001, "x", None), (2002, None, "small"), (2003, "", "small")]
    documents = spark.createDataFrame([(*r, "k", 9) for r in rows], "doc_id long, text string, source string, key string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.3, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    return documents, targets


def test_plan_and_sample(mixed):
    documents, targets = mixed
    plan = mixing.mixing_plan(documents, targets)
    got = {r.source: r for r in plan.collect()}
    assert set(got) == {"big", "Small", "none"} and got["none"]["size"] == 0 and got["none"].short and got["Small"].short and not got["big"].short
    assert got["Small"].epochs == 3.0 and got["Small"]["rows"] == 22
    total = got["big"]["size"] + got["Small"]["size"]
    assert np.isclose(got["big"].given, min(got["big"]["size"], total - got["Small"].given))
    sample = mixing.mixed_sample(documents, plan, seed=1)
    rows = sample.collect()
    copies = {r.doc_id: r.copies for r in rows}
    assert all(r.copies <= (1 if r.source == "big" else 3) for r in rows) and all(copies[1000 + k] == 3 for k in range(20)) and 2000 not in copies
    assert rows and {tuple(r) for r in rows} == {tuple(r) for r in mixing.mixed_sample(documents.repartition(7), plan, seed=1).collect()}
    assert {r.doc_id for r in rows} != {r.doc_id for r in mixing.mixed_sample(documents, mixing.mixing_plan(documents, targets, total=500), seed=2).collect()}
    shares = {r.source: r for r in mixing.shares_reached(sample, plan).collect()}
    assert np.isclose(sum(r.share for r in shares.values()), 1) and shares["none"].tokens_taken == 0
    assert shares["Small"].tokens_taken == got["Small"]["size"] * 3


def test_mixing_nothing(mixed):
    documents, targets = mixed
    assert {r["size"] for r in mixing.mixing_plan(documents.where("false"), targets).collect()} == {0}
    assert mixing.mixing_plan(documents, targets.where("false")).count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "žluťoučký " * 1000]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.tokens for r in mixing.token_counts(frame).collect()}
    model = mixing._tokenizer(mixing.TOKENIZER)
    assert got == {k: len(model.encode(t, add_special_tokens=False).ids) if t else 0 for k, t in enumerate(texts)}
    assert got[3] > 1
