"""The consistent form against per-character rules of the Unicode database, and pairs against a comparison of all."""

import random
import unicodedata as U

import pyarrow as pa
import pytest

from tidemill.llm import glyphs

ALIKE = glyphs._lookalikes()


def plain(text):
    return U.normalize("NFC", "".join(glyphs._shown(c, ALIKE) for c in text))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ１２", "full width12"), ("ﬁne ﬂow ﬃ", "fine flow ffi"), ("été", "été"), ("zero​wid⁠th﻿", "zerowidth"),
        ("no break space", "no break space"), ("раураl", "paypal"), ("Κελvin K", "Kελvin K"), ("soft­hyphen", "softhyphen"),
        ("non‑breaking", "non-breaking"), ("й", "й"), ("q̣̇", "q̣̇"), ("각", "각"), ("ӓ", "ä"), ("dots…", "dots..."),
    ],
)
def test_same_look(a, b):
    got = glyphs.consistent(pa.array([a, b])).to_pylist()
    assert got[0] == got[1]


@pytest.mark.parametrize(("a", "b"), [("resume", "résumé"), ("Case", "case"), ("l0", "lO"), ("a b", "a  b"), ("x²", "x2"), ("end.", "end"), ("①", "1"), ("3", "З")])
def test_visible_differences_stay(a, b):
    got = glyphs.consistent(pa.array([a, b])).to_pylist()
    assert got[0] != got[1]


def test_against_rules_one_character_at_a_time():
    rng = random.Random(1)
    blocks = [range(32, 127), range(0xC0, 0x250), range(0x300, 0x345), range(0x370, 0x530), range(0x1100, 0x1200), range(0xAC00, 0xAC40), range(0x900, 0xA00), range(0xFF00, 0xFFF0), range(0x1F300, 0x1F320)]
    alphabet = [chr(c) for b in blocks for c in b if U.category(chr(c)) not in ("Cn", "Cs")] + list("​ ­ﬁK…　\n\t")
    for _ in range(150):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(30)] + [None, "", "́", "́́"]
        array = pa.array(texts, pa.string())
        want = [None if t is None else plain(t) for t in texts]
        assert glyphs.consistent(array).to_pylist() == want
        assert glyphs.consistent(array.slice(7, 20)).to_pylist() == want[7:27]
        assert [t and plain(t) for t in want] == want  # once is enough


def test_long_text_and_empty_batch():
    long = "é́ﬁ" * 200_000
    assert glyphs.consistent(pa.array([long, "x"])).to_pylist() == [plain(long), "x"]
    assert glyphs.consistent(pa.array([], pa.string())).to_pylist() == []
    assert glyphs.consistent(pa.array([None], pa.string())).to_pylist() == [None]


def test_form_replaces_a_clashing_column(spark):
    rows = [(1, "ａ", "old"), (2, None, "old")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string")
    assert {tuple(r) for r in glyphs.consistent_form(frame).select("doc_id", "form").collect()} == {(1, "a"), (2, None)}


def test_pairs_against_all_comparisons(spark):
    rng = random.Random(2)
    base = ["one text", "another text", "été", "x"]
    swaps = {"o": "ο", "e": "е", "é": "é", " ": " ", "x": "ｘ"}
    rows = []
    for k in range(120):
        text = rng.choice(base)
        if rng.random() < 0.6:
            text = "".join(swaps.get(c, c) if rng.random() < 0.3 else c for c in text)
        rows.append((k, text))
    rows += [(200, None), (201, ""), (202, "​"), (None, "x"), (203, "X")]
    frame = spark.createDataFrame([(i, t, "s", "s") for i, t in rows], "doc_id long, text string, look string, spelling string")
    got = [tuple(r) for r in glyphs.lookalike_pairs(frame).collect()]
    texts = [(i, t) for i, t in rows if i is not None and t]
    want = {(i, j) for i, a in texts for j, b in texts if i < j and a != b and plain(a) == plain(b)}
    assert set(got) == want and len(got) == len(want)
    assert glyphs.lookalike_pairs(frame.where("false")).count() == 0
