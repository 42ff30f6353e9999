"""Test passages inside a corpus, found by winnowing.

Texts become words in the consistent form of ``glyphs``; a word is a 64-bit hash. Of each window of consecutive k-gram
hashes the smallest is kept as a fingerprint, so that two texts sharing a span of ``span`` words share at least one.
Fingerprints of the corpus are joined with those of the test items, and each pair that meets is extended to its
longest common span.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemill.functions.joins import is_light, is_small
from tidemill.llm.glyphs import LIMIT, _lookalikes, code_points, fold
from tidemill.sources.scratch import materialise

SPAN = 10
GRAM = 5
#: Places of a text and an item that are compared at a time.
MEETING = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads differences over all of them."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it belongs to words, and the letter it is compared as.

    Letters that differ in case or only look alike are compared as one: the classes of the two relations together, as a
    capital of one script may look like a letter whose small form doesn't.
    """
    part, group = np.zeros(LIMIT, dtype=bool), np.arange(LIMIT, dtype=np.int32)

    def root(a: int) -> int:
        while group[a] != a:
            group[a] = group[group[a]]
            a = int(group[a])
        return a

    def unite(a: str, b: str) -> None:
        if len(a) == len(b) == 1:
            low, high = sorted((root(ord(a)), root(ord(b))))
            group[high] = low

    for cp in range(0x30000):
        category = unicodedata.category(ch := chr(cp))
        part[cp] = category[0] in "LMN"
        if category[0] in "LM":
            unite(ch, ch.lower())
            unite(ch, ch.upper())
    for a, b in _lookalikes().items():
        unite(a, b)
    for cp in np.flatnonzero(group != np.arange(LIMIT)):
        group[cp] = root(int(cp))
    return part, group


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more than texts)."""
    part, group = letters()
    points, begin = fold(*code_points(texts))
    inside = part[points]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at_begin = begin[:-1][begin[:-1] < len(points)]
    opens[at_begin] = inside[at_begin]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(begin), dtype=np.int64)
    number = np.cumsum(opens)[at] - 1
    first = np.flatnonzero(opens[at])
    place = np.arange(len(at)) - first[number]
    power = np.cumprod(np.full(int(place.max()) + 1, _ODD, dtype=np.uint64))
    terms = _mix(group[points[at]].astype(np.uint64) + np.uint64(1)) * power[place]
    hashes = _mix(np.add.reduceat(terms, first))
    return hashes, np.concatenate([[0], np.cumsum(opens)])[begin]


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    weights = np.cumprod(np.full(size, _ODD, dtype=np.uint64))
    for k in range(size):
        total += words[k : k + n] * weights[k]
    return _mix(total)


def winnow(words: np.ndarray, begin: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts and the text each is of.

    The rightmost smallest of each ``span - gram + 1`` consecutive gram hashes; a text of fewer than ``span`` words has
    none, as no shared span of that length can lie in it.
    """
    window = span - gram + 1
    hashes = grams(words, gram)
    starts = len(words) - span + 1
    if starts <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    text_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    least, where = hashes[:starts].copy(), np.arange(starts)
    for k in range(1, window):
        other = hashes[k : k + starts]
        better = other <= least
        least[better] = other[better]
        where[better] = np.flatnonzero(better) + k
    whole = text_of[:starts] == text_of[span - 1 :]
    chosen = np.unique(where[whole])
    return hashes[chosen], text_of[chosen]


def fingerprints(frame: DataFrame, key: str, text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``key, fingerprint``, each once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner = winnow(*words_of(batch.column(1)), span, gram)
            pairs = np.unique(np.stack([owner, hashes.view(np.int64)]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0])), pa.array(pairs[1])], [key, "fingerprint"])

    rows = frame.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows.mapInArrow(run, rows.select(key).schema.add("fingerprint", "long"))


def longest_shared(a: np.ndarray, b: np.ndarray, span: int = SPAN) -> int:
    """Words in the longest common run of the two texts, or 0 if it is shorter than ``span``."""
    if len(a) < span or len(b) < span:
        return 0
    ga, gb = grams(a, span), grams(b, span)
    order = np.argsort(gb, kind="stable")
    low, high = np.searchsorted(gb[order], ga, "left"), np.searchsorted(gb[order], ga, "right")
    count = high - low
    if not count.any():
        return 0
    # a whole span of one and of the other that are equal meet as (i, j); those next to each other on a diagonal make a
    # longer run. Texts that repeat themselves meet in many, so they are taken some of the first text at a time, with
    # the length of the run that ends in each place of the second carried along.
    upto, best, done = np.zeros(len(gb) + 1, dtype=np.int64), 0, -2
    steps = np.flatnonzero(count)
    for part in np.split(steps, np.unique(np.searchsorted(np.cumsum(count[steps]), np.arange(MEETING, count.sum(), MEETING)))):
        if not len(part):
            continue
        n = count[part]
        i = np.repeat(part, n)
        j = order[np.repeat(low[part], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        sure = np.ones(len(i), dtype=bool)
        for k in range(span):
            sure &= a[i + k] == b[j + k]
        i, j = i[sure], j[sure]
        if not len(i):
            upto[:], done = 0, int(part[-1])
            continue
        if part[0] != done + 1:
            upto[:] = 0
        by = np.lexsort((i, i - j))
        x, y = i[by], j[by]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (np.diff(x) != 1) | (np.diff(x - y) != 0)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(x)))
        length = length + np.where(x[begin] == part[0], upto[y[begin]], 0)  # runs from the part before go on
        best = max(best, int(length.max()))
        last = begin + np.diff(np.append(begin, len(x))) - 1
        on = x[last] == part[-1]
        upto = np.zeros(len(gb) + 1, dtype=np.int64)
        upto[y[last[on]] + 1] = length[on]
        done = int(part[-1])
    return best + span - 1 if best else 0


def _extend(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dw, db = words_of(batch.column("text"))
            iw, ib = words_of(batch.column("item_text"))
            n = [longest_shared(dw[db[k] : db[k + 1]], iw[ib[k] : ib[k + 1]], span) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(n, pa.int32())], ["doc_id", "item_id", "words"]
            )

    return run


def leaked_items(documents: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, item_id, words``: documents that hold at least ``span`` consecutive words of an item's text, with the
    words in the longest such span.

    The fingerprints of the items are broadcast only when counted and found small; else both sides shuffle by
    fingerprint. Whole texts are used, of any length; NULL texts, NULL ids and texts of fewer than ``span`` words take
    no part. Rows repeating an id are compared each and give one row. Further columns are ignored.
    """
    tests = fingerprints(items, "item_id", span=span, gram=gram)
    tests = F.broadcast(tests) if is_small(tests) else tests
    met = fingerprints(documents, "doc_id", span=span, gram=gram).join(tests, "fingerprint")
    met = materialise(met.select("doc_id", "item_id").distinct(), "met")
    few = is_small(met, 200_000)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    held = texts.join(F.broadcast(met) if few else met, "doc_id")
    passages = items.select("item_id", F.col("text").alias("item_text")).where(F.col("text").isNotNull())
    both = held.join(F.broadcast(passages) if is_light(passages, "item_text", 20_000) else passages, "item_id")
    out = both.select("doc_id", "item_id", "text", "item_text").mapInArrow(
        _extend(span), documents.select("doc_id").schema.add(items.schema["item_id"]).add("words", IntegerType())
    )
    return out.where(F.col("words") > 0).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: ``item_id, documents, longest, example`` (the smallest ``doc_id`` of those with the longest span).
    Items that leaked nowhere have 0 documents and NULLs."""
    leaks = leaked_items(documents, items)
    ranked = leaks.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("words").alias("longest"),
        F.min_by("doc_id", F.struct(-F.col("words"), F.col("doc_id"))).alias("example"),
    )
    return (
        items.select("item_id").where(F.col("item_id").isNotNull()).distinct()
        .join(ranked, "item_id", "left").fillna(0, subset=["documents"])
    )
