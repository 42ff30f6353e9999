"""Recurring patterns: collisions of words under random masks, and the neighbourhoods grown from them.

Windows with equal words are one class with its members, so a word that a third of all windows share makes no pairs with
itself.
"""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.joins import sized_join
from tidemill.operators.symbolic import mindist_table, sliding_windows, words_of_windows
from tidemill.sources.scratch import materialise


def masks_of(word_size: int, kept: int, iterations: int | None = None, seed: int = 0) -> list[tuple[int, ...]]:
    """All subsets of ``kept`` places of a word, or a seeded sample of ``iterations`` of them."""
    if not 1 <= kept <= word_size:
        raise ValueError("the places kept must be from 1 to the word's size")
    every = math.comb(word_size, kept)
    if iterations is None or iterations >= every:
        return list(itertools.combinations(range(word_size), kept))
    rng, out = random.Random(seed), set()
    while len(out) < iterations:
        out.add(tuple(sorted(rng.sample(range(word_size), kept))))
    return sorted(out)


def word_classes(words: DataFrame) -> DataFrame:
    """``word, n``: each word and how many windows have it."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _meeting(left: DataFrame, right: DataFrame, places: int, length: int) -> DataFrame:
    """``word_a, size_a, word_b, size_b, same``: the words of both sides that agree in at least ``places`` places, each pair
    once, with the number of their equal places. Words meet only those with an equal key of so many letters; of the keys
    that a pair shares, the one of its first equal places counts."""
    entries = [
        F.struct(F.concat(F.lit(f"{k}:"), *(F.substring("word", p + 1, 1) for p in mask)).alias("key"), F.lit(mask[-1]).alias("last"))
        for k, mask in enumerate(itertools.combinations(range(length), places))
    ]
    a = left.select(F.col("word").alias("word_a"), F.col("n").alias("size_a"), F.explode(F.array(*entries)).alias("m")).select("word_a", "size_a", "m.key", "m.last")
    b = right.select(F.col("word").alias("word_b"), F.col("n").alias("size_b"), F.explode(F.array(*entries)).alias("m")).select("word_b", "size_b", "m.key")
    equal = [(F.substring("word_a", p + 1, 1) == F.substring("word_b", p + 1, 1)).cast("int") for p in range(length)]
    until = sum((F.when(F.col("last") >= p, e).otherwise(0) for p, e in enumerate(equal)), F.lit(0))
    first = a.join(b, "key").where((F.col("word_a") != F.col("word_b")) & (until == places))
    return first.select("word_a", "size_a", "word_b", "size_b", sum(equal, F.lit(0)).alias("same"))


def _all_ways(kept: int, length: int) -> Column:
    """In how many of all masks words with ``same`` equal places agree."""
    return F.element_at(F.array(*(F.lit(math.comb(k, kept)).cast("long") for k in range(length + 1))), F.col("same") + 1)


def collisions(
    words: DataFrame, kept: int, iterations: int | None = None, seed: int = 0, word_size: int | None = None, above: float = 0
) -> DataFrame:
    """``word_a, word_b, n, size_a, size_b`` (``word_a < word_b``): in how many masks two different words agree, where they
    are more than ``above``. Windows of the same word agree in all masks and aren't listed; ``size`` says how many there are.

    Each mask's letters are a key; words meet only those with an equal key. Under all masks a pair agrees in as many as
    its equal places allow, so keys have as many letters as it takes to agree in more than ``above``.
    """
    classes = word_classes(words) if "n" not in words.columns else words.select("word", "n")
    length = word_size or (classes.select(F.max(F.length("word"))).first()[0] or 0)
    none = classes.select(F.col("word").alias("word_a"), F.col("word").alias("word_b"), F.lit(0).cast("long").alias("n"), F.col("n").alias("size_a"), F.col("n").alias("size_b")).limit(0)
    if not length:
        return none
    masks = masks_of(length, kept, iterations, seed)
    if len(masks) == math.comb(length, kept):
        places = next((e for e in range(kept, length) if math.comb(e, kept) > above), None)
        if places is None:
            return none
        met = _meeting(classes, classes, places, length).where("word_a < word_b")
        return met.select("word_a", "word_b", _all_ways(kept, length).alias("n"), "size_a", "size_b")
    entries = [F.concat(F.lit(f"{k}:"), *(F.substring("word", p + 1, 1) for p in mask)) for k, mask in enumerate(masks)]
    keyed = classes.select("word", "n", F.explode(F.array(*entries)).alias("key"))
    a = keyed.select(F.col("word").alias("word_a"), F.col("n").alias("size_a"), "key")
    b = keyed.select(F.col("word").alias("word_b"), F.col("n").alias("size_b"), "key")
    met = a.join(b, "key").where("word_a < word_b")
    cells = met.groupBy("word_a", "word_b").agg(F.count(F.lit(1)).alias("n"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return cells.where(F.col("n") > above)


def partners(own: DataFrame, classes: DataFrame, kept: int, length: int) -> DataFrame:
    """``word_a, word_b, n``: of the words in ``own`` (``word``) those they agree with under at least one of all masks."""
    met = _meeting(own.select("word", F.lit(1).cast("long").alias("n")), classes, kept, length)
    return met.select("word_a", "word_b", _all_ways(kept, length).alias("n"))


# How chance, and the least number of equal masks, follow from the sizes of words and alphabets.
def expected_collisions(sequences: int, alphabet: int, word_size: int, errors: int, kept: int, iterations: int) -> float:
    """How many collisions two windows may have by chance: the threshold above which a cell counts."""
    p = sum(
        (1 - i / word_size) ** kept * math.comb(word_size, i) * ((alphabet - 1) / alphabet) ** i * (1 / alphabet) ** (word_size - i)
        for i in range(errors + 1)
    )
    value = p * math.comb(sequences, 2)
    return iterations - 1 if value >= 1 else value * iterations


def word_distance(a: Column, b: Column, table: list[list[float]], window: int) -> Column:
    """MINDIST of two words of equal length: a lower bound of the distance of their windows."""
    flat = F.array(*(F.lit(x * x) for row in table for x in row))
    n = len(table)
    index = lambda w, k: F.ascii(F.substring(w, k, 1)) - 97
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(a)), F.lit(0.0), lambda s, k: s + F.element_at(flat, (index(a, k) * n + index(b, k) + 1).cast("int"))
    )
    return F.sqrt(F.lit(float(window)) / F.length(a)) * F.sqrt(total)


def _pairs_both_ways(cells: DataFrame) -> DataFrame:
    back = cells.select(F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"), "n")
    return cells.select("word_a", "word_b", "n").unionByName(back)


def recognise(classes: DataFrame, cells: DataFrame, seeds: DataFrame, table: list[list[float]], window: int, radius: float, brute_force: bool = False) -> DataFrame:
    """``words``: the distinct groups grown from seed pairs that are nearer than ``radius``: all words near either word
    of the pair, either among those that collide with one of them or, with ``brute_force``, among all words."""
    near = word_distance(F.col("word_a"), F.col("word_b"), table, window) < radius
    pairs = seeds.where(near).select(F.col("word_a").alias("i"), F.col("word_b").alias("j"))
    ends = pairs.select("i", "j", F.explode(F.array("i", "j")).alias("word_a"))
    if brute_force:
        others = _near_words(ends.select("word_a").distinct(), classes, table, window, radius)
    else:
        others = _pairs_both_ways(cells).where(near).select("word_a", "word_b")
    grown = ends.join(others, "word_a", "left").groupBy("i", "j").agg(F.collect_set("word_b").alias("found"))
    group = F.array_sort(F.array_distinct(F.concat(F.array("i", "j"), F.array_compact("found"))))
    return grown.select(group.alias("words")).distinct()


def _near_words(own: DataFrame, classes: DataFrame, table: list[list[float]], window: int, radius: float) -> DataFrame:
    """``word_a, word_b``: of each of the words in ``own`` all words nearer than ``radius``. Words meet where the first two
    letters of one are near enough to those of the other."""
    n = len(table)
    length = F.length("word_a")
    near = [F.array(*(F.struct(F.chr(F.lit(97 + j).cast("long")).alias("letter"), F.lit(table[i][j] ** 2).alias("square")) for j in range(n))) for i in range(n)]
    letters = F.array(*near)

    def allowed(place: int) -> Column:
        row = F.element_at(letters, (F.ascii(F.substring("word_a", place, 1)) - 96).cast("int"))
        return F.transform(F.filter(row, lambda x: F.sqrt(x["square"] * window / length) < radius), lambda x: x["letter"])

    asked = own.select("word_a", F.explode(allowed(1)).alias("one")).select("word_a", "one", F.explode(allowed(2)).alias("two"))
    asked = asked.select("word_a", F.concat("one", "two").alias("key"))
    met = asked.join(classes.select(F.col("word").alias("word_b"), F.substring("word", 1, 2).alias("key")), "key")
    return met.where(word_distance(F.col("word_a"), F.col("word_b"), table, window) < radius).select("word_a", "word_b")


def pattern_regex(words: Column, alphabet: int) -> Column:
    """Per place the one letter, the letters in brackets, or ``*`` where all occur."""
    places = F.sequence(F.lit(1), F.length(F.element_at(words, 1)))

    def at(k):
        letters = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, k, 1))))
        return (
            F.when(F.size(letters) == 1, F.element_at(letters, 1))
            .when(F.size(letters) == alphabet, F.lit("*"))
            .otherwise(F.concat(F.lit("["), F.array_join(letters, ""), F.lit("]")))
        )

    return F.when(F.size(words) == 0, F.lit("No Regex")).otherwise(F.array_join(F.transform(places, at), ""))


@dataclass(frozen=True)
class MotifSettings:
    """How motifs are searched; names follow the steps."""

    size: int
    overlap: float = 0.8
    paa: int = 10
    alphabet: int = 8
    local_norm: bool = True
    global_norm: bool = False
    linear_filter: tuple[float, float] | None = (0.005, 0.95)
    collision_share: float = 1.0
    collision_places: int = 2
    by_collisions: bool = True
    iterative: bool = False
    iterations: int = 10
    radius: float = 1.5
    seed: int = 0

    def checked(self) -> MotifSettings:
        if not 2 <= self.paa <= self.size:
            raise ValueError("paa must be from 2 to the window size")
        if not 2 <= self.alphabet <= 26:
            raise ValueError("the alphabet must be from 2 to 26")
        if self.collision_places not in range(2, self.paa - 1):
            raise ValueError("collision places must be from 2 to paa - 2")
        if not 0 <= self.overlap < 1 or not 0 < self.collision_share <= 1 or self.radius <= 0 or self.iterations < 1:
            raise ValueError("overlap, share, radius or iterations out of range")
        return self


def motifs(readings: DataFrame, settings: MotifSettings) -> DataFrame:
    """``pattern_id, regex, words, length, locations`` (``series_id, t, size, avg, dev, paa`` of each window) of the
    recurring patterns of all series, by random projection.

    Windows become words; pairs of words that collide in more masks than chance explains seed groups; a group takes the
    words near its seed. Patterns are numbered by their regex and words.
    """
    s = settings.checked()
    windows = sliding_windows(readings, s.size, s.overlap, s.global_norm, s.global_norm, s.local_norm, s.linear_filter, s.radius / 2)
    worded, breaks = words_of_windows(windows, s.paa, s.alphabet)
    classes = materialise(word_classes(worded), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    combos = math.comb(s.paa, s.collision_places)
    iterations = min(max(1, int(combos * s.collision_share)), 10_000)
    table = mindist_table(breaks)
    errors = int(s.paa / 10) ** 2 + int(s.alphabet / 10)
    chance = expected_collisions(total, s.alphabet, s.paa, errors, s.collision_places, iterations)
    least = max(chance, int(0.05 * combos), 1)
    every = iterations >= combos
    cells = materialise(collisions(classes, s.collision_places, iterations, s.seed, s.paa, least if every else 0), "cells")
    seeds = cells.where(F.col("n") > least)
    if s.iterative:  # the greatest counts first, as many as there are rounds
        counts = [r["n"] for r in seeds.select("n").distinct().orderBy(F.col("n").desc()).limit(s.iterations).collect()]
        seeds = seeds.where(F.col("n").isin(counts))
    if every and s.by_collisions:  # groups only look at what their seeds' own words agree with
        near = word_distance(F.col("word_a"), F.col("word_b"), table, s.size) < s.radius
        own = seeds.where(near).select(F.explode(F.array("word_a", "word_b")).alias("word")).distinct()
        cells = partners(own, classes, s.collision_places, s.paa)
    groups = recognise(classes, cells, seeds, table, s.size, s.radius, not s.by_collisions)
    # windows of one word are a motif of their own if they are several
    alone = classes.where("n > 1").select(F.array("word").alias("words"))
    listed = groups.unionByName(alone).distinct().withColumn("regex", pattern_regex(F.col("words"), s.alphabet))
    listed = listed.withColumn("pattern_id", F.md5(F.array_join("words", ",")))
    entries = listed.select("pattern_id", "regex", F.size("words").alias("words"), F.explode("words").alias("word"))
    avg = F.col("ts_mean") + F.col("local_mean") * F.col("ts_scale") if s.global_norm else F.col("local_mean")
    dev = F.col("local_std") * F.col("ts_scale") if s.global_norm else F.col("local_std")
    location = F.struct(F.col("series_id"), F.col("start_ms").alias("t"), F.lit(s.size).alias("size"), avg.alias("avg"), dev.alias("dev"), F.col("paa"))
    # a word that many windows have is spread, unless the patterns are few enough to be broadcast
    return sized_join(worded, entries, "word").select("pattern_id", "regex", "words", F.lit(s.size).alias("length"), location.alias("location"))
