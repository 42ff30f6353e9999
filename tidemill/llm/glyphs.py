"""One form for texts that look the same.

Arrow text becomes one array of code points per batch. Lookup tables, built from the Unicode database by rule, say for
each code point what it is replaced by: canonical decomposition, plain letters for full-width forms and ligatures, a
plain space for unusual ones, nothing for invisible ones, one letter for look-alikes. Marks are then ordered and
composed again, all in array operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.joins import salted_join, sized_join
from tidemill.sources.scratch import materialise

# Letters of other scripts, and hyphens, that are drawn like the character below them.
LOOKALIKE = {
    "Cyrillic small": ("аеорсухѕіјһԁԛԝӏ", "aeopcyxsijhdqwl"),
    "Cyrillic capital": ("АВЕКМНОРСТУХЅІЈҮԌԚԜӀ", "ABEKMHOPCTYXSIJYGQWI"),
    "Greek small": ("ονϲϳ", "ovcj"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    "Armenian": ("օսհոՕ", "ouhnO"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4RWSLCPKB"),
    "Lisu": ("ꓐꓚꓓꓰꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "BCDEGHJKLMNOPRSTUVWXYZ"),
    "Hyphens": ("‐‑", "--"),
}
#: Kinds of compatibility characters drawn like their plain letters. Superscripts, circled letters and the like differ.
PLAIN_KINDS = ("<wide>", "<narrow>", "<compat>", "<noBreak>")
SPACE = 0x20
LIMIT = 0x110000
#: Invisible though not of category Cf: variation selectors, the grapheme joiner and Hangul fillers.
INVISIBLE = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0x180B, 0x180E)]
_INVISIBLE = frozenset(INVISIBLE)


def _lookalikes() -> dict[str, str]:
    return {a: b for one, plain in LOOKALIKE.values() for a, b in zip(one, plain, strict=True)}


def _shown(ch: str, alike: dict[str, str]) -> str:
    """What a character is replaced by, marks apart."""
    category = unicodedata.category(ch)
    if category == "Cf" or ord(ch) in _INVISIBLE:
        return ""
    if category == "Zs" or ch in "\t\n\r\x0b\x0c\x85  ":
        return " "
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in PLAIN_KINDS:
        plain = unicodedata.normalize("NFKD", ch)
        # a spacing accent would become a blank with a mark on it, which it isn't
        text = ch if " " in plain else plain
    else:
        text = unicodedata.normalize("NFD", ch)
    out = []
    for x in text:
        inner = unicodedata.decomposition(x).partition(" ")[0]
        x = unicodedata.normalize("NFKD", x) if x != ch and inner in PLAIN_KINDS else x
        out.append("".join(alike.get(y, y) for y in x))
    return "".join(out)


class Tables:
    """Lookups over all code points."""

    def __init__(self) -> None:
        alike = _lookalikes()
        start, length, flat = np.arange(LIMIT, dtype=np.int32), np.ones(LIMIT, dtype=np.int32), []
        ccc = np.zeros(LIMIT, dtype=np.uint8)
        pairs: dict[int, int] = {}
        second = np.zeros(LIMIT, dtype=bool)
        blocks = [*range(0x30000), *range(0xE0000, 0xE0200)]
        for cp in blocks:
            if 0xD800 <= cp < 0xE000:
                continue
            ch = chr(cp)
            if rank := unicodedata.combining(ch):
                ccc[cp] = rank
            shown = _shown(ch, alike)
            if shown != ch:
                start[cp], length[cp] = LIMIT + len(flat), len(shown)
                flat += map(ord, shown)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in parts)
                pairs[a << 21 | b] = cp
        for cp in range(0xAC00, 0xAC00 + 11172):  # Hangul syllables compose by arithmetic, here as pairs
            lead, tail = divmod(cp - 0xAC00, 28)
            a, b = (0xAC00 + lead * 28, 0x11A7 + tail) if tail else (0x1100 + lead // 21, 0x1161 + lead % 21)
            pairs[a << 21 | b] = cp
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_values = keys, np.array([pairs[int(k)] for k in keys], dtype=np.int32)
        marks = np.unique(keys & (1 << 21) - 1)
        second[marks[ccc[marks] == 0]] = True
        self.start, self.length, self.ccc, self.joins = start, length, ccc, second
        self.flat = np.concatenate([np.arange(LIMIT, dtype=np.int32), np.array(flat, dtype=np.int32)])

    def composed(self, base: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The composed character, or -1."""
        key = base.astype(np.int64) << 21 | mark
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], -1)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and where each text begins (one more than texts)."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(texts) else b""
    points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
    begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])
    return points, at[offsets - offsets[0]] if len(texts) else np.zeros(1, dtype=np.int64)


def to_texts(points: np.ndarray, begin: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width)])[begin].astype(np.int64)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = None if nulls is None else pa.array(~nulls).buffers()[1]
    return pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(offsets), pa.py_buffer(data), valid)


def fold(points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of texts given as code points."""
    t = tables()
    length = t.length[points]
    ends = np.concatenate([[0], np.cumsum(length)])
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
    out = t.flat[np.repeat(t.start[points], length) + within]
    begin = ends[begin]
    rank = t.ccc[out]
    opens = np.zeros(len(out) + 1, dtype=bool)
    opens[begin] = True
    opens = opens[:-1]
    if not (rank.any() or t.joins[out].any()):
        return out, begin
    out, rank = _ordered(out, rank, opens)
    keep = _compose(out, rank, opens, t)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[begin]


def _ordered(out: np.ndarray, rank: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks after one character in canonical order."""
    wrong = (rank[1:] > 0) & (rank[:-1] > rank[1:]) & ~opens[1:]
    if not wrong.any():
        return out, rank
    run = np.cumsum((rank == 0) | opens)
    touched = np.isin(run, np.unique(run[1:][wrong])) & (rank > 0)
    at = np.flatnonzero(touched)
    order = at[np.lexsort((at, rank[at], run[at]))]
    out, rank = out.copy(), rank.copy()
    out[at], rank[at] = out[order], rank[order]
    return out, rank


def _compose(out: np.ndarray, rank: np.ndarray, opens: np.ndarray, t: Tables) -> np.ndarray:
    """Writes composed characters over their bases; what stays is marked in the result."""
    keep = np.ones(len(out), dtype=bool)
    joining = ((rank > 0) | t.joins[out]) & ~opens
    base = np.flatnonzero(~joining)
    at = np.flatnonzero(joining)
    if not len(at):
        return keep
    owner = np.searchsorted(base, at) - 1  # the first of a text never joins, so each mark has an owner
    nth = at - base[owner]
    holder, last = base.copy(), np.full(len(base), -1, dtype=np.int16)  # rank of the last mark kept after the holder
    order = np.argsort(nth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1):
        mark, who = at[part], owner[part]
        free = (last[who] < rank[mark]) & ((rank[mark] > 0) | (last[who] == -1))
        new = np.where(free, t.composed(out[holder[who]], out[mark]), -1)
        done = new >= 0
        out[holder[who[done]]] = new[done]
        keep[mark[done]] = False
        stays, w = mark[~done], who[~done]
        plain = rank[stays] == 0
        holder[w[plain]] = stays[plain]
        last[w] = np.where(plain, -1, rank[stays])
    return keep


def consistent(texts: pa.Array) -> pa.Array:
    """The form of each text; NULL stays NULL."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    nulls = np.asarray(texts.is_null()) if texts.null_count else None
    return to_texts(*fold(*code_points(texts)), nulls)


def consistent_form(frame: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """Adds the consistent form of a text column (replacing a column of that name).

    Whole texts of any length; NULL gives NULL, the empty text itself. Case, accents, digits, punctuation and the
    number of spaces stay as they are.
    """
    columns = [c for c in frame.columns if c != form]
    schema = frame.select(*columns).schema.add(form, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = consistent(batch.column(columns.index(text))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*columns, form])

    return frame.select(*columns).mapInArrow(run, schema)


def _digests(documents: DataFrame) -> DataFrame:
    """``doc_id, look, twin, spelling`` of the texts: 128 bits of the form, 64 of the text itself. Written once."""
    rows = documents.select("doc_id", "text").where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
    )
    keyed = consistent_form(rows).select(
        "doc_id", F.xxhash64("form").alias("look"), F.xxhash64(F.lit(1), "form").alias("twin"), F.xxhash64(F.lit(2), "text").alias("spelling")
    )
    return materialise(keyed, "digests")


LOOK = ["look", "twin"]


def _several(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The looks with several spellings: their classes ``look, twin, spelling, copies, spellings, alike``, and their members."""
    looks = keyed.groupBy(*LOOK).agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select(*LOOK)
    members = materialise(sized_join(keyed, looks, LOOK), "members")
    classes = members.groupBy(*LOOK, "spelling").agg(F.count(F.lit(1)).alias("copies"))
    whole = classes.groupBy(*LOOK).agg(F.count(F.lit(1)).alias("spellings"), F.sum("copies").alias("alike"))
    return materialise(sized_join(classes, whole, LOOK), "classes"), members


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """``doc_id, look, twin, spelling, copies, spellings, alike`` of documents whose text looks like one of other characters: the
    class of its look and of its spelling, the documents of that spelling, and the spellings and documents of the look. One
    row a document, however many look alike. NULL and empty texts and NULL ids take no part."""
    classes, members = _several(_digests(documents))
    return sized_join(members, classes, [*LOOK, "spelling"]).select("doc_id", *LOOK, "spelling", "copies", "spellings", "alike")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` (smaller first) of documents whose texts look the same but differ in their characters.

    Only digests are shuffled. Texts of one form are grouped to classes of equal texts first; pairs are formed between
    classes and then given their members, so copies of one text never meet each other, however many there are; the members
    of a class are spread where they meet those of another. NULL and empty texts and NULL ids take no part; further columns
    are ignored. Where copies make the pairs too many, ``lookalike_classes`` tells the same in a row a document.
    """
    classes, members = _several(_digests(documents))
    pairs = classes.select(*LOOK, F.col("spelling").alias("spelling_a")).join(classes.select(*LOOK, F.col("spelling").alias("spelling_b")), LOOK)
    pairs = pairs.where(F.col("spelling_a") < F.col("spelling_b"))
    left = members.select(F.col("doc_id").alias("left_id"), *LOOK, F.col("spelling").alias("spelling_a"))
    right = members.select(F.col("doc_id").alias("right_id"), *LOOK, F.col("spelling").alias("spelling_b"))
    both = salted_join(salted_join(left, pairs, [*LOOK, "spelling_a"]), right, [*LOOK, "spelling_b"])
    return both.select(
        F.least("left_id", "right_id").alias("doc_id_a"), F.greatest("left_id", "right_id").alias("doc_id_b")
    ).where("doc_id_a <> doc_id_b")
