"""SQL that must give the same rows."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from tidemill.llm.glyphs import LOOKALIKE, PLAIN_KINDS
from tidemill.llm.leakage import letters

_VALID = """valid AS (
  SELECT series_id, t, v, t // 86400000 AS day_no FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY recv_ms DESC NULLS LAST, v DESC NULLS LAST) AS rn
    FROM points WHERE series_id IS NOT NULL AND t IS NOT NULL)
  WHERE rn = 1 AND v IS NOT NULL AND NOT isnan(v))"""


def _vectors(alias: str, key: str, column: str, source: str) -> str:
    return f"""{alias}_raw AS (
      SELECT {key}, list_transform({column}, lambda x: x - list_avg({column})) AS a FROM {source}
      WHERE len({column}) = 64 AND len(list_filter({column}, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        AND list_min({column}) < list_max({column})),
    {alias} AS (SELECT {key}, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS u FROM {alias}_raw)"""


_PAIRS = f"""WITH {_vectors("p", "pattern_id", "np_pattern_values", "patterns")},
  {_vectors("w", "seq_id", "np_values", "search_windows")},
  ranked AS (
    SELECT pattern_id, seq_id, round(list_dot_product(p.u, w.u), 6) AS similarity,
      row_number() OVER (PARTITION BY pattern_id ORDER BY round(list_dot_product(p.u, w.u), 6) DESC, seq_id) AS place
    FROM p CROSS JOIN w)"""

_COURSES = f"""WITH RECURSIVE {_VALID},
  stated AS (
    SELECT tsuid AS series_id, arg_max(value, (updated_at, value)) AS text FROM metadata
    WHERE lower(trim(name, ' ' || chr(9))) = 'qual_ref_period' GROUP BY ALL),
  spelt AS (
    SELECT series_id, CASE WHEN regexp_full_match(trim(text, ' ' || chr(9)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
                           THEN try_cast(trim(text, ' ' || chr(9)) AS DOUBLE) END AS p FROM stated),
  per AS (
    SELECT coalesce(s.series_id, r.series_id) AS series_id, coalesce(s.ref_period, CAST(floor(r.p) AS BIGINT)) AS period
    FROM series s FULL JOIN spelt r ON s.series_id = r.series_id),
  medians AS (
    SELECT series_id, (t // 3600000) % 24 AS hour, quantile_cont(v, 0.5) AS median, count(*) AS n
    FROM valid JOIN per USING (series_id) WHERE period BETWEEN 1 AND 3600000 GROUP BY ALL),
  fit AS (SELECT series_id FROM medians GROUP BY ALL HAVING count(*) = 24 AND min(n) >= 3)"""

_CLUSTERS = f"""{_COURSES},
        base AS (SELECT series_id, avg(median) AS mean, stddev_pop(median) AS dev FROM medians SEMI JOIN fit USING (series_id) GROUP BY ALL),
        z AS (SELECT series_id, hour, (median - mean) / dev AS z FROM medians JOIN base USING (series_id) WHERE dev > 0),
        links AS (
          SELECT a.series_id AS a, b.series_id AS b FROM z a JOIN z b ON a.hour = b.hour
          GROUP BY ALL HAVING sum(a.z * b.z) / 24 >= 0.95 - 1e-12),
        walk AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b)"""


@lru_cache(maxsize=1)
def _plain() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters and the one each is drawn like, by the names of their decompositions, and those drawn like several."""
    alike = {a: b for one, plain in LOOKALIKE.values() for a, b in zip(one, plain, strict=True)}
    one, other, several = [], [], []
    for cp in [*range(0x80, 0x3001), *range(0x3130, 0x3190), *range(0xF900, 0xFFF0)]:
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Co", "Cf"):
            continue
        kind = unicodedata.decomposition(ch).partition(" ")[0]
        to = unicodedata.normalize("NFKD" if kind in PLAIN_KINDS else "NFD", ch)
        if unicodedata.category(ch) == "Zs":
            to = " "
        elif " " in to:
            continue
        to = unicodedata.normalize("NFC", "".join(alike.get(x, x) for x in to))
        if to != unicodedata.normalize("NFC", ch):
            if len(to) == 1:
                one.append(ch)
                other.append(to)
            else:
                several.append((ch, to))
    return "".join(one), "".join(other), several


def _look(text: str) -> str:
    """The text in which what looks the same is the same, for the characters of the test tables' languages."""
    one, other, several = _plain()
    invisible = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}]"
    out = f"regexp_replace(regexp_replace({text}, '{invisible}', '', 'g'), '[\\t\\n\\r\\x0b\\x0c\\x85\\x{{2028}}\\x{{2029}}]', ' ', 'g')"
    quoted = lambda x: x.replace("'", "''")
    out = f"translate(nfc_normalize({out}), '{quoted(one)}', '{quoted(other)}')"
    for a, b in several:
        if unicodedata.category(a)[0] in "LP":
            out = f"replace({out}, '{quoted(a)}', '{quoted(b)}')"
    return f"nfc_normalize({out})"


def _words(text: str) -> str:
    """Runs of letters and digits, by classes of letters that differ in case or are only drawn alike."""
    group = letters()[1]
    pairs = [(chr(cp), chr(group[cp])) for cp in range(0x530) if group[cp] != cp]
    return f"regexp_extract_all(translate({_look(text)}, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


_LOOKS = f"""WITH forms AS (SELECT doc_id, text, {_look("text")} AS form FROM documents WHERE text <> ''),
  looks AS (SELECT form, count(DISTINCT text) AS spellings, count(*) AS alike FROM forms GROUP BY ALL HAVING count(DISTINCT text) > 1)"""


def _days(ps: tuple[float, ...]) -> str:
    """Percentiles and the readings on both sides of them. A day of few readings has them exactly."""
    columns = []
    for p in ps:
        name, place = f"p{p * 100:g}".replace(".", "_"), f"{p} * (len(x) - 1)"
        at = lambda how, place=place: f"x[CAST({how}({place}) AS BIGINT) + 1]"
        value = f"{at('floor')} + ({at('ceil')} - {at('floor')}) * ({place} - floor({place}))"
        columns += [f"round(({value}) * 1.00000000001, 6) AS {name}", f"round({at('floor')} * 1.00000000001, 6) AS {name}_low", f"round({at('ceil')} * 1.00000000001, 6) AS {name}_high"]
    return f"""WITH {_VALID}, d AS (SELECT series_id, day_no, list_sort(list(v)) AS x FROM valid GROUP BY ALL)
        SELECT series_id, day_no, CAST(len(x) AS BIGINT) AS n, CAST(0 AS BIGINT) AS error, {", ".join(columns)} FROM d WHERE len(x) <= 1024"""


ORACLE = {
    "p2_found": f"""{_CLUSTERS} SELECT a AS series_id, min(b) AS cluster_id FROM walk GROUP BY a HAVING count(DISTINCT b) >= 2""",
    "p2_typical": f"""{_CLUSTERS},
        named AS (SELECT a AS series_id, min(b) AS cluster_id FROM walk GROUP BY a),
        unit AS (SELECT series_id, cluster_id, hour, z / sqrt(24) AS u FROM z JOIN named USING (series_id)),
        centre AS (SELECT cluster_id, hour, avg(u) AS m, count(*) AS size FROM unit GROUP BY ALL),
        far AS (SELECT cluster_id, series_id, any_value(size) AS size, round(sum((u - m) * (u - m)), 9) AS off FROM unit JOIN centre USING (cluster_id, hour) GROUP BY cluster_id, series_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY off, series_id) AS place FROM far)
        SELECT cluster_id, any_value(size) AS size, round(avg(off), 6) AS spread, string_agg(series_id, ',' ORDER BY place) FILTER (place <= 3) AS typical
        FROM placed GROUP BY cluster_id""",
    "p8_report": f"""WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, {_words("text")} AS w FROM eval_items WHERE text <> ''),
        dg AS (SELECT doc_id, unnest(range(1, len(w) - 8)) AS k, w FROM d WHERE len(w) >= 10), ig AS (SELECT item_id, unnest(range(1, len(w) - 8)) AS j, w FROM i WHERE len(w) >= 10),
        met AS (SELECT doc_id, item_id, k, k - j AS along FROM dg JOIN ig ON array_to_string(dg.w[k : k + 9], ' ') = array_to_string(ig.w[j : j + 9], ' ')),
        placed AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, along ORDER BY k) AS island FROM met),
        runs AS (SELECT doc_id, item_id, count(*) + 9 AS words FROM placed GROUP BY doc_id, item_id, along, island),
        leaks AS (SELECT doc_id, item_id, max(words) AS words FROM runs GROUP BY ALL)
        SELECT item_id, count(doc_id) AS documents, CAST(max(words) AS INT) AS longest, arg_min(doc_id, (-words, doc_id)) AS example
        FROM (SELECT DISTINCT item_id FROM eval_items WHERE item_id IS NOT NULL) LEFT JOIN leaks USING (item_id) GROUP BY item_id""",
    "p10_form": f"""SELECT doc_id, {_look("text")} AS form, coalesce({_look("text")}, '') <> coalesce(text, '') AS changed FROM documents""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, {_words("text")} AS w FROM eval_items),
        dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k : k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
        ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k : k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_found": r"""WITH k AS (SELECT lower(trim(source, ' ' || chr(9))) AS key, min(source) AS source, max(target_share) AS share, max(max_repeats) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY ALL),
        s AS (SELECT lower(trim(source, ' ' || chr(9))) AS key, sum(strlen(coalesce(text, ''))) AS size FROM documents GROUP BY ALL),
        b AS (SELECT k.*, coalesce(size, 0) AS size FROM k LEFT JOIN s USING (key))
        SELECT source FROM b WHERE size * most < share * (SELECT sum(size) FROM b)""",
    "p10_found": f"""{_LOOKS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p10_classes": f"""{_LOOKS} SELECT doc_id, spellings, alike, count(*) OVER (PARTITION BY text) AS copies FROM forms JOIN looks USING (form)""",
    "p1_similar": f"{_PAIRS} SELECT pattern_id, seq_id, similarity, place FROM ranked WHERE place <= 5",
    "p5_small_days": _days((0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)),
    "p5_checked": f"""WITH {_VALID} SELECT series_id, count(*) AS n, {", ".join(f"round(quantile_cont(v, {p}) * 1.00000000001, 6) AS p{p * 100:g}" for p in (0.5, 0.9, 0.99))},
        true AS holds FROM valid GROUP BY ALL""",
    "p2_courses": f"""{_COURSES} SELECT series_id, CAST(hour AS INT) AS hour, round(median * 1.00000000001, 6) AS median
        FROM medians SEMI JOIN fit USING (series_id)""",
    "p1_found": f"{_PAIRS} SELECT pattern_id, seq_id FROM ranked WHERE place <= 5 AND similarity >= 0.9",
    "p5_found": f"""WITH {_VALID},
        tops AS (SELECT series_id, round(quantile_cont(v, 0.9), 6) AS p90 FROM valid GROUP BY ALL),
        days AS (SELECT series_id, day_no, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50 FROM valid GROUP BY ALL)
        SELECT series_id, day_no FROM days JOIN tops USING (series_id) WHERE n >= 20 AND p50 > p90""",
}
