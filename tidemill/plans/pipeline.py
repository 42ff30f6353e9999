"""Queries of the general data-preparation problems (p3, p4, p6, p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.compare import settled
from tidemill.functions.compare import settled_sql as s_
from tidemill.functions.typed import number
from tidemill.operators import grid, readings, rolling, spikes, wide
from tidemill.sources.tables import table


def periods(spark: SparkSession, d: str) -> DataFrame:
    return readings.period_of(table(spark, d, "series"), table(spark, d, "metadata"), number)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unreadable_cells(table(spark, d, "metadata"), table(spark, d, "md_types"))


#: The declared attributes by type, but for the two that repeat a series' own start and end.
_TYPES = {
    "string": ("metric", "funcid", "unit", "site", "firmware", "line", "keeper_note", "enclosure", "protocol", "shift_group", "rack"),
    "number": (
        "qual_ref_period", "qual_nb_points", "qual_min_value", "qual_max_value", "qual_average", "sensor_gain", "install_height_m", "batch_no",
        "cable_length_m", "offset_corr", "sample_bits", "noise_floor",
    ),
    "date": ("calibration_date", "warranty_end", "last_visit", "commissioned"),
}
_WIDE = [name for names in _TYPES.values() for name in names]


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with all declared attributes, and its lists and map as text."""
    rows = wide.widen(table(spark, d, "metadata"), table(spark, d, "md_types"))
    as_text = {"unfilled": F.array_join(F.array_sort("unfilled"), ","), "absent": F.array_join(F.array_sort("absent"), ",")}
    pairs = F.transform(F.map_entries("other"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit(""))))
    rows = rows.withColumns({**as_text, "other": F.array_join(F.array_sort(pairs), ",")})
    return rows.select("tsuid", *_WIDE, "other", "unfilled", "absent")


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    """How many newest cells of each declared attribute could be read."""
    cells = wide.typed_cells(table(spark, d, "metadata"), table(spark, d, "md_types"))
    return cells.groupBy("name", "data_type").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.col("readable").cast("long")).alias("readable")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.surging_days(table(spark, d, "points"))


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    rows = rolling.trailing_totals(table(spark, d, "points"))
    return rows.select(
        "series_id", "day_no", *(settled(c).alias(c) for c in ("total_7", "avg_day_7", "avg_reading_7")), "n_7",
        *(settled(c).alias(c) for c in ("total_30", "avg_day_30", "avg_reading_30")), "n_30",
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.empty_slots(table(spark, d, "points"), periods(spark, d))


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.regular_grid(table(spark, d, "points"), periods(spark, d))
    return rows.withColumn("value", settled("value"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "points")).select("series_id", "t")


def p7_flags(spark: SparkSession, d: str) -> DataFrame:
    """With the fences of hours and of the rate of change."""
    rows = spikes.implausible(table(spark, d, "points"), context=True)
    return rows.withColumns({c: settled(c, 3) for c in ("score", "hour_score", "rate_score")})


QUERIES = {f.__name__: f for f in (p3_found, p3_wide, p3_cells, p4_found, p4_trailing, p6_found, p6_grid, p7_found, p7_flags)}

VALID = """valid AS (
  SELECT series_id, t, v, t // 86400000 AS day_no FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, t ORDER BY recv_ms DESC NULLS LAST, v DESC NULLS LAST) AS rn
    FROM points WHERE series_id IS NOT NULL AND t IS NOT NULL)
  WHERE rn = 1 AND v IS NOT NULL AND NOT isnan(v))"""
_CELLS = r"""cells AS (
  SELECT tsuid, name, value FROM (
    SELECT tsuid, lower(trim(name, ' ' || chr(9))) AS name, value,
           row_number() OVER (PARTITION BY tsuid, lower(trim(name, ' ' || chr(9)))
                              ORDER BY updated_at DESC NULLS LAST, value DESC NULLS LAST) AS rn
    FROM metadata WHERE tsuid IS NOT NULL AND lower(trim(name, ' ' || chr(9))) <> '')
  WHERE rn = 1),
typed AS (
  SELECT tsuid, name, value, m.data_type, trim(value, ' ' || chr(9)) AS bare,
         CASE WHEN regexp_full_match(trim(value, ' ' || chr(9)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
              THEN try_cast(trim(value, ' ' || chr(9)) AS DOUBLE) END AS num
  FROM cells JOIN (SELECT lower(trim(name)) AS name, data_type FROM md_types) m USING (name)),
read AS (
  SELECT *, CASE
    WHEN data_type <> 'date' THEN NULL
    WHEN regexp_full_match(bare, '[0-9]{12,13}') THEN make_timestamp(CAST(bare AS BIGINT) * 1000)
    WHEN regexp_full_match(bare, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(bare AS TIMESTAMP)
    WHEN regexp_full_match(bare, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?Z?')
    THEN try_cast(replace(replace(bare, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS moment
  FROM typed),
judged AS (
  SELECT *, value IS NOT NULL AND CASE data_type WHEN 'number' THEN num IS NOT NULL AND isfinite(num)
                                                 WHEN 'date' THEN moment IS NOT NULL ELSE TRUE END AS readable FROM read)"""
_COLUMNS = ", ".join(
    f"max({value}) FILTER (name = '{name}'{readable}) AS {name}"
    for kind, value, readable in (("string", "value", ""), ("number", "num", " AND readable"), ("date", "moment", "")) for name in _TYPES[kind]
)
_ATTRS = "(SELECT lower(trim(name)) AS name, data_type FROM md_types)"
_DENSE = f"""WITH {VALID},
daily AS (SELECT series_id, day_no, sum(v) AS s, count(*) AS c FROM valid GROUP BY ALL),
span AS (SELECT series_id, min(day_no) AS a, max(day_no) AS z FROM daily GROUP BY ALL),
days AS (SELECT series_id, a, unnest(range(a, z + 1)) AS day_no FROM span),
w AS (
  SELECT series_id, a, day_no,
    sum(coalesce(s, 0)) OVER (PARTITION BY series_id ORDER BY day_no ROWS 6 PRECEDING) AS s7,
    CAST(sum(coalesce(c, 0)) OVER (PARTITION BY series_id ORDER BY day_no ROWS 6 PRECEDING) AS BIGINT) AS c7,
    sum(coalesce(s, 0)) OVER (PARTITION BY series_id ORDER BY day_no ROWS 29 PRECEDING) AS s30,
    CAST(sum(coalesce(c, 0)) OVER (PARTITION BY series_id ORDER BY day_no ROWS 29 PRECEDING) AS BIGINT) AS c30
  FROM days LEFT JOIN daily USING (series_id, day_no))"""
_PERIODS = f"""{VALID},
stated AS (
  SELECT tsuid AS series_id, arg_max(value, (updated_at, value)) AS text FROM metadata
  WHERE lower(trim(name, ' ' || chr(9))) = 'qual_ref_period' GROUP BY ALL),
spelt AS (
  SELECT series_id, CASE WHEN regexp_full_match(trim(text, ' ' || chr(9)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
                         THEN try_cast(trim(text, ' ' || chr(9)) AS DOUBLE) END AS p FROM stated),
per AS (
  SELECT coalesce(s.series_id, r.series_id) AS series_id, coalesce(s.ref_period, CAST(floor(r.p) AS BIGINT)) AS period
  FROM series s FULL JOIN spelt r ON s.series_id = r.series_id),
pairs AS (
  SELECT series_id, period, t, v, lead(t) OVER w AS nt, lead(v) OVER w AS nv, lag(t) OVER w AS pt
  FROM valid JOIN per USING (series_id) WHERE period > 0 WINDOW w AS (PARTITION BY series_id ORDER BY t))"""

_SCATTER = f"""{VALID},
n AS (
  SELECT *, median(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b5, median(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a5,
    lag(v) OVER w AS p1, lead(v) OVER w AS f1, lead(v, 2) OVER w AS f2, lead(v, 3) OVER w AS f3,
    v - list_median([lag(v, 2) OVER w, lag(v) OVER w, lead(v) OVER w, lead(v, 2) OVER w]) AS resid,
    abs(v - lag(v) OVER w) / (t - lag(t) OVER w) * 3600000 AS rate
  FROM valid WINDOW w AS (PARTITION BY series_id ORDER BY t)),
m AS (SELECT *, lead(a5) OVER w AS c5, lead(a5, 2) OVER w AS d5 FROM n WINDOW w AS (PARTITION BY series_id ORDER BY t)),
l AS (
  SELECT *, coalesce(least({", ".join(f"abs(v - {x})" for x in ("b5", "p1", "a5", "f1"))}), 0) AS one,
    CASE WHEN f1 IS NOT NULL THEN coalesce(least({", ".join(f"abs({y} - {x})" for y in ("v", "f1") for x in ("b5", "p1", "c5", "f2"))}), 0) END AS two,
    CASE WHEN f2 IS NOT NULL THEN coalesce(least({", ".join(f"abs({y} - {x})" for y in ("v", "f1", "f2") for x in ("b5", "p1", "d5", "f3"))}), 0) END AS three
  FROM m),
o AS (
  SELECT series_id, t, v, resid, rate, p1, greatest(one, two, lag(two) OVER w, three, lag(three) OVER w, lag(three, 2) OVER w) AS off,
    sum(CASE WHEN v = p1 THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS island
  FROM l WINDOW w AS (PARTITION BY series_id ORDER BY t)),
r AS (SELECT *, count(*) OVER (PARTITION BY series_id, island) AS run FROM o),
s AS (
  SELECT series_id, (quantile_cont(resid, 0.75) - quantile_cont(resid, 0.25)) / (1.349 * 1.139) AS scatter,
    2 * count(*) FILTER (run < 8 AND v = p1) < count(*) FILTER (run < 8) AS changing
  FROM r GROUP BY ALL),
judged AS (
  SELECT r.*, t // 3600000 % 24 AS hour, scatter, coalesce(scatter > 0 AND off > 8 * scatter, false) AS spike, run >= 8 AND changing AS stuck FROM r JOIN s USING (series_id))"""

ORACLE = {
    "p7_found": f"WITH {_SCATTER} SELECT series_id, t FROM judged WHERE spike OR stuck",
    "p7_flags": f"""WITH {_SCATTER}, h AS (
          SELECT series_id, t // 3600000 % 24 AS hour, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM valid GROUP BY ALL HAVING count(*) >= 64),
        hours AS (SELECT *, (q3 - q1) / 1.349 AS hs, q1 - 8 * (q3 - q1) / 1.349 AS low, q3 + 8 * (q3 - q1) / 1.349 AS high FROM h),
        k AS (SELECT series_id, quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.75) AS q3 FROM r GROUP BY ALL),
        rates AS (SELECT series_id, (q3 - q1) / 1.349 AS rs, q3 + 8 * (q3 - q1) / 1.349 AS fastest FROM k WHERE q3 > q1),
        flags AS (
          SELECT series_id, t, v, spike, stuck, {s_("off / nullif(scatter, 0)", 3)} AS score, coalesce(hs > 0 AND (v < low OR v > high), false) AS outside,
            coalesce(rate > fastest, false) AS fast,
            {s_("CASE WHEN hs IS NOT NULL THEN greatest(low - v, v - high, 0) END / nullif(hs, 0)", 3)} AS hour_score, {s_("rate / rs", 3)} AS rate_score
          FROM judged LEFT JOIN hours USING (series_id, hour) LEFT JOIN rates USING (series_id))
        SELECT * FROM flags WHERE spike OR stuck OR outside OR fast""",
    "p3_found": f"WITH {_CELLS} SELECT tsuid, name FROM judged WHERE value IS NOT NULL AND NOT readable",
    "p3_cells": f"""WITH {_CELLS} SELECT name, data_type, count(*) AS cells, CAST(sum(CAST(readable AS INT)) AS BIGINT) AS readable
        FROM judged GROUP BY ALL""",
    "p3_wide": f"""WITH {_CELLS}, grid AS (
          SELECT tsuid, a.name, j.value, readable, num, moment
          FROM (SELECT DISTINCT tsuid FROM cells) CROSS JOIN {_ATTRS} a LEFT JOIN judged j USING (tsuid, name)),
        o AS (SELECT tsuid, string_agg(name || '=' || coalesce(value, ''), ',' ORDER BY name || '=' || coalesce(value, '')) AS other
              FROM cells WHERE name NOT IN (SELECT name FROM {_ATTRS} a) GROUP BY tsuid)
        SELECT grid.tsuid, {_COLUMNS}, coalesce(any_value(other), '') AS other,
          coalesce(string_agg(name, ',' ORDER BY name) FILTER (value IS NOT NULL AND NOT readable), '') AS unfilled,
          coalesce(string_agg(name, ',' ORDER BY name) FILTER (value IS NULL), '') AS absent
        FROM grid LEFT JOIN o USING (tsuid) GROUP BY grid.tsuid""",
    "p4_found": f"""{_DENSE} SELECT series_id, day_no FROM w
        WHERE day_no >= a + 29 AND round(s7 / 7, 6) >= 2 * round(s30 / 30, 6) AND round(s30 / 30, 6) > 0""",
    "p4_trailing": f"""{_DENSE} SELECT series_id, day_no, {s_('s7')} AS total_7, c7 AS n_7, {s_('s7 / 7')} AS avg_day_7,
          CASE WHEN c7 > 0 THEN {s_('s7 / c7')} END AS avg_reading_7, {s_('s30')} AS total_30, c30 AS n_30,
          {s_('s30 / 30')} AS avg_day_30, CASE WHEN c30 > 0 THEN {s_('s30 / c30')} END AS avg_reading_30 FROM w""",
    "p6_found": f"""WITH {_PERIODS} SELECT series_id, unnest(range(t // period + 1, nt // period)) * period AS slot_ms
        FROM pairs WHERE nt // period > t // period + 1""",
    "p6_grid": f"""WITH {_PERIODS}, slots AS (
          SELECT series_id, period, t, v, nt, nv, unnest(range(t // period + 1, nt // period + 1)) AS k
          FROM pairs WHERE nt // period > t // period)
        SELECT series_id, k * period AS slot_ms,
          CASE WHEN nt - t <= 4 * period THEN {s_('v + (nv - v) * ((k * period - t) / (nt - t))')} END AS value,
          CASE WHEN k = nt // period THEN 'observed' WHEN nt - t <= 4 * period THEN 'filled' ELSE 'missing' END AS status
        FROM slots UNION ALL
        SELECT series_id, t // period * period, {s_('v')}, 'observed' FROM pairs WHERE pt IS NULL""",
}
