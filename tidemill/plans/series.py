"""Queries of the time-series operators over the valid readings of ``points`` (and ``events`` where a metric is needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.compare import settled, settled_cells
from tidemill.functions.compare import settled_sql as s_
from tidemill.functions.typed import number
from tidemill.operators import cut, derive, describe, learn, match, motif, relate, resample, symbolic, transform
from tidemill.operators.readings import period_of, series_metadata, valid_readings
from tidemill.plans.pipeline import VALID
from tidemill.sources.scratch import materialise
from tidemill.sources.tables import table

HOUR = 3_600_000
DAY = 86_400_000
DATASET = "study_01"
START, END = 1_546_300_800_000, 1_577_836_800_000
CRITERION = "10 < Y <= 50.5 and Y not in [20, 30]"
WINDOW, PAA, ALPHABET = 24, 6, 5


def readings(spark: SparkSession, d: str) -> DataFrame:
    return valid_readings(table(spark, d, "points"))


def periods(spark: SparkSession, d: str) -> DataFrame:
    return period_of(table(spark, d, "series"), table(spark, d, "metadata"), number)


def _shown(rows: DataFrame, value: str = "v", digits: int = 6) -> DataFrame:
    return rows.select("series_id", "t", settled(value, digits).alias("v"))


def event_readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events as one series per user and type, and what is known of the series."""
    rows = table(spark, d, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("series_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"), "user_id", "event_type",
    )
    series = rows.select(
        "series_id", F.col("series_id").alias("fid"), F.col("event_type").alias("metric"),
        F.col("user_id").cast("string").alias("context"), F.col("event_type").alias("variable"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
    ).dropDuplicates(["series_id"])
    once = rows.groupBy("series_id", "t").agg(F.max("v").alias("v"))
    return once, series


_PER = """stated AS (
      SELECT tsuid AS series_id, arg_max(value, (updated_at, value)) AS text FROM metadata
      WHERE lower(trim(name, ' ' || chr(9))) = 'qual_ref_period' GROUP BY ALL),
    spelt AS (
      SELECT series_id, CASE WHEN regexp_full_match(trim(text, ' ' || chr(9)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
                             THEN try_cast(trim(text, ' ' || chr(9)) AS DOUBLE) END AS p FROM stated),
    per AS (
      SELECT coalesce(s.series_id, r.series_id) AS series_id, coalesce(s.ref_period, CAST(floor(r.p) AS BIGINT)) AS period
      FROM series s FULL JOIN spelt r ON s.series_id = r.series_id)"""
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"WITH {VALID} SELECT series_id, t, v FROM valid WHERE t BETWEEN {START} AND {END}")
def cut_range(spark, d):
    return cut.cut_points(table(spark, d, "points"), START, END).select("series_id", "t", "v")


@query(f"""WITH {VALID} SELECT series_id, t, v FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM valid) WHERE k <= 20""")
def cut_first(spark, d):
    return cut.cut_first(readings(spark, d), 20).select("series_id", "t", "v")


@query(f"""WITH {VALID} SELECT series_id, t, v FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM valid
    SEMI JOIN (SELECT series_id FROM datasets WHERE ds_name = '{DATASET}') USING (series_id)) WHERE k <= 50""")
def cut_dataset(spark, d):
    rows = cut.cut_dataset(table(spark, d, "points"), table(spark, d, "datasets"), DATASET, nb_points="50")
    return rows.select("series_id", "t", "v")


@query(f"""WITH {VALID}, parts AS (
    SELECT *, v > 10 AND v <= 50.5 AND v NOT IN (20, 30) AS matches FROM valid)
    SELECT f.fid || '_cutY' || CASE WHEN matches THEN '' ELSE '_compl' END AS new_fid, matches, count(*) AS qual_nb_points,
      min(t) AS start_ms, max(t) AS end_ms FROM parts JOIN series f USING (series_id) GROUP BY ALL""")
def cut_y(spark, d):
    """What the cut gives as metadata of the new series."""
    named = readings(spark, d).join(table(spark, d, "series").select("series_id", "fid"), "series_id")
    rows = cut.cut_y(named, CRITERION, F.col("fid"))
    return rows.groupBy("new_fid", "matches").agg(
        F.count(F.lit(1)).alias("qual_nb_points"), F.min("t").alias("start_ms"), F.max("t").alias("end_ms")
    )


@query("""WITH e AS (
      SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, max(value) AS v FROM events GROUP BY ALL),
    r AS (SELECT *, v > 50 AS p FROM e WHERE event_type = 'click'),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, p ORDER BY t) AS island FROM r),
    runs AS (SELECT user_id, min(t) AS a, max(t) AS b FROM n WHERE p GROUP BY user_id, island)
    SELECT CAST(e.user_id AS VARCHAR) AS "group", e.user_id || '|' || event_type AS series_id, t, v,
      e.user_id || '|' || event_type || '__click__cut' AS new_fid
    FROM e JOIN runs ON e.user_id = runs.user_id AND t BETWEEN a AND b WHERE event_type <> 'click'""")
def cut_by_metric(spark, d):
    rows, series = event_readings(spark, d)
    with_click = series.where("metric = 'click'").select("context")
    grouped = series.join(with_click, "context", "left_semi")
    return cut.cut_by_metric(rows, grouped, "click", "M > 50", group_by="user")


_SQL_AGG = {"MIN": "min(v)", "MAX": "max(v)", "MED": "quantile_cont(v, 0.5)", "AVG": "avg(v)", "FIRST": "arg_min(v, t)", "LAST": "arg_max(v, t)"}


def _downsample_query(how: str, position: str) -> None:
    shift = DAY // 2 * resample.POSITIONS[position]

    def run(spark, d):
        return _shown(resample.downsample(readings(spark, d), DAY, how, position))

    run.__name__ = f"downsample_{how.lower()}_{position.lower()}"
    run.__doc__ = f"Daily {how} values, stamped {position}."
    QUERIES[run.__name__] = run
    ORACLE[run.__name__] = f"""WITH {VALID}, b AS (SELECT series_id, min(t) AS t0, count(*) AS n FROM valid GROUP BY ALL)
        SELECT series_id, CASE WHEN n = 1 THEN t0 ELSE t0 + (t - t0) // {DAY} * {DAY} + {shift} END AS t, {s_(_SQL_AGG[how])} AS v
        FROM valid JOIN b USING (series_id) GROUP BY series_id, t0, n, (t - t0) // {DAY},
          CASE WHEN n = 1 THEN t0 ELSE t0 + (t - t0) // {DAY} * {DAY} + {shift} END"""


for _how, _position in (("AVG", "BEG"), ("MED", "MID"), ("MAX", "END"), ("MIN", "BEG"), ("FIRST", "MID"), ("LAST", "END")):
    _downsample_query(_how, _position)


def _upsample_sql(p: int, value: str) -> str:
    return f"""pairs AS (
      SELECT series_id, t, v, lead(t) OVER w AS nt, lead(v) OVER w AS nv, min(t) OVER (PARTITION BY series_id) AS t0
      FROM valid WINDOW w AS (PARTITION BY series_id ORDER BY t)),
    grid AS (
      SELECT *, unnest(range(t0 + (t - t0 + {p} - 1) // {p} * {p}, coalesce(nt, t + 1), {p})) AS g FROM pairs)
    SELECT series_id, g AS t, {s_(f"CASE WHEN g = t THEN v ELSE {value} END")} AS v FROM grid"""


for _method, _value in (("LINEAR_INTERPOLATION", "v + (nv - v) * ((g - t) / (nt - t))"), ("VALUE_BEFORE", "v"), ("VALUE_AFTER", "nv")):

    def _up(spark, d, _method=_method):
        return _shown(resample.upsample(readings(spark, d), HOUR, _method))

    _up.__name__ = f"upsample_{_method.split('_')[-1].lower() if _method[0] == 'V' else 'linear'}"
    QUERIES[_up.__name__] = _up
    ORACLE[_up.__name__] = f"WITH {VALID}, {_upsample_sql(HOUR, _value)}"


def _rolling_sql(offset: int) -> str:
    return f"""WITH {VALID}, w AS (
      SELECT series_id, avg(v) OVER f AS mean, lead(t, {offset}) OVER o AS stamp, lead(t, 4) OVER o AS last, count(*) OVER (PARTITION BY series_id) AS n
      FROM valid WINDOW o AS (PARTITION BY series_id ORDER BY t), f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT series_id, stamp AS t, {s_("mean")} AS v FROM w WHERE last IS NOT NULL AND n > 5"""


for _alignment, _offset in (("left", 0), ("center", 2), ("right", 4)):

    def _roll(spark, d, _alignment=_alignment):
        return _shown(transform.rolling_mean(readings(spark, d), 5, _alignment))

    _roll.__name__ = f"rollmean_{_alignment}"
    QUERIES[_roll.__name__] = _roll
    ORACLE[_roll.__name__] = _rolling_sql(_offset)


@query(f"""WITH {VALID}, {_PER}, i AS (
      SELECT series_id, t, v, period, count(*) OVER (PARTITION BY series_id) AS n, sum(v) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c,
        CAST(ceil(21600000 / period) AS BIGINT) AS size FROM valid JOIN per USING (series_id) WHERE period > 0),
    b AS (SELECT *, lead(c, size - 1) OVER (PARTITION BY series_id ORDER BY t) AS upto FROM i)
    SELECT series_id, t, {s_("(upto - c + v) / size", 4)} AS v FROM b WHERE upto IS NOT NULL AND (n > size OR size = 1)""")
def rollmean_period(spark, d):
    """Means over six hours."""
    rows = transform.rolling_mean_period(readings(spark, d), materialise(periods(spark, d), "periods"), 6 * HOUR)
    return _shown(rows, digits=4)


@query(f"""WITH {VALID}, p AS (SELECT series_id, t, v, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM valid WINDOW w AS (PARTITION BY series_id ORDER BY t))
    SELECT series_id, t, {s_("(nv - v) / (nt - t)", 9)} AS v FROM p WHERE nt IS NOT NULL""")
def slope(spark, d):
    return _shown(transform.slope(readings(spark, d)), digits=9)


@query(f"""WITH {VALID}, s AS (SELECT series_id, t, v, v - lag(v) OVER (PARTITION BY series_id ORDER BY t) AS d FROM valid),
    c AS (SELECT series_id, t, v, CASE WHEN d IS NULL OR abs(d) < 180 THEN 0
            WHEN d > 0 AND d - floor((d + 180) / 360) * 360 = -180 THEN 1 - floor((d + 180) / 360) ELSE -floor((d + 180) / 360) END AS k FROM s)
    SELECT series_id, t, {s_("v + 360 * sum(k) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)")} AS v FROM c""")
def unwrap(spark, d):
    """The values taken as degrees."""
    return _shown(transform.unwrap(readings(spark, d), "Degrees"))


@query(f"""WITH {VALID}, m AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s FROM valid GROUP BY ALL)
    SELECT series_id, t, {s_("(v - m) / CASE WHEN s = 0 THEN 1 ELSE s END")} AS v FROM valid JOIN m USING (series_id)""")
def scale(spark, d):
    return _shown(transform.scale(readings(spark, d)))


_DISCRETE = f"""WITH {VALID}, b AS (
      SELECT series_id, min(t) AS sd, greatest(CAST(ceil((max(t) - min(t)) / 8) AS BIGINT), 1) AS size FROM valid GROUP BY ALL),
    c AS (SELECT series_id, greatest(CAST(ceil((t - sd) / size) AS INT) - 1, 0) AS bucket, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS dev
          FROM valid JOIN b USING (series_id) GROUP BY ALL),
    e AS (SELECT series_id, sd, size, CAST(unnest(range(8)) AS INT) AS bucket FROM b)"""


@query(f"""{_DISCRETE} SELECT series_id, bucket, sd + bucket * size AS start_ms, lo AS MIN, hi AS MAX, {s_("mean")} AS AVG, {s_("dev")} AS STD
    FROM e LEFT JOIN c USING (series_id, bucket)""")
def discretize(spark, d):
    rows = describe.discretize(readings(spark, d), 8)
    return rows.withColumns({"AVG": settled("AVG"), "STD": settled("STD")})


@query(f"""{_DISCRETE} SELECT series_id, {", ".join(f'max(lo) FILTER (bucket = {b}) AS "MIN_B{b + 1}", max(hi) FILTER (bucket = {b}) AS "MAX_B{b + 1}"' for b in range(8))}
    FROM c GROUP BY series_id""")
def discretize_table(spark, d):
    operators = ("MIN", "MAX")
    return describe.discretized_table(describe.discretize(readings(spark, d), 8, operators), 8, operators)


@query(f"""WITH {VALID} SELECT series_id, min(v) AS qual_min_value, max(v) AS qual_max_value, count(*) AS qual_nb_points,
    {s_("avg(v)")} AS qual_average, {s_("CASE WHEN min(v) = max(v) THEN 0 ELSE var_pop(v) END", 3)} AS qual_variance FROM valid GROUP BY ALL""")
def quality_values(spark, d):
    rows = describe.quality_values(readings(spark, d))
    return rows.withColumns({"qual_average": settled("qual_average"), "qual_variance": settled("qual_variance", 3)})


_GAPS = f"""{VALID}, g AS (SELECT series_id, lead(t) OVER (PARTITION BY series_id ORDER BY t) - t AS gap FROM valid),
    h AS (SELECT series_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, gap) AS k, sum(n) OVER (PARTITION BY series_id) AS total FROM h),
    gaps AS (
      SELECT series_id, max(gap) FILTER (k = 1) AS qual_ref_period, min(gap) AS qual_min_period, max(gap) AS qual_max_period,
        {s_("sum(gap * n) / sum(n)")} AS qual_average_period,
        '{{' || string_agg('"' || gap || '":' || n, ',' ORDER BY k) FILTER (k <= 20) || '}}' AS qual_hist_period,
        '{{' || string_agg('"' || gap || '":' || round(n * 100.0::DOUBLE / total, 3), ',' ORDER BY k) FILTER (k <= 20) || '}}' AS qual_hist_period_percent
      FROM r GROUP BY series_id)"""


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def quality_time(spark, d):
    return describe.quality_time(readings(spark, d)).withColumn("qual_average_period", settled("qual_average_period"))


@query(f"""WITH {VALID} SELECT series_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS nb_points FROM valid GROUP BY ALL""")
def metadata_of_series(spark, d):
    return series_metadata(readings(spark, d))


_SEGMENTS = f"""b AS (SELECT series_id, min(t) AS t0, (max(t) - min(t)) / 8 AS w FROM valid GROUP BY ALL),
    seg AS (SELECT series_id, least(greatest(coalesce(CASE WHEN w > 0 THEN CAST(ceil((t - t0) / w) AS INT) END - 1, 0), 0), 7) AS segment, avg(v) AS mean
            FROM valid JOIN b USING (series_id) GROUP BY ALL)"""


@query(f"WITH {VALID}, {_SEGMENTS} SELECT series_id, segment, {s_('mean')} AS mean FROM seg")
def paa(spark, d):
    return symbolic.segments(readings(spark, d), 8).select("series_id", "segment", settled("mean").alias("mean"))


@query(f"""WITH {VALID}, {_SEGMENTS}, r AS (SELECT series_id, segment, round(mean, 9) AS x FROM seg),
    q AS (SELECT series_id, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS b FROM r GROUP BY ALL)
    SELECT series_id, string_agg(chr(CAST(97 + len(list_filter(b, lambda y: x > round(y, 9))) AS INT)), '' ORDER BY segment) AS word,
      string_agg(printf('%.3f', {s_("x", 3)}), ' ' ORDER BY segment) AS averages,
      any_value(array_to_string(list_transform(b, lambda y: printf('%.3f', {s_("y", 3)})), ' ')) AS breaks
    FROM r JOIN q USING (series_id) GROUP BY series_id""")
def sax(spark, d):
    shown = lambda name: F.array_join(F.transform(name, lambda x: F.format_string("%.3f", settled(x, 3))), " ")
    return symbolic.sax(readings(spark, d), 8, ALPHABET).select("series_id", "word", shown("paa").alias("averages"), shown("breakpoints").alias("breaks"))


@query(f"""WITH RECURSIVE {VALID}, i AS (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM valid),
    b AS (SELECT series_id, min(t) AS t0, max(t) AS t1 FROM valid GROUP BY ALL),
    f AS (SELECT series_id, k, t0, t1, count(*) FILTER (t <= round_even(t0 + (t1 - t0) / 8 * (k + 1), 0)) AS c
          FROM i JOIN b USING (series_id) CROSS JOIN (SELECT unnest(range(8)) AS k) GROUP BY ALL),
    o AS (SELECT series_id, k, t0, t1, c AS opens FROM f WHERE k = 0
          UNION ALL SELECT f.series_id, f.k, f.t0, f.t1, greatest(f.c, o.opens + 1) FROM o JOIN f ON f.series_id = o.series_id AND f.k = o.k + 1),
    p AS (SELECT i.series_id, idx, v, t0, t1, CAST(count(*) FILTER (opens <= idx) AS INT) AS segment FROM i JOIN o USING (series_id) GROUP BY ALL),
    m AS (SELECT series_id, segment, t0, t1, avg(v) AS mean FROM p GROUP BY ALL),
    z AS (SELECT *, max(segment) OVER (PARTITION BY series_id) AS last FROM m)
    SELECT series_id, segment, {s_("mean")} AS mean FROM z WHERE segment < last OR round_even(t0 + (t1 - t0) / 8 * (segment + 1), 0) >= t1""")
def paa_sequential(spark, d):
    rows = symbolic.paa_sequential(readings(spark, d), 8)
    return rows.withColumn("mean", settled("mean"))


def _windows(spark, d, trivial: float = 0.0, linear: tuple[float, float] | None = None) -> DataFrame:
    return symbolic.sliding_windows(readings(spark, d), WINDOW, 0.5, False, False, True, linear, trivial)


_CUT = f"""i AS (
      SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM valid),
    m AS (SELECT series_id, t, v, unnest(range(greatest((idx - {WINDOW} + {WINDOW // 2}) // {WINDOW // 2}, 0), least(idx // {WINDOW // 2}, (n - {WINDOW}) // {WINDOW // 2}) + 1)) AS rank
          FROM i WHERE n >= {WINDOW}),
    w AS (SELECT series_id, rank, min(t) AS start_ms, max(t) AS end_ms, avg(v) AS local_mean, stddev_pop(v) AS local_std FROM m GROUP BY ALL)"""
_WINDOWED = f"{VALID}, {_CUT}"
_WHOLE = f"""{VALID}, g AS (SELECT series_id, avg(v) AS mean, CASE WHEN stddev_pop(v) IN (0, 1) THEN 1 ELSE stddev_pop(v) END AS scale FROM valid GROUP BY ALL),
    whole AS (SELECT series_id, t, (v - mean) / scale AS v FROM valid JOIN g USING (series_id)), {_CUT.replace("FROM valid", "FROM whole")}"""


_SCALED = "(v - local_mean) / CASE WHEN local_std = 0 THEN 1 ELSE local_std END"


@query(f"""WITH {_WINDOWED} SELECT series_id, rank, start_ms, end_ms, {s_("local_mean")} AS local_mean, {s_("local_std", 4)} AS local_std,
      {s_(f"min({_SCALED})", 5)} AS lowest, {s_(f"max({_SCALED})", 5)} AS highest, {s_(f"sum({_SCALED} * (t - start_ms) / 1e9)", 3)} AS along
    FROM m JOIN w USING (series_id, rank) GROUP BY ALL""")
def sliding_windows(spark, d):
    """The windows, with figures of their values and times."""
    ahead = F.transform("times", lambda t: (t - F.col("start_ms")) / 1e9)
    along = F.aggregate(F.zip_with("values", ahead, lambda x, t: x * t), F.lit(0.0), lambda s, x: s + x)
    return _windows(spark, d).select(
        "series_id", "rank", "start_ms", F.element_at("times", -1).alias("end_ms"), settled("local_mean").alias("local_mean"), settled("local_std", 4).alias("local_std"),
        settled(F.array_min("values"), 5).alias("lowest"), settled(F.array_max("values"), 5).alias("highest"), settled(along, 3).alias("along"),
    )


@query(f"""WITH {_WINDOWED}, l AS (
      SELECT series_id, rank, any_value(start_ms) AS start_ms, any_value(local_std) AS dev, covar_pop(v, t - start_ms) AS c, var_pop(t - start_ms) AS vt
      FROM m JOIN w USING (series_id, rank) GROUP BY series_id, rank)
    SELECT series_id, rank, start_ms FROM l WHERE dev > 0.005 AND coalesce(c * c / nullif(dev * dev * vt, 0), 0) < 0.95""")
def sliding_windows_linear(spark, d):
    """Without near-linear windows."""
    return _windows(spark, d, linear=(0.005, 0.95)).select("series_id", "rank", "start_ms")


def _kept_sql(radius: float, windowed: str = _WINDOWED, source: str = "valid") -> str:
    """The windows that are neither near-linear nor too like the one kept before: a walk along each series."""
    return f"""{windowed}, l AS (
      SELECT series_id, rank, any_value(start_ms) AS start_ms, any_value(local_std) AS dev, covar_pop(v, t - start_ms) AS c, var_pop(t - start_ms) AS vt, list(v ORDER BY t) AS x
      FROM m JOIN w USING (series_id, rank) GROUP BY series_id, rank),
    s AS (SELECT series_id, stddev_pop(v) AS sd FROM {source} GROUP BY ALL),
    o AS (SELECT series_id, rank, start_ms, x, greatest({radius}, 0.1 * sqrt({WINDOW}) * sd) AS least, row_number() OVER (PARTITION BY series_id ORDER BY rank) AS k
          FROM l JOIN s USING (series_id) WHERE dev > 0.005 AND coalesce(c * c / nullif(dev * dev * vt, 0), 0) < 0.95),
    walk AS (SELECT series_id, k, rank, start_ms, x AS kept, true AS chosen FROM o WHERE k = 1
      UNION ALL SELECT o.series_id, o.k, o.rank, o.start_ms, CASE WHEN list_distance(o.x, kept) >= least THEN o.x ELSE kept END, list_distance(o.x, kept) >= least
                FROM walk JOIN o ON o.series_id = walk.series_id AND o.k = walk.k + 1),
    z AS (SELECT *, max(k) OVER (PARTITION BY series_id) AS last FROM walk),
    kept AS (SELECT series_id, rank, start_ms FROM z WHERE chosen OR k = last)"""


@query(f"WITH RECURSIVE {_kept_sql(0.75)} SELECT * FROM kept")
def sliding_windows_filtered(spark, d):
    """Without near-linear windows and those too like the one before."""
    rows = _windows(spark, d, trivial=0.75, linear=(0.005, 0.95))
    return rows.select("series_id", "rank", "start_ms")


_PARTS = f"""{_WINDOWED}, p AS (
      SELECT m.series_id, m.rank, least(greatest(CAST(ceil((t - start_ms) / ((end_ms - start_ms) / {PAA})) AS INT) - 1, 0), {PAA - 1}) AS part,
        round(avg({_SCALED}), 9) AS x
      FROM m JOIN w USING (series_id, rank) GROUP BY ALL),
    f AS (SELECT series_id, rank, part, last_value(x IGNORE NULLS) OVER (PARTITION BY series_id, rank ORDER BY part) AS x
          FROM (SELECT series_id, rank, unnest(range({PAA})) AS part FROM w) LEFT JOIN p USING (series_id, rank, part))"""


@query(f"""WITH {_PARTS}, q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS b FROM f)
    SELECT series_id, rank, string_agg(chr(CAST(97 + len(list_filter(b, lambda y: x >= round(y, 9))) AS INT)), '' ORDER BY part) AS word FROM f, q GROUP BY series_id, rank""")
def window_words(spark, d):
    words, _ = symbolic.words_of_windows(_windows(spark, d), PAA, ALPHABET)
    return words.select("series_id", "rank", "word")


@query(f"""WITH {VALID}, {_SEGMENTS}, r AS (SELECT series_id, segment, round(mean, 9) AS x FROM seg),
    q AS (SELECT series_id, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS b FROM r GROUP BY ALL),
    s AS (SELECT series_id, string_agg(chr(CAST(97 + len(list_filter(b, lambda y: x > round(y, 9))) AS INT)), '' ORDER BY segment) AS word FROM r JOIN q USING (series_id) GROUP BY ALL),
    c AS (SELECT word, count(*) AS size FROM s WHERE len(word) = 8 GROUP BY ALL),
    e AS (SELECT a.word AS word_a, b.word AS word_b, a.size AS size_a, b.size AS size_b,
            {" + ".join(f"CAST(a.word[{k}] = b.word[{k}] AS BIGINT)" for k in range(1, 9))} AS same FROM c a JOIN c b ON a.word < b.word)
    SELECT word_a, word_b, CAST(same * (same - 1) // 2 AS BIGINT) AS n, size_a, size_b FROM e WHERE same >= 2""")
def collisions(spark, d):
    """Of the series' words, in how many pairs of places two different ones agree."""
    words = symbolic.sax(readings(spark, d), 8, ALPHABET).where(F.length("word") == 8)
    return motif.collisions(words, 2, word_size=8)


_FILLED = f"""{_SEGMENTS}, r AS (
      SELECT series_id, segment, last_value(round(mean, 9) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY segment) AS x
      FROM (SELECT series_id, unnest(range(8)) AS segment FROM b) LEFT JOIN seg USING (series_id, segment))"""


@query(f"""WITH {VALID}, {_FILLED},
    q AS (SELECT series_id, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS b FROM r GROUP BY ALL),
    s AS (SELECT series_id, string_agg(chr(CAST(97 + len(list_filter(b, lambda y: x > round(y, 9))) AS INT)), '' ORDER BY segment) AS word FROM r JOIN q USING (series_id) GROUP BY ALL),
    c AS (SELECT word, count(*) AS size FROM s GROUP BY ALL),
    e AS (SELECT a.word AS word_a, b.word AS word_b, a.size AS size_a, b.size AS size_b,
            {" + ".join(f"CAST(a.word[{k}] = b.word[{k}] AS BIGINT)" for k in range(1, 9))} AS same FROM c a JOIN c b ON a.word < b.word)
    SELECT word_a, word_b, CAST(same * (same - 1) // 2 AS BIGINT) AS n, size_a, size_b FROM e WHERE same >= 2""")
def collisions_all(spark, d):
    """With the words of series that have a silent part, which ``collisions`` leaves out."""
    return motif.collisions(symbolic.sax(readings(spark, d), 8, ALPHABET, fill=True), 2, word_size=8)


def _motifs(spark, d, **how) -> DataFrame:
    return motif.motifs(readings(spark, d), motif.MotifSettings(WINDOW, 0.5, PAA, ALPHABET, collision_places=2, radius=1.0, **how))


def _listed(found: DataFrame) -> DataFrame:
    return found.groupBy("pattern_id", "regex", "words", "length").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("location.series_id").alias("series"), F.min("location.t").alias("first_t"), settled(F.avg("location.dev"), 4).alias("dev")
    )


def _words_sql(kept: str, dev: str) -> str:
    """The words of several windows."""
    return f"""WITH RECURSIVE {kept}, p AS (
      SELECT series_id, rank, least(greatest(CAST(ceil((t - w.start_ms) / ((end_ms - w.start_ms) / {PAA})) AS INT) - 1, 0), {PAA - 1}) AS part, round(avg({_SCALED}), 9) AS x
      FROM m JOIN w USING (series_id, rank) SEMI JOIN kept USING (series_id, rank) GROUP BY ALL),
    f AS (SELECT series_id, rank, part, last_value(x IGNORE NULLS) OVER (PARTITION BY series_id, rank ORDER BY part) AS x
          FROM (SELECT series_id, rank, unnest(range({PAA})) AS part FROM kept) LEFT JOIN p USING (series_id, rank, part)),
    q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS b FROM f),
    named AS (SELECT series_id, rank, string_agg(chr(CAST(97 + len(list_filter(b, lambda y: x >= round(y, 9))) AS INT)), '' ORDER BY part) AS word FROM f, q GROUP BY series_id, rank)
    SELECT md5(word) AS pattern_id, word AS regex, CAST(1 AS INT) AS words, CAST({WINDOW} AS INT) AS length, count(*) AS windows, count(DISTINCT series_id) AS series,
      min(start_ms) AS first_t, {dev} AS dev
    FROM named JOIN w USING (series_id, rank) {"JOIN g USING (series_id)" if "scale" in dev else ""} GROUP BY word HAVING count(*) > 1"""


@query(_words_sql(_kept_sql(0.5), s_("avg(local_std)", 4)))
def motifs(spark, d):
    """The recurring patterns and where they are, in figures. So many windows make words of six letters agree by chance that
    only equal ones are seeds: the patterns are the words of several windows, which SQL can say."""
    return _listed(_motifs(spark, d))


@query(_words_sql(_kept_sql(0.5), s_("avg(local_std)", 4)))
def motifs_iterative(spark, d):
    """Groups around the pairs of words that collide most, the greatest counts first, under a third of the masks. These cover all
    places of a word, so that here too only equal words collide in all of them."""
    return _listed(_motifs(spark, d, iterative=True, iterations=3, collision_share=0.34))


@query(_words_sql(_kept_sql(0.5, _WHOLE, "whole"), s_("avg(local_std * scale)", 4)))
def motifs_brute_force(spark, d):
    """Groups of all words near a seed, whether they collide or not, of series scaled as a whole."""
    return _listed(_motifs(spark, d, by_collisions=False, global_norm=True, collision_share=0.34))


def _pattern(spark, d) -> list[float]:
    """The values of the first pattern that is whole."""
    rows = table(spark, d, "patterns").where(
        (F.size("np_pattern_values") == 64) & ~F.exists("np_pattern_values", lambda x: x.isNull() | F.isnan(x)) & (F.array_min("np_pattern_values") < F.array_max("np_pattern_values"))
    )
    return list(rows.orderBy("pattern_id").select("np_pattern_values").first()[0])


@query(f"""WITH {VALID}, i AS (
      SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM valid),
    w AS (SELECT series_id, t, v, idx // 64 AS rank, idx % 64 AS k FROM i WHERE n >= 320 AND idx // 64 <= (n - 64) // 64),
    z AS (SELECT series_id, rank, t, k, (v - avg(v) OVER f) / CASE WHEN stddev_pop(v) OVER f = 0 THEN 1 ELSE stddev_pop(v) OVER f END AS z
          FROM w WINDOW f AS (PARTITION BY series_id, rank)),
    p AS (SELECT unnest(np_pattern_values) AS x, unnest(range(64)) AS k FROM (
            SELECT np_pattern_values FROM patterns WHERE len(np_pattern_values) = 64 AND len(list_filter(np_pattern_values, lambda y: y IS NOT NULL AND NOT isnan(y))) = 64
              AND list_min(np_pattern_values) < list_max(np_pattern_values) ORDER BY pattern_id LIMIT 1)),
    pz AS (SELECT k, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM p)
    SELECT series_id, rank, min(t) AS start_t, max(t) AS end_t, {s_("sum(abs(z - x))", 4)} AS score FROM z JOIN pz USING (k) GROUP BY ALL""")
def match_manhattan(spark, d):
    rows = match.find_pattern(readings(spark, d), _pattern(spark, d))
    return rows.withColumn("score", settled("score", 4))


@query(f"""WITH {VALID}, i AS (
      SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM valid),
    w AS (SELECT series_id, t, v, unnest(range(greatest(idx - 63, 0), least(idx, n - 64) + 1)) AS rank, idx FROM i WHERE n >= 320),
    z AS (SELECT series_id, rank, t, idx - rank AS k, (v - avg(v) OVER f) / CASE WHEN stddev_pop(v) OVER f = 0 THEN 1 ELSE stddev_pop(v) OVER f END AS z
          FROM w WINDOW f AS (PARTITION BY series_id, rank)),
    p AS (SELECT unnest(np_pattern_values) AS x, unnest(range(64)) AS k FROM (
            SELECT np_pattern_values FROM patterns WHERE len(np_pattern_values) = 64 AND len(list_filter(np_pattern_values, lambda y: y IS NOT NULL AND NOT isnan(y))) = 64
              AND list_min(np_pattern_values) < list_max(np_pattern_values) ORDER BY pattern_id LIMIT 1)),
    pz AS (SELECT k, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM p)
    SELECT series_id, rank, min(t) AS start_t, max(t) AS end_t, {s_("sum(abs(z - x))", 4)} AS score FROM z JOIN pz USING (k) GROUP BY ALL""")
def match_manhattan_dense(spark, d):
    """Windows that start at every reading; ``match_manhattan`` has those of the grid of 64 alone."""
    rows = match.find_pattern(readings(spark, d), _pattern(spark, d), rate_sliding=1 / 64)
    return rows.withColumn("score", settled("score", 4))


@query()
def match_dtw(spark, d):
    """Of windows that start at every reading."""
    rows = match.find_pattern(readings(spark, d), _pattern(spark, d), "DTW", 1 / 64, limit=3)
    return rows.withColumn("score", settled("score", 4))


@query()
def match_fastdtw(spark, d):
    """Of windows that start at every reading."""
    rows = match.find_pattern(readings(spark, d), _pattern(spark, d), "FAST_DTW", 1 / 64, limit=3)
    return rows.withColumn("score", settled("score", 4))


_ALIGNED = f"""{VALID}, c AS (SELECT series_id, count(*) AS n FROM valid GROUP BY ALL),
    i AS (SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY t) AS idx FROM valid),
    e AS (SELECT * FROM i WHERE idx <= (SELECT min(n) FROM c))"""


@query(f"""WITH {_ALIGNED} SELECT a.series_id AS id_a, b.series_id AS id_b, {s_("corr(a.v, b.v)")} AS correlation
    FROM e a JOIN e b ON a.idx = b.idx AND a.series_id < b.series_id GROUP BY ALL""")
def pearson_matrix(spark, d):
    return relate.correlation_matrix(readings(spark, d)).withColumn("correlation", settled_cells("correlation"))


@query(f"""WITH {_ALIGNED}, r AS (
      SELECT series_id, idx, rank() OVER (PARTITION BY series_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, v) - 1) / 2 AS v FROM e)
    SELECT a.series_id AS id_a, b.series_id AS id_b, {s_("corr(a.v, b.v)")} AS correlation
    FROM r a JOIN r b ON a.idx = b.idx AND a.series_id < b.series_id GROUP BY ALL""")
def spearman_matrix(spark, d):
    return relate.correlation_matrix(readings(spark, d), "Spearman").withColumn("correlation", settled("correlation"))


@query(f"""WITH {_ALIGNED}, m AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM e GROUP BY ALL HAVING min(v) < max(v)),
    z AS (SELECT series_id, idx, n, (v - m) / s AS z FROM e JOIN m USING (series_id)),
    l AS (SELECT a.series_id AS id_a, b.series_id AS id_b, a.idx - b.idx AS lag, sum(a.z * b.z) / any_value(a.n) AS c
          FROM z a JOIN z b ON a.series_id < b.series_id AND abs(a.idx - b.idx) <= 5 GROUP BY ALL)
    SELECT id_a, id_b, {s_("CASE WHEN abs(min(c)) > max(c) + 1e-12 THEN min(c) ELSE max(c) END")} AS correlation FROM l GROUP BY ALL""")
def cross_correlation(spark, d):
    rows = relate.cross_correlation(readings(spark, d), lag_max=5)
    return rows.where(~F.isnan("correlation")).withColumn("correlation", settled("correlation"))


@query(f"""WITH {_ALIGNED}, m AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n, min(v) = max(v) AS flat FROM e GROUP BY ALL),
    z AS (SELECT series_id, idx, n, CASE WHEN flat THEN 'nan'::DOUBLE ELSE (v - m) / s END AS z FROM e JOIN m USING (series_id)),
    l AS (SELECT a.series_id AS id_a, b.series_id AS id_b, a.idx - b.idx AS lag, sum(a.z * b.z) / any_value(a.n) AS c
          FROM z a JOIN z b ON a.series_id < b.series_id GROUP BY ALL)
    SELECT id_a, id_b, {s_("CASE WHEN isnan(max(c)) THEN 'nan'::DOUBLE WHEN abs(min(c)) > max(c) + 1e-12 THEN min(c) ELSE max(c) END")} AS correlation FROM l GROUP BY ALL""")
def cross_correlation_all(spark, d):
    """At all lags and with the cells of constant series, which are NaN; ``cross_correlation`` looks at lags up to 5 alone."""
    return relate.cross_correlation(readings(spark, d)).withColumn("correlation", settled("correlation"))


@query(f"""WITH {VALID}, i AS (SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY t) AS idx FROM valid)
    SELECT a.series_id AS id_a, b.series_id AS id_b, {s_("sqrt(sum((a.v - b.v) * (a.v - b.v)))", 4)} AS distance
    FROM i a JOIN i b ON a.idx = b.idx AND a.series_id < b.series_id GROUP BY ALL""")
def euclidean_distances(spark, d):
    return relate.euclidean_distances(readings(spark, d)).withColumn("distance", settled_cells("distance", 4))


_CONTEXT = """WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, max(value) AS v FROM events GROUP BY ALL),
    i AS (SELECT user_id, event_type, v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS idx FROM e),
    k AS (SELECT user_id FROM e GROUP BY ALL HAVING count(DISTINCT event_type) > 1),
    r AS (SELECT a.user_id, a.event_type AS var_a, b.event_type AS var_b,
            CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS c
          FROM i a JOIN i b ON a.user_id = b.user_id AND a.idx = b.idx AND a.event_type <= b.event_type
          WHERE a.user_id IN (SELECT user_id FROM k) GROUP BY ALL)"""


@query(f"""{_CONTEXT} SELECT var_a, var_b, {s_("coalesce(avg(c), 'nan'::DOUBLE)")} AS mean_correlation,
    {s_("coalesce(var_pop(c), 'nan'::DOUBLE)")} AS variance, count(c) AS contexts FROM r GROUP BY ALL""")
def correlation_by_context(spark, d):
    rows, series = event_readings(spark, d)
    _, summary = relate.correlation_by_context(rows, series)
    return summary.withColumns({c: settled(c) for c in ("mean_correlation", "variance")})


@query(f"""{_CONTEXT} SELECT CAST(user_id AS VARCHAR) AS context, var_a, var_b, {s_("coalesce(c, 'nan'::DOUBLE)", 4)} AS correlation FROM r""")
def correlation_each_context(spark, d):
    rows, series = event_readings(spark, d)
    each, _ = relate.correlation_by_context(rows, series)
    return each.select("context", "var_a", "var_b", settled("correlation", 4).alias("correlation"))


@query(f"""{_CONTEXT} SELECT var_a, var_b, CAST(row_number() OVER (PARTITION BY var_a, var_b ORDER BY user_id) - 1 AS INT) AS place, CAST(user_id AS VARCHAR) AS context,
      round(c, 4) AS correlation, user_id || '|' || var_a AS id_a, user_id || '|' || var_b AS id_b FROM r""")
def correlation_profiles(spark, d):
    """The documents of all pairs of variables, read again: a row per context, in natural order."""
    rows, series = event_readings(spark, d)
    documents = relate.correlation_documents(relate.correlation_by_context(rows, series)[0])
    kind = "struct<variables:array<string>,x_value:struct<data:array<string>>,y_values:array<struct<data:array<double>>>,ts_lists:array<array<string>>>"
    read = documents.select("var_a", "var_b", F.from_json("document", kind).alias("j"))
    each = read.select("var_a", "var_b", F.posexplode(F.arrays_zip(F.col("j.x_value.data").alias("x"), F.col("j.y_values")[0]["data"].alias("y"), F.col("j.ts_lists").alias("ids"))).alias("place", "e"))
    return each.select("var_a", "var_b", "place", F.col("e.x").alias("context"), F.col("e.y").alias("correlation"), F.col("e.ids")[0].alias("id_a"), F.col("e.ids")[1].alias("id_b"))


@query(f"""{_CONTEXT}, s AS (SELECT var_a, var_b, avg(c) AS mean, var_pop(c) AS variance FROM r GROUP BY ALL),
    n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT var_a AS v FROM s UNION SELECT var_b FROM s)),
    m AS (SELECT 'Mean Correlation' AS matrix, var_a, var_b, coalesce(mean, CASE WHEN var_a = var_b THEN 1.0 END) AS x FROM s
          UNION ALL SELECT 'Variance', var_a, var_b, coalesce(variance, CASE WHEN var_a = var_b THEN 0.0 END) FROM s)
    SELECT matrix, a.v AS "row", b.v AS "column", CAST((SELECT count(DISTINCT user_id) FROM r) AS BIGINT) AS contexts, {s_("x")} AS x
    FROM n a JOIN n b ON a.k <= b.k CROSS JOIN (SELECT DISTINCT matrix FROM m) k LEFT JOIN m USING (matrix) WHERE m.var_a = a.v AND m.var_b = b.v""")
def correlation_dataset(spark, d):
    """The result of the correlation loop, read again: a row per cell of its triangular matrices."""
    rows, series = event_readings(spark, d)
    each, summary = relate.correlation_by_context(rows, series)
    document = relate.correlation_dataset(materialise(each, "each"), materialise(summary, "summary"), "user")
    kind = "struct<variables:array<string>,context:struct<number_of_contexts:long>,matrices:array<struct<desc:struct<label:string>,data:array<array<string>>>>>"
    read = document.select(F.from_json("document", kind).alias("j"))
    each = read.select("j.variables", "j.context.number_of_contexts", F.explode("j.matrices").alias("m")).where("m.desc.label IS NOT NULL")
    lines = each.select("variables", "number_of_contexts", "m.desc.label", F.posexplode("m.data").alias("i", "line"))
    cells = lines.select("variables", "number_of_contexts", "label", "i", F.posexplode("line").alias("j", "x"))
    name = lambda k: F.element_at("variables", k + 1)
    return cells.select(
        F.col("label").alias("matrix"), name(F.col("i")).alias("row"), name(F.col("i") + F.col("j")).alias("column"), F.col("number_of_contexts").alias("contexts"),
        settled(F.col("x").cast("double")).alias("x"),
    )


def _paa_vectors(spark, d) -> DataFrame:
    return symbolic.paa(transform.scale(readings(spark, d)), 8, fill=True)


@query()
def kmeans_paa(spark, d):
    members, _ = learn.kmeans(materialise(_paa_vectors(spark, d), "vectors"), "series_id", "paa", 4, seed=1)
    return members.select("series_id", "cluster")


@query()
def kmeans_patterns(spark, d):
    vectors = materialise(learn.pattern_vectors(_motifs(spark, d)), "vectors")
    members, _ = learn.kmeans(vectors, "pattern_id", "paa", 3, seed=1)
    return members.select("pattern_id", "cluster")


@query()
def kmeans_projection(spark, d):
    vectors = materialise(_paa_vectors(spark, d), "vectors")
    members, centres = learn.kmeans(vectors, "series_id", "paa", 3, seed=1)
    return learn.project(members, centres, "series_id").withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


def _population(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("ship_day"), "l_returnflag",
    )


@query()
def tree_confusion(spark, d):
    rows = _population(spark, d)
    model = learn.tree_fit(rows, "l_returnflag", "id", 5)
    return learn.confusion(learn.tree_predict(model, rows, "l_returnflag", "id"))


@query()
def tree_grid(spark, d):
    rows, _ = learn.tree_grid(_population(spark, d), "l_returnflag", "id", "2;4", "True;False")
    return rows.withColumns({c: F.round(c, 4) for c in ("mean_score", "std_score")})


@query(f"""WITH {VALID}, {_PER}, known AS (SELECT * FROM per WHERE period > 0),
    r AS (SELECT v.*, period FROM valid v JOIN known USING (series_id)),
    b AS (SELECT series_id, min(t) AS t0, count(*) AS n FROM r GROUP BY ALL),
    down AS (SELECT series_id, CASE WHEN n = 1 THEN t0 ELSE t0 + (t - t0) // {HOUR} * {HOUR} END AS t, avg(v) AS v
             FROM r JOIN b USING (series_id) WHERE period < {HOUR}
             GROUP BY series_id, CASE WHEN n = 1 THEN t0 ELSE t0 + (t - t0) // {HOUR} * {HOUR} END),
    pairs AS (SELECT series_id, t, v, lead(t) OVER w AS nt, lead(v) OVER w AS nv, min(t) OVER (PARTITION BY series_id) AS t0
              FROM r WHERE period >= {HOUR} WINDOW w AS (PARTITION BY series_id ORDER BY t)),
    up AS (SELECT *, unnest(range(t0 + (t - t0 + {HOUR} - 1) // {HOUR} * {HOUR}, coalesce(nt, t + 1), {HOUR})) AS g FROM pairs)
    SELECT series_id, t, {s_("v")} AS v FROM down
    UNION ALL SELECT series_id, g, {s_("CASE WHEN g = t THEN v ELSE v + (nv - v) * ((g - t) / (nt - t)) END")} FROM up""")
def resample_mixed(spark, d):
    """To one hour: up for series of an hour or more, down for the others; of the series whose period is known."""
    known = materialise(periods(spark, d), "periods")
    rows = readings(spark, d).join(known.select("series_id"), "series_id", "left_semi")
    return _shown(resample.resample(rows, known, HOUR))


@query(f"""WITH {VALID}, g AS (SELECT series_id, lead(t) OVER (PARTITION BY series_id ORDER BY t) - t AS gap FROM valid)
    SELECT series_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL""")
def gap_histogram(spark, d):
    return describe.gap_histogram(readings(spark, d))


@query(f"""WITH {VALID}, {_SEGMENTS} SELECT series_id, t, {s_("mean")} AS v
    FROM valid JOIN b USING (series_id) JOIN seg USING (series_id)
    WHERE segment = least(greatest(coalesce(CASE WHEN w > 0 THEN CAST(ceil((t - t0) / w) AS INT) END - 1, 0), 0), 7)""")
def paa_series(spark, d):
    return _shown(symbolic.paa_series(readings(spark, d), 8))


@query(f"""WITH {_PARTS} SELECT series_id, rank, CAST(part AS INT) AS part, {s_("x", 5)} AS x FROM f""")
def window_averages(spark, d):
    """Averages of the parts of each window; a part without readings repeats the one before."""
    rows = symbolic.window_averages(_windows(spark, d), PAA)
    return rows.select("series_id", "rank", F.posexplode("paa").alias("part", "x")).withColumn("x", settled("x", 5))


@query(f"""WITH {VALID}, {_SEGMENTS}, full_ AS (SELECT series_id FROM seg GROUP BY ALL HAVING count(*) = 8), c AS (SELECT count(*) AS n FROM full_),
    k AS (SELECT unnest(range(0, 1)) AS i),
    p AS (SELECT sum((1 - i / 8) ** 2 * [1, 8, 28][CAST(i AS INT) + 1] * 0.8 ** i * 0.2 ** (8 - i)) AS p FROM k)
    SELECT CAST(n AS BIGINT) AS sequences, {s_("CASE WHEN p * n * (n - 1) / 2 >= 1 THEN 27.0 ELSE p * n * (n - 1) / 2 * 28 END")} AS threshold FROM c, p""")
def collision_threshold(spark, d):
    """How many of 28 masks two of the series' words may share by chance."""
    words = symbolic.sax(readings(spark, d), 8, ALPHABET).where(F.length("word") == 8)
    n = words.count()
    value = motif.expected_collisions(n, ALPHABET, 8, 0, 2, 28)
    return spark.createDataFrame([(n, float(value))], "sequences long, threshold double").withColumn("threshold", settled("threshold"))


@query(f"""WITH {VALID}, c AS (SELECT count(DISTINCT series_id) AS n FROM valid),
    k AS (SELECT unnest(range(0, 1)) AS i),
    p AS (SELECT sum((1 - i / 8) ** 2 * [1, 8, 28][CAST(i AS INT) + 1] * 0.8 ** i * 0.2 ** (8 - i)) AS p FROM k)
    SELECT CAST(n AS BIGINT) AS sequences, {s_("CASE WHEN p * n * (n - 1) / 2 >= 1 THEN 27.0 ELSE p * n * (n - 1) / 2 * 28 END")} AS threshold FROM c, p""")
def collision_threshold_all(spark, d):
    """With the words of series that have a silent part, which ``collision_threshold`` leaves out."""
    n = symbolic.sax(readings(spark, d), 8, ALPHABET, fill=True).count()
    value = motif.expected_collisions(n, ALPHABET, 8, 0, 2, 28)
    return spark.createDataFrame([(n, float(value))], "sequences long, threshold double").withColumn("threshold", settled("threshold"))


@query(f"""WITH {VALID}, m AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s FROM valid GROUP BY ALL),
    raw AS (SELECT * FROM valid), scaled AS (SELECT series_id, t, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM raw JOIN m USING (series_id)),
    {_FILLED.replace("FROM valid", "FROM scaled")},
    q AS (SELECT series_id, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS b FROM r GROUP BY ALL),
    s AS (SELECT series_id, string_agg(chr(CAST(97 + len(list_filter(b, lambda y: x > round(y, 9))) AS INT)), '' ORDER BY segment) AS word FROM r JOIN q USING (series_id) GROUP BY ALL),
    c AS (SELECT DISTINCT word FROM s), l AS (SELECT word, unnest(range(1, 9)) AS k FROM c),
    d AS (SELECT word, k, ascii(word[k]) - 97 AS x FROM l),
    e AS (SELECT a.word AS a, b.word AS b, count(*) FILTER (a.x = b.x) AS same,
            sqrt(3 * sum(CASE WHEN abs(a.x - b.x) <= 1 THEN 0 ELSE pow([-0.84, -0.25, 0.25, 0.84][greatest(a.x, b.x)] - [-0.84, -0.25, 0.25, 0.84][least(a.x, b.x) + 1], 2) END)) AS far
          FROM d a JOIN d b ON a.k = b.k AND a.word <> b.word GROUP BY ALL),
    seeds AS (SELECT a, b FROM e WHERE a < b AND same >= 6 AND far < 2.0),
    near AS (SELECT a, b FROM e WHERE same >= 2 AND far < 2.0),
    g AS (SELECT s.a, s.b, n.b AS w FROM seeds s JOIN near n ON n.a = s.a UNION SELECT s.a, s.b, n.b FROM seeds s JOIN near n ON n.a = s.b
          UNION SELECT a, b, a FROM seeds UNION SELECT a, b, b FROM seeds),
    w AS (SELECT DISTINCT list_sort(list_distinct(list(w))) AS words FROM g GROUP BY a, b),
    p AS (SELECT words, array_to_string(list_transform(range(1, 9), lambda k: list_sort(list_distinct(list_transform(words, lambda x: x[k])))), ' ') AS x,
            list_transform(range(1, 9), lambda k: list_sort(list_distinct(list_transform(words, lambda x: x[k])))) AS letters FROM w)
    SELECT array_to_string(words, ',') AS "group", array_to_string(list_transform(letters, lambda y: CASE len(y) WHEN 1 THEN y[1] WHEN {ALPHABET} THEN '*'
      ELSE '[' || array_to_string(y, '') || ']' END), '') AS regex FROM p""")
def recognition(spark, d):
    """Groups of series' words around the pairs that collide most."""
    words = materialise(symbolic.sax(transform.scale(readings(spark, d)), 8, ALPHABET, fill=True), "words")
    cells = materialise(motif.collisions(words, 2, word_size=8), "cells")
    table_ = symbolic.mindist_table([-0.84, -0.25, 0.25, 0.84])
    groups = motif.recognise(motif.word_classes(words), cells, cells.where("n >= 15"), table_, 24, 2.0)
    return groups.select(F.array_join("words", ",").alias("group"), motif.pattern_regex(F.col("words"), ALPHABET).alias("regex"))


@query(f"""WITH {_GAPS} SELECT series_id, min(v) AS qual_min_value, max(v) AS qual_max_value, count(*) AS qual_nb_points, {s_("avg(v)")} AS qual_average,
      {s_("CASE WHEN min(v) = max(v) THEN 0 ELSE var_pop(v) END", 3)} AS qual_variance, any_value(qual_ref_period) AS qual_ref_period, any_value(qual_min_period) AS qual_min_period,
      any_value(qual_max_period) AS qual_max_period, any_value(qual_average_period) AS qual_average_period, any_value(qual_hist_period) AS qual_hist_period,
      any_value(qual_hist_period_percent) AS qual_hist_period_percent
    FROM valid LEFT JOIN gaps USING (series_id) GROUP BY series_id""")
def quality_both(spark, d):
    rows = describe.quality(readings(spark, d))
    return rows.withColumns({"qual_average": settled("qual_average"), "qual_variance": settled("qual_variance", 3), "qual_average_period": settled("qual_average_period")})


@query(f"""WITH {VALID}, p AS (SELECT series_id, t, lead(t) OVER (PARTITION BY series_id ORDER BY t) AS nt FROM valid)
    SELECT coalesce(fid, series_id) || '_slope' AS fid, series_id AS parent_id, metric, min(t) AS start_ms, max(t) AS end_ms,
      count(*) AS nb_points, ref_period,
      CASE WHEN any_value(tags) IS NOT NULL THEN array_to_string(list_sort(list_transform(map_entries(any_value(tags)), lambda x: x.key || '=' || coalesce(x.value, ''))), ',') END AS tags
    FROM p LEFT JOIN series USING (series_id) WHERE nt IS NOT NULL GROUP BY fid, series_id, metric, ref_period""")
def derived_metadata(spark, d):
    """What is known of the slopes."""
    return derive.derived_series(transform.slope(readings(spark, d)), table(spark, d, "series"), "slope").withColumn("tags", F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit(""))))), ","))
