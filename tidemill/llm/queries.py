"""Queries of the training-data problems (p1, p2, p5, p8, p9, p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.compare import settled
from tidemill.llm import clusters, glyphs, leakage, mixing, neighbours, quantiles
from tidemill.llm.oracle import ORACLE
from tidemill.functions.typed import number
from tidemill.operators import readings
from tidemill.sources.scratch import materialise
from tidemill.sources.tables import table

WINDOW = 64


def _similar(spark: SparkSession, d: str, least: float) -> DataFrame:
    return neighbours.most_similar(
        table(spark, d, "patterns"), table(spark, d, "search_windows"),
        "pattern_id", "np_pattern_values", "seq_id", "np_values", WINDOW, 5, least,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 0.9).select("pattern_id", "seq_id")


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar windows of each pattern, however similar."""
    return _similar(spark, d, -1.0)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    periods = readings.period_of(table(spark, d, "series"), table(spark, d, "metadata"), number)
    return clusters.alike_clusters(clusters.daily_courses(table(spark, d, "points"), periods))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).where("size >= 2").select("series_id", "cluster_id")


def p2_typical(spark: SparkSession, d: str) -> DataFrame:
    rows = clusters.typical_members(_clusters(spark, d))
    return rows.select("cluster_id", "size", F.round("spread", 6).alias("spread"), F.array_join("typical", ",").alias("typical"))


def p2_leaves(spark: SparkSession, d: str) -> DataFrame:
    """How many compact leaves of the bisecting k-means each cluster is joined from."""
    return clusters.typical_members(_clusters(spark, d)).select("cluster_id", "size", "leaves")


def p2_courses(spark: SparkSession, d: str) -> DataFrame:
    """The daily courses, one row per series and hour."""
    periods = readings.period_of(table(spark, d, "series"), table(spark, d, "metadata"), number)
    rows = clusters.daily_courses(table(spark, d, "points"), periods)
    return rows.select("series_id", F.posexplode("course").alias("hour", "median")).withColumn("median", settled("median"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.high_days(table(spark, d, "points"))


def p5_days(spark: SparkSession, d: str) -> DataFrame:
    rows = quantiles.day_percentiles(table(spark, d, "points"))
    return rows.select("series_id", "day_no", "n", "error", *(settled(c).alias(c) for c in rows.columns[4:]))


def p5_small_days(spark: SparkSession, d: str) -> DataFrame:
    """Of ``p5_days`` those whose readings a sketch holds whole, which makes its percentiles exact."""
    return p5_days(spark, d).where("error = 0")


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of each series, and whether the bounds of its sketch hold them."""
    rows = quantiles.checked_percentiles(table(spark, d, "points"))
    return rows.withColumns({c: settled(c) for c in ("p50", "p90", "p99")})


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.series_percentiles(table(spark, d, "points"), table(spark, d, "series"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return plan.where("short").select("source")


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return plan.withColumns({c: settled(c) for c in ("wanted", "given", "epochs")})


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sample and its plan, from one count of tokens."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sized = materialise(mixing.sized_documents(documents, targets), "sized")
    plan = mixing.mixing_plan(documents, targets, sized=sized)
    return mixing.mixed_sample(documents, plan, sized=sized), plan


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(*_mixed(spark, d)).withColumn("share", settled("share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.lookalike_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The texts that look like others: per document how many documents share its look, and how many its characters."""
    return glyphs.lookalike_classes(table(spark, d, "documents")).select("doc_id", "spellings", "alike", "copies")


def p10_form(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.consistent_form(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "form", (F.coalesce(F.col("form"), F.lit("")) != F.coalesce(F.col("text"), F.lit(""))).alias("changed")
    )


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_similar, p2_found, p2_typical, p2_leaves, p2_courses, p5_found, p5_days, p5_small_days, p5_series, p5_checked, p8_found, p8_report, p9_found, p9_plan, p9_sample, p9_shares, p10_found, p10_classes, p10_form)
}
