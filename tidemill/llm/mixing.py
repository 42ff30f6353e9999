"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.typed import BLANKS

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def token_counts(frame: DataFrame, text: str = "text", tokens: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """Replaces a text column by its number of tokens of a public tokenizer. NULL has 0. ``tokenizer`` is a file that
    every executor can read."""
    columns = [c for c in frame.columns if c not in (text, tokens)]
    schema = frame.select(*columns).schema.add(tokens, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = _tokenizer(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(columns)).to_pylist()]
            counts = [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(counts, pa.int64())], [*columns, tokens])

    return frame.select(*columns, text).mapInArrow(run, schema)


def source_name(source) -> F.Column:
    return F.lower(F.btrim(source, F.lit(BLANKS)))


def water_fill(sizes: list[float], shares: list[float], repeats: list[float], total: float) -> list[float]:
    """The size each source gives so that they sum to ``total``: shares in proportion, a source that can't reach its
    part (its size times its repeats) clamped there, and what it lacks spread over the others in proportion, until
    nothing exceeds its clamp. If all clamps together stay below ``total``, all are clamped."""
    caps = [s * r for s, r in zip(sizes, repeats, strict=True)]
    given = [0.0] * len(caps)
    open_, left = [i for i in range(len(caps)) if shares[i] > 0], total
    while open_ and left > 0:
        weight = sum(shares[i] for i in open_)
        level = left / weight
        full = [i for i in open_ if caps[i] <= level * shares[i]]
        if not full:
            for i in open_:
                given[i] = level * shares[i]
            break
        for i in full:
            given[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    return given


def _listed(targets: DataFrame, limit: int) -> list:
    """The listed sources, one row a name."""
    listed = targets.where(F.col("source").isNotNull()).groupBy(source_name("source").alias("key")).agg(
        F.min("source").alias("source"), F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    )
    rows = listed.orderBy("key").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} sources are listed")
    return rows


def sized_documents(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, limit: int = 10_000) -> DataFrame:
    """``doc_id, key, tokens`` of the rows of listed sources (``key`` is the source's name as compared). Only these are read by
    the tokenizer. For a plan and its sample, to count once."""
    keys = [r["key"] for r in _listed(targets, limit)]
    rows = documents.select("doc_id", source_name("source").alias("key"), "text").where(F.col("key").isin(keys) if keys else F.lit(False))
    return token_counts(rows, tokenizer=tokenizer)


def mixing_plan(
    documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER, limit: int = 10_000, sized: DataFrame | None = None
) -> DataFrame:
    """One row per listed source: ``source, target_share, max_repeats, rows, size, wanted, given, epochs, short``.

    ``size`` is the source's size in tokens, ``wanted`` its target share of the total (``total`` tokens, by default
    those of all rows of listed sources), ``given`` what the capped water-filling takes from it, ``epochs`` how often
    its rows are taken, and ``short`` says that even all rows taken ``max_repeats`` times stay below ``wanted``. Source
    names compare trimmed and in lower case, and are given as in ``targets``; a name listed twice counts once (its
    greatest values). A source without rows has size 0. NULL sources and sources not listed take no part. Sizes are
    added up before the shuffle; only one row per listed source, at most ``limit``, comes to the driver. ``sized`` is what
    ``sized_documents`` gave, if that is at hand.
    """
    spark = documents.sparkSession
    rows = _listed(targets, limit)
    keys = [r["key"] for r in rows]
    sized = sized_documents(documents, targets, tokenizer, limit) if sized is None else sized
    sums = {
        r["key"]: (r["rows"], r["size"])
        for r in sized.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("size")).collect()
    } if keys else {}
    sizes = [float(sums.get(k, (0, 0))[1] or 0) for k in keys]
    shares = [max(0.0, r["share"] or 0.0) for r in rows]
    repeats = [float(max(0, r["repeats"] or 0)) for r in rows]
    whole = float(sum(sizes)) if total is None else float(total)
    given = water_fill(sizes, shares, repeats, whole)
    plan = [
        (r["source"], r["share"], r["repeats"], sums.get(k, (0, 0))[0], int(size), share * whole, g,
         g / size if size else 0.0, size * most < share * whole)
        for r, k, size, share, most, g in zip(rows, keys, sizes, shares, repeats, given, strict=True)
    ]
    return spark.createDataFrame(
        plan,
        "source string, target_share double, max_repeats int, rows long, size long, wanted double, given double, epochs double, short boolean",
    )


def mixed_sample(documents: DataFrame, plan: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER, sized: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, tokens, copies``: how often each row of a listed source is taken; rows taken 0 times are left out.

    Every row is taken the whole part of its source's epochs; a row whose seeded hash falls below the fractional part
    is taken once more, never more than ``max_repeats`` times in all. The choice depends on the seed and the id alone,
    not on how rows are laid out. ``plan`` is that of ``mixing_plan``: one row per listed source, a bounded number.
    """
    names = F.broadcast(plan.select(source_name("source").alias("key"), "source", "epochs", "max_repeats"))
    rows = sized_documents(documents, plan.select("source", F.col("target_share"), "max_repeats"), tokenizer) if sized is None else sized
    joined = rows.join(names, "key")
    # 53 bits of the hash as a number in [0, 1)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    whole = F.floor("epochs")
    copies = F.least(whole + (draw < F.col("epochs") - whole).cast("long"), F.col("max_repeats").cast("long"))
    return joined.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares_reached(sample: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, tokens_taken, rows_taken, share`` of every listed source."""
    taken = sample.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_taken"), F.sum("copies").alias("rows_taken")
    )
    total = F.sum("tokens_taken").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    return (
        plan.select("source", "target_share", "max_repeats")
        .join(taken, "source", "left")
        .fillna(0, subset=["tokens_taken", "rows_taken"])
        .withColumn("share", F.coalesce(F.try_divide("tokens_taken", total), F.lit(0.0)))
    )
