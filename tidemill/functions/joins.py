"""Joins whose broadcast side has its size checked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.scratch import is_written, materialise

#: Rows up to which a side of a few narrow columns is broadcast: some tens of megabytes.
BROADCAST_ROWS = 500_000
#: Bytes of files, or of texts, up to which a side is broadcast.
BROADCAST_BYTES = 64 << 20
#: Parts into which the rows of a key are spread where a side is too large to be broadcast.
SALTS = 16


def is_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most so many rows; counts no further than that."""
    return frame.limit(rows + 1).count() <= rows


def is_light(frame: DataFrame, text: Column | str, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether the frame has at most so many rows and its texts at most so many bytes together."""
    n, held = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return n <= rows and held <= size


def salted_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins with the rows of each key on the left spread over ``salts`` parts, and those on the right, which are few a
    key, sent to each part. The rows on the left are told apart by all their plain columns."""
    keys = [on] if isinstance(on, str) else list(on)
    plain = [name for name, kind in left.dtypes if not kind.startswith(("map", "variant"))]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def fits(written: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written frame has few enough rows and bytes to be broadcast. Its files may hold texts in a fraction of what
    the driver needs, which has them as a key and in the row: so their lengths are added up."""
    if int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > size:
        return False
    texts = [name for name, kind in written.dtypes if kind == "string"]
    return is_light(written, F.concat_ws("", *texts), rows, size // 2) if texts else is_small(written, rows)


def measured_join(left: DataFrame, right: DataFrame, on: list[str] | str, small: bool, how: str = "inner") -> DataFrame:
    """Joins with a right side that is known to be small enough to be broadcast, or not: then rows on the left are spread."""
    return left.join(F.broadcast(right), on, how) if small else salted_join(left, right, on, how)


def sized_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins an inner or left join with a right side of few rows a key. It is written once, unless it is read from files as
    it is, and counted there; found small in rows and bytes it is broadcast, else the left rows of a key are spread."""
    right = right if is_written(right) else materialise(right, "side")
    return measured_join(left, right, on, fits(right, rows), how)
