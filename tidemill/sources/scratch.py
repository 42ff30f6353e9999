"""Intermediate tables in the folder that all executors share.

A lineage that is read more than once, or that an iteration would let grow, is cut by writing it as Parquet below
``spark.checkpoint.dir``. The files outlive a lost executor. They are removed by ``clear`` and when
the Python process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only on a local master, as in tests, a temporary folder stands in for it;
    on a cluster the executors would not share that, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Writes the frame and reads it again with the same columns."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _written.append((spark, path))
    held = spark.read.schema(frame.schema).parquet(path)
    held.__dict__["_written"] = True
    return held


def is_written(frame: DataFrame) -> bool:
    """Whether the frame is what ``materialise`` gave, with nothing done to it."""
    return bool(frame.__dict__.get("_written"))


def clear() -> None:
    """Removes all files written so far. For long sessions: frames that read them can't be used any more."""
    for spark, path in _written:
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass
    _written.clear()


atexit.register(clear)
