"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh local one is set only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-quern-")
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


_UNITS = {u: 1 << 10 * i for i, u in enumerate("bkmgtp")}


def byte_count(setting: str) -> int:
    """A size as Spark's settings write it (``8m``, ``64MB``, ``100``) in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit or "b"]


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of at most so many rows and bytes (or one row): a batch is held by the JVM and by Python at once.

    Plans read these settings when they run, so they stay lowered for the session; lower ones of the user's are kept.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < byte_count(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows apart by these columns; null differs from any value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
