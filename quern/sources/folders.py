"""Folders of documents: text and mark-down read as they are, other formats listed with their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.sinks import preferred_files


def folder_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, dir, base, kind, size, sha256, text) of the preferred file of each name; text is null for formats that need an extractor."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), F.when(kind.isin("txt", "md"), F.decode("content", "UTF-8")).alias("text"))
    chosen = preferred_files(rows.select("path"))
    return chosen.select("path", "dir", "base").join(rows, "path").select("path", "dir", "base", "kind", "size", "sha256", "text")
