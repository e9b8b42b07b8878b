"""Keyed writes as DataFrame programs: the new state of a table, to be written as one Parquet overwrite of a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners in ``new`` give way to its rows."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def points_updated(points: DataFrame, new: DataFrame, gone: DataFrame, states: DataFrame) -> DataFrame:
    """Points (point_id, payload, status, and others) with ``new`` ones put in, those of ``gone`` (point_id) taken out, and ``states`` (point_id, status) set.

    An id may come once in ``new``; of several states of an id the greatest is set; null ids are neither replaced nor taken out.
    """
    rows = upserted(points, new, ["point_id"]).join(gone.select("point_id"), "point_id", "left_anti")
    states = states.groupBy("point_id").agg(F.max("status").alias("_state"))
    return rows.join(states, "point_id", "left").withColumn("status", F.coalesce("_state", "status")).drop("_state")


def preferred_files(files: DataFrame) -> DataFrame:
    """One file of each (dir, base name): by kind pdf, docx, hwpx, txt, md, then path."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(k) for k in ("pdf", "docx", "hwpx", "txt", "md")]), kind)
    base = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")), r"[\s_\-()]+", "")
    rows = files.withColumn("kind_rank", rank).filter("kind_rank > 0").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("base", base)
    order = Window.partitionBy("dir", "base").orderBy("kind_rank", "path")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def read_cases(spark: SparkSession, path: str, columns: list[str], least: int = 8) -> DataFrame:
    """A tab-separated file of evaluation cases: quoted, multi-line, lists by ``|``; rows with too few fields are dropped."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.csv(path, sep="\t", multiLine=True, quote='"', escape='"', schema=schema, encoding="UTF-8")
    first = F.regexp_replace(columns[0], "^﻿", "")
    return rows.withColumn(columns[0], first).filter(F.col(columns[least - 1]).isNotNull() & (F.trim(columns[0]) != ""))


def write_requests(rows: DataFrame, path: str, model: str) -> None:
    """JSON lines of embedding requests, one for each (custom_id, input)."""
    body = F.struct(F.lit(model).alias("model"), F.col("input"))
    rows.select("custom_id", F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")).write.json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, status_code, embedding, error) of response lines."""
    schema = "custom_id string, response struct<status_code: int, body: struct<data: array<struct<embedding: array<double>>>>>, error struct<message: string>"
    rows = spark.read.schema(schema).json(path)
    return rows.select("custom_id", "response.status_code", F.get("response.body.data", F.lit(0))["embedding"].alias("embedding"), F.col("error.message").alias("error"))


def manifest_diff(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """What differs between two manifests (path, size, sha256): MISSING, EXTRA, SIZE, HASH or SAME."""
    a = left.select(key, F.col("size").alias("s1"), F.col("sha256").alias("h1"))
    b = right.select(key, F.col("size").alias("s2"), F.col("sha256").alias("h2"))
    state = F.when(F.col("h2").isNull(), "MISSING").when(F.col("h1").isNull(), "EXTRA").when(F.col("s1") != F.col("s2"), "SIZE").when(F.col("h1") != F.col("h2"), "HASH").otherwise("SAME")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
