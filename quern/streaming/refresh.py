"""Streams: refreshing an index as documents arrive, and windows over events.

The batch engine has no stream operator to mirror; these are extensions.
"""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.terms import terms_of


def refresh_index(spark: SparkSession, source: str, index: str, checkpoint: str, schema: str = "doc_id long, text string, lang string"):
    """Adds the terms of documents whose content the index doesn't have; returns the query after all there is has been read.

    ``index`` is one table with a row for each document and content, its terms
    in it, in a folder for each micro-batch.  A batch writes its own folder and
    replaces it if it is run again, and it looks for known content in earlier
    folders only, so wherever a run dies the next one gives the same table.
    Folders are named by the checkpoint as well: another stream into the same
    index finds what the first one wrote.  A null text is empty.
    """
    stream_id = zlib.crc32(checkpoint.encode())

    def add(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        own = f"{index}/stream={stream_id}/epoch={epoch}"
        rows = batch.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "content_hash"])
        known = read_index(s, index)
        if known is not None:
            earlier = known.filter((F.col("stream") != stream_id) | (F.col("epoch") < epoch)).select(F.col("doc_id").alias("i"), F.col("content_hash").alias("h"))
            rows = rows.join(earlier, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("content_hash") == F.col("h")), "left_anti")
        rows.select("doc_id", "content_hash", terms_of(F.col("text")).alias("terms")).write.mode("overwrite").parquet(own)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_index(spark: SparkSession, index: str) -> DataFrame | None:
    """(doc_id, content_hash, terms, stream, epoch) of all batches; None before the first."""
    try:
        return spark.read.schema("doc_id long, content_hash string, terms array<string>, stream long, epoch long").parquet(index)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def index_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, content_hash, term, tf) of the index's rows."""
    return rows.select("doc_id", "content_hash", F.explode("terms").alias("term")).groupBy("doc_id", "content_hash", "term").agg(F.count(F.lit(1)).alias("tf"))


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of events by tumbling window and kind; works on a stream (with a watermark) and on a table alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "total"
    )


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events"
    )
