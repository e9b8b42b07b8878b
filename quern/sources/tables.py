"""The corpus as chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = "target external_id title agency_name category_name source_date effective_status chunk_no chunk_title chunk_text".split()
_MORE = "source_path source_url".split()
_LAST = "content_hash parent_section_title section_type quality_status embedding_text parent_key".split()

#: The one row type of statute and document chunks.
CHUNK_SCHEMA = T.StructType(
    [T.StructField("chunk_id", T.LongType()), T.StructField("document_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField("page_no", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in _MORE]
    + [T.StructField("sort_order", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in _LAST]
    + [T.StructField("chunk_version", T.IntegerType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew only if its scan has fewer partitions than there are cores: a small file of one row group is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Ids of documents that are sent to all tasks; more are joined as Spark chooses.
SENT = 1 << 20


def chosen(documents: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``of`` names (document_id): up to ``SENT`` names go to the rows, so that no text is moved."""
    names = of.select(F.col("document_id").cast("long").alias("doc_id")).distinct()
    return documents.join(F.broadcast(names) if names.limit(SENT + 1).count() <= SENT else names, "doc_id", "left_semi")


def chunks(spark: SparkSession, sf_dir: str, *of_document: Column, of: DataFrame | None = None) -> DataFrame:
    """Lines of documents as chunks: the first line is the title, the language the target, the source the agency.

    ``of_document`` are further columns made of ``documents``, once for each.
    ``of`` (document_id) narrows the documents before their texts are cut.
    """
    lines = F.split("text", "\n")
    documents = spread(table(spark, sf_dir, "documents"))
    # Beside the generator, title and further columns would be made of the whole text again for each line.
    rows = (documents if of is None else chosen(documents, of)).select("doc_id", "lang", "source", lines[0].alias("title"), *of_document, lines.alias("lines"))
    more = rows.columns[4:-1]
    rows = rows.select(*rows.columns[:-1], F.posexplode("lines").alias("pos", "line"))
    return rows.filter(F.trim("line") != "").select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("chunk_id"), F.col("lang").alias("target"),
        F.col("source").alias("agency_name"), "title", F.col("line").alias("chunk_text"), F.col("pos").alias("sort_order"),
        F.sha2("line", 256).alias("content_hash"), *more,
    )


#: The same rows in SQL.
CHUNKS_SQL = """chunks as (
  select doc_id as document_id, doc_id * 1000000 + pos as chunk_id, lang as target, source as agency_name, title, line as chunk_text,
         pos as sort_order, sha256(line) as content_hash
  from (select doc_id, lang, source, l[1] as title, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos
        from (select *, string_split(text, chr(10)) as l from documents))
  where trim(line) <> '')"""


def conform(df: DataFrame, schema: T.StructType = CHUNK_SCHEMA) -> DataFrame:
    """``df`` in the canonical row type: columns it lacks are typed nulls, a blank quality status is PASS."""
    found = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    if "quality_status" in schema.names:
        found = found.withColumn("quality_status", F.coalesce(F.when(F.trim("quality_status") != "", F.col("quality_status")), F.lit("PASS")))
    return found
