"""Queries of the ingest family: payloads, sections, chunkers, headings, and the event windows that extend it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.cleaning import metric_form
from quern.operators import chunking
from quern.sources import payloads
from quern.sources.tables import CHUNKS_SQL, chunks, conform, table
from quern.streaming import refresh


def search_payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    row = F.struct(F.split("text", "\n")[0].alias("제목"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("기관명"), F.lit("20240230").alias("시행일자"))
    packed = docs.groupBy("lang", (F.col("doc_id") % 50).alias("page")).agg(F.to_json(F.struct(F.struct(F.lit("00").alias("resultCode"), F.collect_list(row).alias("law")).alias("LawSearch"))).alias("payload"))
    return payloads.search_documents(packed.select(F.col("lang").alias("target"), "payload")).drop("row")


def detail_payload_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.split("text", "\n").alias("조문"), F.col("source").alias("부처")))
    return payloads.detail_sections(docs.select(F.col("doc_id").alias("key"), body.alias("payload"))).drop("no")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text")
    return chunking.page_chunks(docs)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of 30 lines: chunks with the heading that passes from page to page."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("l"))
    pages = lines.select("document_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 30)), lambda i: F.array_join(F.slice("l", (i * 30 + 1).cast("int"), 30), "\n"))).alias("no", "text"))
    return chunking.document_chunks(pages.select("document_id", (F.col("no") + 1).alias("page_no"), "text"))


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("document_id", "sort_order", F.floor(F.col("sort_order") / 4).cast("string").alias("key"), F.col("chunk_text").alias("text"))
    return chunking.section_children(rows)


GENERAL, DOMAIN = ["the", "de"], ["ing", "tion"]


def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = chunking.heading_score(F.col("chunk_text"), GENERAL, DOMAIN)
    return chunks(spark, sf_dir).select("chunk_id", score.alias("heading_score"), (score >= 3).alias("heading"))


def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = chunking.section_kind(F.col("agency_name"), F.col("title"), F.col("chunk_text"))
    return chunks(spark, sf_dir).groupBy(kind.alias("section_type")).agg(F.count(F.lit(1)).alias("chunks"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = chunking.embedding_text(F.col("title"), F.col("agency_name"), F.lit(" "), F.lit("body"), F.lit(None), F.col("chunk_text"))
    return chunks(spark, sf_dir).select("chunk_id", F.sha2(text, 256).alias("embedding_hash"))


def canonical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute chunks and uploaded pages in one row type."""
    law = conform(chunks(spark, sf_dir).withColumn("embedding_text", F.lit("x")))
    rag = conform(page_chunks(spark, sf_dir).withColumn("target", F.lit("official_doc")).withColumn("quality_status", F.lit(" ")))
    both = law.unionByName(rag)
    return both.groupBy("target", "quality_status").agg(F.count(F.lit(1)).alias("chunks"), F.count("page_no").alias("paged"), F.count("embedding_text").alias("embedded"))


def metric_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", metric_form(F.col("text")).alias("form"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.event_windows(table(spark, sf_dir, "events"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.user_sessions(table(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        search_payload_documents, detail_payload_sections, page_chunks, document_chunks, section_children, heading_scores, section_kinds, embedding_texts, canonical_chunks,
        metric_forms, event_windows, user_sessions,
    )
}

_KINDS = (("target_scope", chunking.SCOPE), ("exception", chunking.EXCEPTION), ("requirement", chunking.REQUIREMENT), ("procedure", chunking.PROCEDURE))

SQL = {
    "section_kinds": f"""with {CHUNKS_SQL},
        t as (select chunk_text, regexp_replace(lower(concat_ws(' ', agency_name, title)), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') as head,
                     regexp_replace(lower(concat_ws(' ', agency_name, title, chunk_text)), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') as whole from chunks)
        select case when regexp_matches(whole, '목차|contents') then 'toc'
               {" ".join(f"when regexp_matches({x}, '{'|'.join(w)}') then '{k}'" for x in ("head", "whole") for k, w in _KINDS)}
               when regexp_matches(whole, '{"|".join(chunking.EXAMPLE)}') then 'example' when regexp_matches(chunk_text, '(?m)^(.*\\|){{3,}}|(\\t.*){{3,}}') then 'table' else 'body' end as section_type,
               count(*) as chunks from t group by 1""",
    "detail_payload_sections": """
        with l as (select doc_id as key, source, string_split(text, chr(10)) as l from documents),
        s as (select key, generate_subscripts(l, 1) - 1 as i, trim(unnest(l), ' ' || chr(9) || chr(13)) as body from l)
        select key, row_number() over (partition by key order by i) - 1 as sort_order, 'text' as type, '$.조문[' || i || ']' as title, body from s where length(body) >= 20""",
    "heading_scores": f"""with {CHUNKS_SQL}, s as (
          select chunk_id, case when trim(chunk_text) = '' or length(chunk_text) > 120 then 0 else
            case when regexp_matches(chunk_text, '^(?:제\\s*\\d+\\s*[장절조]|[IVX]+\\.|\\d{{1,2}}(?:\\.\\d{{1,2}})*[.)]?\\s|[①-⑩]|#+\\s)') then 2 else 0 end
            + case when length(chunk_text) <= 80 then 1 else 0 end + case when regexp_matches(chunk_text, '(다|요|함|됨)?[.!]$') then -2 else 1 end
            + case when regexp_matches(lower(chunk_text), 'the|de') then 1 else 0 end + case when regexp_matches(lower(chunk_text), 'ing|tion') then 1 else 0 end
            + case when length(chunk_text) > 100 then -2 else 0 end + case when length(regexp_replace(chunk_text, '[^,，]', '', 'g')) >= 2 then -2 else 0 end
            + case when regexp_matches(chunk_text, '[?？]') then -2 else 0 end end as heading_score from chunks)
        select *, heading_score >= 3 as heading from s""",
    "embedding_texts": f"""with {CHUNKS_SQL} select chunk_id, sha256(trim(concat_ws(chr(10), case when trim(title) <> '' then '문서: ' || trim(title) end, '상위 섹션: ' || trim(agency_name), '섹션유형: body', '본문:', trim(chunk_text)))) as embedding_hash from chunks""",
    "metric_forms": r"select item_id, regexp_replace(lower(coalesce(text, '')), '[\p{P}\p{S}\s]+', '', 'g') as form from benchmark",
    "event_windows": """select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2""",
    "user_sessions": """
        with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as starts from events),
        s as (select *, sum(starts) over (partition by user_id order by ts, starts desc rows unbounded preceding) as n from e)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as events from s group by user_id, n""",
}
