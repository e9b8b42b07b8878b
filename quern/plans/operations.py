"""Queries of guards, coverage reports, provenance and case generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import claims
from quern.functions.cleaning import is_sha256, question_key
from quern.operators import audit
from quern.plans import retrieval
from quern.plans.audits import _LEDGER, _ledger
from quern.plans.retrieval import _wholly
from quern.sources.tables import CHUNKS_SQL, chunks, table

TRANCHES = (2, 10, 50, 200)


def comparable_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per target whose embedding is of the content that the chunk has now."""
    rows = chunks(spark, sf_dir).select("chunk_id", "target", "content_hash").join(_ledger(spark, sf_dir), "chunk_id")
    good = rows.filter((F.col("status") == "INDEXED") & (F.col("indexed_hash") == F.col("content_hash")) & is_sha256(F.col("content_hash")))
    return good.groupBy("target").agg(F.count(F.lit(1)).alias("chunks"))


def backlog_guard(spark: SparkSession, sf_dir: str, q: str = "the") -> DataFrame:
    """Per target: matching chunks that wait for an embedding, searchable or not, and how many the next job may take."""
    text = F.lower("chunk_text").contains(q) | F.lower("title").contains(q) | F.lower("agency_name").contains(q)
    rows = chunks(spark, sf_dir).filter(text).join(_ledger(spark, sf_dir).withColumn("found", F.lit(True)), "chunk_id", "left")
    stale = audit.is_stale(F.col("status"), F.col("indexed_hash"), F.col("content_hash"), F.coalesce("found", F.lit(False)))
    searchable = F.col("chunk_id") % 5 != 0
    done = F.count_if(~stale & searchable)
    counts = rows.groupBy("target").agg(F.count_if(stale & searchable).alias("backlog"), F.count_if(stale & ~searchable).alias("not_searchable"), done.alias("largest_success"))
    step = F.coalesce(*[F.when(F.lit(t) > F.col("largest_success"), F.lit(t)) for t in TRANCHES], F.lit(TRANCHES[-1]))
    return counts.withColumn("next_limit", F.least(step, F.col("backlog")))


def release_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of a set of cases: the same question and oracle twice, or no forbidden term where none should be found."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    cases = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), question_key(F.col("text")).alias("question"), (F.col("conv_id") % 4).alias("oracle"), (F.col("conv_id") % 9 == 0).alias("no_ground"), (F.col("conv_id") % 18 == 0).alias("has_forbidden"))
    first = F.min("case_id").over(Window.partitionBy("question", "oracle"))
    rows = cases.withColumn("first_id", first)
    twice = rows.filter("question <> '' and case_id > first_id").select("case_id", F.lit("DUPLICATE_QUESTION_ORACLE").alias("code"))
    bare = rows.filter("no_ground and not has_forbidden").select("case_id", F.lit("NO_GROUNDS_DISTRACTOR_MISSING").alias("code"))
    return twice.unionByName(bare)


def coverage_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("cases"))
    risk = audit.first_match((F.col("cases") == 0, "UNCOVERED"), (F.col("cases") * 4 < F.col("documents"), "THIN"), otherwise="COVERED")
    return rows.withColumn("risk", risk)


def threshold_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures against their limits."""
    n = F.length("chunk_text")
    m = chunks(spark, sf_dir).agg(F.count_if(n < 20).alias("tiny"), F.count_if(n < 80).alias("short"), F.count_if(n > 2500).alias("long"))
    limits = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.lit(v).cast("long").alias("threshold")) for k, v in (("tiny", 300), ("short", 100), ("long", 50))]))
    return m.select(limits.alias("g")).select("g.gate", "g.value", "g.threshold", (F.col("g.value") <= F.col("g.threshold")).alias("passed"))


def selection_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the selected cases of each bucket in order, so that a run names exactly what it measured."""
    b = table(spark, sf_dir, "benchmark").withColumn("bucket", F.col("item_id") % 4)
    framed = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda s: F.concat(s["item_id"].cast("string"), F.lit("|"), s["text"], F.lit("|")))
    return b.groupBy("bucket").agg(F.sha2(F.array_join(framed, ""), 256).alias("selection_hash"), F.count(F.lit(1)).alias("cases"))


def generated_cases(spark: SparkSession, sf_dir: str, each: int = 5) -> DataFrame:
    """Cases made in turns over groups: from each language and source the first titles not seen before, at most ``each``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split("text", "\n")[0].alias("title"))
    unique = docs.withColumn("n", F.row_number().over(Window.partitionBy("title").orderBy("doc_id"))).filter("n = 1")
    turn = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return unique.withColumn("turn", turn).filter(F.col("turn") <= each).select("doc_id", "lang", "source", "title", "turn")


def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by ways of finding them, the first way wins: the title's terms, then the hits of BM25."""
    hits = retrieval.bm25_hits(spark, sf_dir, 20, whole=True).select("query_id", "document_id", "rank")
    by_hit = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))
    seeds = retrieval._seeds(spark, sf_dir, whole=True).select("query_id", "document_id", F.col("seed_rank").alias("rank"))
    rows = seeds.withColumn("way", F.lit(0)).unionByName(by_hit.withColumn("way", F.lit(1)))
    best = rows.groupBy("query_id", "document_id").agg(F.min(F.struct("way", "rank")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.way", "b.rank", "document_id")
    return best.select("query_id", "document_id", "b.way", F.row_number().over(order).alias("found_rank"))


def question_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a question's terms its answer takes up, and whether that is enough."""
    c = table(spark, sf_dir, "conversations")
    words = lambda who: c.filter(F.col("role") == who).select("conv_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2))).alias("w")).distinct()
    asked, said = words("user"), words("assistant")
    n = asked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("asked"))
    met = asked.join(said, ["conv_id", "w"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("met"))
    rows = n.join(met, "conv_id", "left").fillna(0, ["met"])
    return rows.withColumn("aligned", F.col("met") * 3 >= F.col("asked"))


def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(claims.numeric_tokens_udf("text"), " ").alias("numbers"))


def document_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its chunks, none included."""
    n = chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang").join(n, "document_id", "left").fillna(0, ["chunks"])


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.asked_terms(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        comparable_indexed, backlog_guard, release_coverage, coverage_by_target, threshold_gates, selection_hashes, generated_cases, title_lookup, question_alignment,
        numeric_claims, document_chunk_counts, asked_terms,
    )
}

_W = "list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 2))"

SQL = {
    "comparable_indexed": f"with {_LEDGER} select target, count(*) as chunks from both_ where status = 'INDEXED' and indexed_hash = content_hash and regexp_matches(content_hash, '^[0-9A-Fa-f]{{64}}$') group by 1",
    "backlog_guard": f"""with {_LEDGER}, s as (select *, chunk_id % 5 <> 0 as searchable, not found or coalesce(status in ('FAILED', 'ERROR'), false) or coalesce(indexed_hash, '') <> content_hash as stale
          from both_ where contains(lower(chunk_text), 'the') or contains(lower(title), 'the') or contains(lower(agency_name), 'the')),
        c as (select target, count(*) filter (stale and searchable) as backlog, count(*) filter (stale and not searchable) as not_searchable, count(*) filter (not stale and searchable) as largest_success from s group by 1)
        select *, least(case when largest_success < 2 then 2 when largest_success < 10 then 10 when largest_success < 50 then 50 else 200 end, backlog) as next_limit from c""",
    "release_coverage": r"""
        with c as (select conv_id * 100 + turn as case_id, lower(regexp_replace(trim(text), '[ \t?？]', '', 'g')) as question, conv_id % 4 as oracle, conv_id from conversations where role = 'user'),
        f as (select *, min(case_id) over (partition by question, oracle) as first_id from c)
        select case_id, 'DUPLICATE_QUESTION_ORACLE' as code from f where question <> '' and case_id > first_id
        union all select case_id, 'NO_GROUNDS_DISTRACTOR_MISSING' from f where conv_id % 9 = 0 and conv_id % 18 <> 0""",
    "coverage_by_target": """with c as (select lang, source, count(*) as documents, count(quality) as cases from documents left join labels using (doc_id) group by 1, 2)
        select *, case when cases = 0 then 'UNCOVERED' when cases * 4 < documents then 'THIN' else 'COVERED' end as risk from c""",
    "threshold_gates": f"""with {CHUNKS_SQL}, m as (select unnest(['tiny', 'short', 'long']) as gate, unnest([count(*) filter (length(chunk_text) < 20), count(*) filter (length(chunk_text) < 80), count(*) filter (length(chunk_text) > 2500)]) as value,
          unnest([300, 100, 50]) as threshold from chunks) select gate, value, threshold, value <= threshold as passed from m""",
    "selection_hashes": "select item_id % 4 as bucket, sha256(string_agg(item_id || '|' || text || '|', '' order by item_id)) as selection_hash, count(*) as cases from benchmark group by 1",
    "generated_cases": """
        with d as (select doc_id, lang, source, string_split(text, chr(10))[1] as title from documents), u as (select * from d qualify row_number() over (partition by title order by doc_id) = 1)
        select *, row_number() over (partition by lang, source order by doc_id) as turn from u qualify turn <= 5""",
    "title_lookup": _wholly(f"""with {retrieval._INDEX}, {retrieval._ASKED}, {retrieval._HITS}, {retrieval._SEEDS},
        r as (select query_id, document_id, seed_rank as rank, 0 as way from seeds union all select query_id, document_id, min(rank), 1 from bm where rank <= 20 group by 1, 2),
        b as (select * from r qualify row_number() over (partition by query_id, document_id order by way, rank) = 1)
        select query_id, document_id, way, row_number() over (partition by query_id order by way, rank, document_id) as found_rank from b"""),
    "question_alignment": f"""
        with a as (select distinct conv_id, unnest({_W}) as w from conversations where role = 'user'), s as (select distinct conv_id, unnest({_W}) as w from conversations where role = 'assistant'),
        n as (select conv_id, count(*) as asked, count(s.w) as met from a left join s using (conv_id, w) group by 1) select *, met * 3 >= asked as aligned from n""",
    "document_chunk_counts": f"with {CHUNKS_SQL} select doc_id as document_id, lang, (select count(*) from chunks c where c.document_id = doc_id) as chunks from documents",
    "asked_terms": f"with {retrieval._INDEX}, {retrieval._ASKED} select query_id, term, pos from asked",
}
