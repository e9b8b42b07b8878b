"""Queries that choose documents and chunks by anchors, score candidates and judge cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.terms import terms_of
from quern.operators import lexical, selection
from quern.plans import audits, retrieval
from quern.plans.retrieval import _wholly
from quern.sources import sinks
from quern.sources.scratch import written
from quern.sources.tables import CHUNKS_SQL, chosen, chunks, table


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of chunks; words of a title are found once a document, not once a line."""
    title = F.array_distinct(terms_of(F.regexp_replace(F.split("text", "\n")[0], r"[^A-Za-z0-9\p{IsHangul}]+", " "))).alias("title_terms")
    own = chunks(spark, sf_dir, title)
    return lexical.keyword_index(own, {"parent_title": "title_terms", "chunk_title": "agency_name", "body": "chunk_text"})


def _chosen(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(query_id, terms, rarest): the terms that a question is searched by, and the rarest of them."""
    found = retrieval.searched_terms(spark, sf_dir, whole).groupBy("query_id")
    return found.agg(F.sort_array(F.collect_list("term")).alias("terms"), F.min_by("term", F.struct("document_frequency", "term")).alias("rarest"))


def _anchored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(anchors, chosen documents): the rarest term must lie in the title of a document that was found."""
    anchors = _chosen(spark, sf_dir).select(
        "query_id", F.array("rarest").alias("title_terms"), F.when(F.col("query_id") % 3 == 0, F.array(F.lit("en"))).alias("targets"),
        F.array(F.lit("2")).alias("provision_terms"), F.array("rarest").alias("heading_terms"), F.col("terms").alias("evidence_terms"),
    )
    hits = retrieval.bm25_hits(spark, sf_dir, 50)
    titles = chosen(table(spark, sf_dir, "documents"), hits).select(F.col("doc_id").alias("document_id"), F.split("text", "\n")[0].alias("title"), (F.col("doc_id") % 5 == 0).alias("provision_match"))
    found = hits.select("query_id", "target", "document_id").distinct().join(titles, "document_id")
    return anchors, selection.anchored_documents(anchors.select("query_id", "title_terms", "targets"), found)


def anchored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir)[1]


def anchored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, selected = _anchored(spark, sf_dir)
    selected = written(selected, "selected")
    rows = chunks(spark, sf_dir, of=selected).select(
        "document_id", "target", "chunk_id", F.col("sort_order").cast("string").alias("chunk_no"), F.col("agency_name").alias("chunk_title"), F.col("title").alias("parent_title"),
        "chunk_text", "sort_order",
    )
    return selection.anchored_chunks(selected, rows, anchors, seen=retrieval.bm25_hits(spark, sf_dir))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the greater of two scores, lifted by their fused one."""
    first, second, _, fused = retrieval.stage_lists(spark, sf_dir, whole=True)
    found = selection.base_scores(first.withColumn("score", F.col("term_score").cast("double")), second, fused)
    return found.withColumn("score", F.round("score", 6))


def _verdicts(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Cases: two of the terms searched by must lie in the first eight hits, the rarest in a title, and 'toxic' nowhere."""
    none = F.lit(None).cast("array<string>")
    asked = _chosen(spark, sf_dir, whole).select(
        F.col("query_id").alias("case_id"), F.lit("OK").alias("result_msg"), F.lit(2).alias("required_matches"), F.col("terms").alias("expected_terms"),
        F.when(F.col("query_id") % 2 == 0, F.array("rarest")).alias("title_terms"), F.array(F.lit("toxic")).alias("forbidden_terms"),
        *[none.alias(c) for c in ("section_types", "document_terms", "page_numbers", "parent_terms", "result_msgs")],
    )
    hits = retrieval.bm25_hits(spark, sf_dir, 8, whole)
    own = chunks(spark, sf_dir, of=hits).select("chunk_id", F.col("chunk_text").alias("text"), F.col("title").alias("title_text"))
    items = hits.select(F.col("query_id").alias("case_id"), "rank", "chunk_id").join(own, "chunk_id")
    items = items.select("case_id", "rank", "text", "title_text", F.lit("").alias("parent_text"), F.lit("body").alias("section_type"), F.lit(None).cast("int").alias("page_no"))
    return selection.case_verdicts(asked, items)


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.array_join(F.sort_array(c), " ").alias(c) for c in ("matched_terms", "missing_terms", "forbidden_matched")]
    return _verdicts(spark, sf_dir, whole=True).select("case_id", "passed", *shown)


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that failed, counted by why."""
    none = F.array().cast("array<string>")
    given = {
        "result_msg": F.lit("OK"), "forbidden": F.col("forbidden_matched"), "forbidden_answer": none, "unsupported": none, "missing_answer": F.col("missing_terms"),
        "answer_required": F.lit(True), "answer_verified": F.lit(False), "answer": F.lit(""),
    }
    return _verdicts(spark, sf_dir).filter("not passed").groupBy(selection.failure_category(given).alias("category")).agg(F.count(F.lit(1)).alias("cases"))


def heading_order(spark: SparkSession, sf_dir: str, q: str = "the") -> DataFrame:
    """Chunks by how closely the words lie in their own text, their title or their source."""
    score = selection.heading_score(F.lit(q), F.lower("chunk_text"), F.lower("title"), F.lower("agency_name"))
    return chunks(spark, sf_dir).select("chunk_id", score.alias("heading_score")).filter("heading_score > 0")


def searchable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes that may be found today, and whether they are only with those to come."""
    rows = audits.effective_version_status(spark, sf_dir).select("document_id", "effective_status")
    law = F.lit("law")
    found = rows.filter(selection.searchable(law, F.col("effective_status"), future=True))
    return found.withColumn("only_with_future", ~selection.searchable(law, F.col("effective_status")))


def recent_failures(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    return selection.recent(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts"), n, "ts", "event_id").drop("ts")


def point_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after an upsert, a delete and a change of status."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("payload"), F.lit("INDEXED").alias("status"))
    new = points.filter("point_id % 4 = 0").select((F.col("point_id") + 2).alias("point_id"), F.lit("new").alias("payload"), "status")
    gone = points.filter("point_id % 10 = 0").select("point_id")
    states = points.filter("point_id % 7 = 0").select("point_id", F.lit("STALE").alias("status"))
    return sinks.points_updated(points, new, gone, states)


QUERIES = {
    f.__name__: f
    for f in (
        keyword_index, anchored_documents, anchored_chunks, base_scores, case_verdicts, failure_categories, heading_order, searchable_documents, recent_failures,
        point_updates,
    )
}


def _form(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


_CHOSEN = f"""with {retrieval._INDEX}, {retrieval._ASKED}, {retrieval._HITS},
picked as (select query_id, list(term order by term) as terms, first(term order by document_frequency, term) as rarest from chosen group by 1)"""

_SELECTED = f"""{_CHOSEN},
titled as (select doc_id as document_id, {_form("string_split(text, chr(10))[1]")} as form, doc_id % 5 = 0 as provision from documents),
cand as (
  select distinct query_id, target, document_id, form = rarest as exact_title, provision
  from bm join picked using (query_id) join titled using (document_id)
  where bm.rank <= 50 and contains(form, rarest) and (query_id % 3 <> 0 or target = 'en')),
ordered as (
  select *, row_number() over w as n, lead(exact_title) over w as e2, lead(provision) over w as p2 from cand
  window w as (partition by query_id order by exact_title desc, provision desc, document_id, target)),
checked as (select *, bool_or(coalesce(n = 3 and exact_title = e2 and provision = p2, false)) over (partition by query_id) as unclear from ordered),
selected as (
  select query_id, case when unclear is null then 'DOCUMENT_NOT_FOUND' when unclear then 'DOCUMENT_MATCH_AMBIGUOUS' else 'APPLIED' end as status,
         case when not unclear then target end as target, case when not unclear then document_id end as document_id,
         case when not unclear then exact_title end as exact_title, case when not unclear then n end as selection_rank
  from picked left join (select * from checked where n = 1 or (n <= 3 and not unclear)) using (query_id))"""

_VERDICTS = f"""{_CHOSEN},
items as (
  select query_id, {_form("string_agg(chunk_text, chr(10) order by rank)")} as body, {_form("string_agg(title, chr(10) order by rank)")} as titles,
         {_form("first(chunk_text order by rank)")} as top
  from bm join chunks using (chunk_id) where rank <= 8 group by 1),
cases as (
  select query_id as case_id, rarest, titles, list_filter(terms, lambda t: contains(coalesce(body, ''), t)) as matched,
         list_filter(terms, lambda t: not contains(coalesce(body, ''), t)) as missing, coalesce(contains(body, 'toxic'), false) as bad,
         len(list_filter(terms, lambda t: contains(coalesce(top, ''), t))) as in_top, body is not null as any_item
  from picked left join items using (query_id)),
verdicts as (
  select case_id, any_item and len(matched) >= 2 and in_top > 0 and (case_id % 2 = 1 or contains(titles, rarest)) and not bad as passed,
         array_to_string(matched, ' ') as matched_terms, array_to_string(missing, ' ') as missing_terms, case when bad then 'toxic' else '' end as forbidden_matched
  from cases)"""

SQL = {
    "keyword_index": f"""with {CHUNKS_SQL},
        f as (select chunk_id, document_id, 'parent_title' as field_kind, 6 as weight, title as x from chunks
              union all select chunk_id, document_id, 'chunk_title', 7, agency_name from chunks union all select chunk_id, document_id, 'body', 4, chunk_text from chunks),
        t as (select * exclude x, lower(unnest(string_split_regex(x, '[^A-Za-z0-9]+'))) as term from f)
        select chunk_id, document_id, term, arg_max(field_kind, weight) as field_kind, max(weight) as weight from t where length(term) between 2 and 80 group by 1, 2, 3""",
    "anchored_documents": f"{_SELECTED} select * from selected",
    "anchored_chunks": f"""{_SELECTED},
        r as (select s.query_id, s.target, s.document_id, selection_rank, chunk_id, sort_order, sort_order = 2 as provision,
                     coalesce({_form('agency_name')} = rarest, false) or {_form('title')} = rarest as heading,
                     len(list_filter(terms, lambda t: contains({_form("concat_ws(' ', cast(sort_order as varchar), agency_name, title, chunk_text)")}, t))) as evidence
              from selected s join chunks c on c.target = s.target and c.document_id = s.document_id join picked p on p.query_id = s.query_id where status = 'APPLIED'),
        d as (select *, row_number() over (partition by query_id, target, document_id order by provision desc, heading desc, evidence desc, sort_order, chunk_id) as n from r qualify n <= 8),
        g as (select *, row_number() over (partition by query_id order by selection_rank, n) as rank from d qualify rank <= 24)
        select g.query_id, g.target, g.chunk_id, g.document_id, evidence, g.rank, b.rank is not null as overlaps,
               case when provision then 'EXACT_PROVISION' when heading then 'EXACT_HEADING' when evidence > 0 then 'EVIDENCE_TERMS' else 'DOCUMENT_ORDER' end as reason
        from g left join (select * from bm where rank <= 10) b on b.query_id = g.query_id and b.target = g.target and b.chunk_id = g.chunk_id""",
    "base_scores": _wholly(f"""{retrieval._FUSED},
        u as (select query_id, target, chunk_id, cast(term_score as double) as score from prefixed union all select query_id, target, chunk_id, score from bm where rank <= 20),
        c as (select query_id, target, chunk_id, max(score) as score from u group by all),
        j as (select query_id, target, chunk_id, c.score, f.score as rrf from c full outer join fused f using (query_id, target, chunk_id))
        select query_id, target, chunk_id, round(case when rrf is null then score else coalesce(max(score) over w, 0) + rrf / max(rrf) over w end, 6) as score
        from j window w as (partition by query_id)"""),
    "case_verdicts": _wholly(f"{_VERDICTS} select * from verdicts"),
    "failure_categories": f"""{_VERDICTS} select case when forbidden_matched <> '' then 'FORBIDDEN_EVIDENCE' when missing_terms <> '' then 'MISSING_ANSWER' else 'TRANSIENT_EMPTY_ANSWER' end as category,
        count(*) as cases from verdicts where not passed group by 1""",
    "heading_order": f"""with {CHUNKS_SQL}, l as (select chunk_id, lower(chunk_text) as a, lower(title) as b, lower(agency_name) as c from chunks)
        select chunk_id, case when a = 'the' then 9 when starts_with(a, 'the') then 8 when contains(a, 'the') then 7 when b = 'the' then 6 when starts_with(b, 'the') then 5
        when contains(b, 'the') then 4 when c = 'the' then 3 when starts_with(c, 'the') then 2 when contains(c, 'the') then 1 end as heading_score from l where contains(concat_ws(' ', a, b, c), 'the')""",
    "searchable_documents": f"""select document_id, effective_status, effective_status = 'FUTURE' as only_with_future
        from ({audits.SQL['effective_version_status']}) where effective_status in ('CURRENT', 'UNKNOWN', 'FUTURE')""",
    "recent_failures": "select event_id, user_id from events where event_type = 'error' order by ts desc, event_id desc limit 20",
    "point_updates": """
        with p as (select vec_id as point_id, cast(label as varchar) as payload from embeddings),
        n as (select point_id + 2 as point_id, 'new' as payload from p where point_id % 4 = 0),
        u as (select * from n union all select * from p where point_id not in (select point_id from n))
        select point_id, payload, case when point_id % 7 = 0 and point_id in (select point_id from p) then 'STALE' else 'INDEXED' end as status from u
        where not (point_id % 10 = 0 and point_id in (select point_id from p))""",
}
