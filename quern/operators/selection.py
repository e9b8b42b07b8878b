"""Choosing documents and chunks by anchors, scores of candidates, and verdicts on evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.terms import match_form
from quern.operators.audit import first_match

KEYS = ("query_id", "target", "chunk_id")


def searchable(target: Column, effective_status: Column, future: bool = False) -> Column:
    """Whether a document may be found: statutes only in force or of unknown date (or to come, if asked for), others always."""
    states = ["CURRENT", "UNKNOWN"] + (["FUTURE"] if future else [])
    return F.coalesce(~target.isin("law", "admrul"), F.lit(False)) | effective_status.isNull() | F.coalesce(effective_status.isin(*states), F.lit(False))


def page_request(target: str | None = None, query: str | None = None, page: int = 1, display: int = 20) -> dict:
    """A request within bounds: target law and query * where blank, page from 1, 1 to 100 rows."""
    page, display = max(page, 1), min(max(display, 1), 100)
    query = (query or "").strip() or "*"
    return {"target": (target or "").strip() or "law", "query": query, "page": page, "display": display, "offset": (page - 1) * display, "all": query == "*"}


def heading_score(query: Column, *headings: Column) -> Column:
    """Of headings from the closest to the widest: 3 each for equal, 2 for begins with, 1 for holds, plus 3 for each wider heading; 0 for none."""
    levels = []
    for i, heading in enumerate(reversed(headings)):
        held = first_match((heading == query, 3), (F.startswith(heading, query), 2), (F.contains(heading, query), 1))
        levels.insert(0, held.cast("int") + 3 * i)
    return F.coalesce(*levels, F.lit(0))


def recent(rows: DataFrame, n: int, *newest: str) -> DataFrame:
    """The n newest rows by the named columns, all descending."""
    return rows.orderBy(*[F.desc(c) for c in newest]).limit(n)


def anchored_documents(anchors: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """Documents whose title is one of a question's title terms, or holds all of them.

    anchors: (query_id, title_terms, targets), normal forms, targets null or
    empty for any; candidates: (query_id, target, document_id, title,
    provision_match), a document once or more.  Exact titles come first, then
    those that match the provision, then smaller ids.  Where the cut at ``most``
    falls between equals the question is ambiguous and gets none.  One row for
    each chosen document, and one with nulls for a question without any:
    (query_id, status, target, document_id, exact_title, selection_rank).
    """
    title = match_form(F.col("title"))
    anchors = anchors.withColumn("title_terms", F.filter("title_terms", lambda t: t != ""))
    rows = candidates.filter(F.col("document_id").isNotNull() & F.col("target").isNotNull()).join(anchors, "query_id")
    rows = rows.filter(F.coalesce(F.size("targets") <= 0, F.lit(True)) | F.array_contains("targets", F.col("target")))
    exact = F.coalesce(F.array_contains("title_terms", title), F.lit(False))
    holds = F.coalesce((F.size("title_terms") > 0) & F.forall("title_terms", lambda t: F.contains(title, t)), F.lit(False))
    rows = rows.select("query_id", "target", "document_id", exact.alias("exact_title"), holds.alias("all_terms"), F.coalesce("provision_match", F.lit(False)).alias("provision_match"))
    best = F.max(F.struct("exact_title", "all_terms", "provision_match")).alias("m")
    rows = rows.filter("exact_title or all_terms").groupBy("query_id", "target", "document_id").agg(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("m"), "document_id", "target")
    rows = rows.withColumn("selection_rank", F.row_number().over(order)).withColumn("next", F.lead("m").over(order))
    unclear = (F.col("selection_rank") == most) & F.coalesce(F.col("m") == F.col("next"), F.lit(False))
    rows = rows.withColumn("unclear", F.bool_or(unclear).over(Window.partitionBy("query_id"))).filter(F.col("selection_rank") <= most)
    rows = rows.filter(~F.col("unclear") | (F.col("selection_rank") == 1))
    shown = lambda c: F.when(~F.col("unclear"), F.col(c)).alias(c.split(".")[-1])
    rows = rows.select("query_id", "unclear", shown("target"), shown("document_id"), shown("m.exact_title"), shown("selection_rank"))
    found = anchors.select("query_id", "title_terms").join(rows, "query_id", "left")
    status = first_match(
        (F.coalesce(F.size("title_terms"), F.lit(0)) <= 0, "NO_STRONG_ANCHOR"), (F.col("unclear").isNull(), "DOCUMENT_NOT_FOUND"),
        (F.col("unclear"), "DOCUMENT_MATCH_AMBIGUOUS"), otherwise="APPLIED",
    )
    return found.select("query_id", status.alias("status"), "target", "document_id", "exact_title", "selection_rank")


def anchored_chunks(selected: DataFrame, chunks: DataFrame, anchors: DataFrame, seen: DataFrame | None = None, per_document: int = 8, total: int = 24) -> DataFrame:
    """Chunks of chosen documents: the provision asked for, then its headings, then by evidence terms held, then in order.

    selected: ``anchored_documents``; chunks: (document_id, target, chunk_id,
    chunk_no, chunk_title, parent_title, chunk_text, sort_order); anchors:
    (query_id, provision_terms, heading_terms, evidence_terms), normal forms.
    ``overlaps`` says which are among ``seen`` (query_id, target, chunk_id) already.
    """
    rows = selected.filter("status = 'APPLIED'").select("query_id", "target", "document_id", "selection_rank").join(chunks, ["target", "document_id"]).join(anchors, "query_id")
    whole = match_form(F.concat_ws(" ", "chunk_no", "chunk_title", "parent_title", "chunk_text"))
    provision = F.coalesce(F.array_contains("provision_terms", match_form(F.col("chunk_no"))), F.lit(False))
    heading = F.coalesce(F.arrays_overlap("heading_terms", F.array(match_form(F.col("chunk_title")), match_form(F.col("parent_title")))), F.lit(False))
    rows = rows.withColumn("whole", whole).withColumn("provision", provision).withColumn("heading", heading)
    rows = rows.withColumn("evidence", F.size(F.filter(F.coalesce("evidence_terms", F.array().cast("array<string>")), lambda t: F.contains("whole", t))))
    each = Window.partitionBy("query_id", "target", "document_id").orderBy(F.desc("provision"), F.desc("heading"), F.desc("evidence"), "sort_order", "chunk_id")
    rows = rows.withColumn("in_document", F.row_number().over(each)).filter(F.col("in_document") <= per_document)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("selection_rank", "in_document"))).filter(F.col("rank") <= total)
    reason = first_match((F.col("provision"), "EXACT_PROVISION"), (F.col("heading"), "EXACT_HEADING"), (F.col("evidence") > 0, "EVIDENCE_TERMS"), otherwise="DOCUMENT_ORDER")
    found = rows.select(*KEYS, "document_id", reason.alias("reason"), "evidence", "rank")
    if seen is None:
        return found.withColumn("overlaps", F.lit(False))
    old = seen.select(*KEYS).distinct().withColumn("overlaps", F.lit(True))
    return found.join(old, list(KEYS), "left").fillna(False, ["overlaps"])


def base_scores(vector: DataFrame, keyword: DataFrame, fused: DataFrame | None = None) -> DataFrame:
    """The greater of a candidate's vector and keyword score; with ``fused``, its hits come above all others by their share of the best.

    All three: (query_id, target, chunk_id, score), a key once or more (the greatest counts).
    """
    both = vector.select(*KEYS, "score").unionByName(keyword.select(*KEYS, "score"))
    rows = both.groupBy(*KEYS).agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    if fused is None:
        return rows
    # One grouping by key holds both scores; the two maxima of a question follow in one window.
    rows = rows.select(*KEYS, "score", F.lit(None).cast("double").alias("rrf")).unionByName(fused.select(*KEYS, F.lit(None).cast("double").alias("score"), F.col("score").alias("rrf")))
    rows = rows.groupBy(*KEYS).agg(F.max("score").alias("score"), F.max("rrf").alias("rrf"))
    of_query = Window.partitionBy("query_id")
    best, top = F.coalesce(F.max("score").over(of_query), F.lit(0.0)), F.max("rrf").over(of_query)
    lifted = best + F.when(top > 0, F.col("rrf") / top).otherwise(0.0)
    return rows.select(*KEYS, F.when(F.col("rrf").isNotNull(), lifted).otherwise(F.col("score")).alias("score"))


def case_verdicts(cases: DataFrame, items: DataFrame) -> DataFrame:
    """Whether each case passes, and the terms found.

    cases: (case_id, result_msg, required_matches, and arrays expected_terms,
    title_terms, section_types, document_terms, page_numbers, parent_terms,
    forbidden_terms, result_msgs; null and empty ask for nothing); items: the
    chunks that answer a case (case_id, rank, text, title_text, parent_text,
    section_type, page_no).  Terms are compared in normal form.  Required are
    the result, as many expected terms as asked for (one, if null) with one in
    the first item, any title, section, document and parent term, every page,
    and no forbidden term; a case that expects another result than OK needs
    that result and no forbidden term only.
    """
    lines = F.array_sort(F.collect_list(F.struct("rank", "text", "title_text", "parent_text", "section_type", "page_no")))
    cases = cases.join(items.groupBy("case_id").agg(lines.alias("items")), "case_id", "left")
    joined = lambda c: match_form(F.array_join(F.col(f"items.{c}"), "\n"))
    terms = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), match_form), lambda t: t != ""))
    for c in ("expected_terms", "title_terms", "section_types", "document_terms", "parent_terms", "forbidden_terms"):
        cases = cases.withColumn(c, terms(c))
    cases = cases.select(
        "*", joined("text").alias("all_text"), joined("title_text").alias("all_titles"), F.concat(joined("parent_text"), F.lit("\n"), joined("text")).alias("all_parents"),
        match_form(F.get("items.text", F.lit(0))).alias("top_text"), F.transform("items.section_type", match_form).alias("sections"),
    )
    held = lambda c, text: F.filter(c, lambda t: F.contains(F.coalesce(text, F.lit("")), t))
    any_of = lambda c, text: (F.size(c) == 0) | (F.size(held(c, text)) > 0)
    none = F.array().cast("array<string>")
    wanted = F.transform(F.coalesce("result_msgs", none), match_form)
    ok = (F.size(wanted) == 0) | F.array_contains(wanted, "ok")
    result = F.when(F.size(wanted) == 0, F.coalesce(F.col("result_msg") == "OK", F.lit(False))).otherwise(F.array_contains(wanted, match_form(F.col("result_msg"))))
    pages = F.size(F.array_except(F.coalesce("page_numbers", none), F.coalesce(F.col("items.page_no").cast("array<string>"), none))) == 0
    enough = F.size(held("expected_terms", F.col("all_text"))) >= F.greatest(F.lit(0), F.coalesce("required_matches", F.when(F.size("expected_terms") > 0, 1).otherwise(0)))
    sections = (F.size("section_types") == 0) | F.coalesce(F.arrays_overlap("section_types", "sections"), F.lit(False))
    evidence = (
        F.col("items").isNotNull() & enough & any_of("expected_terms", F.col("top_text")) & any_of("title_terms", F.col("all_titles")) & sections
        & any_of("document_terms", F.col("all_titles")) & pages & any_of("parent_terms", F.col("all_parents"))
    )
    forbidden = held("forbidden_terms", F.col("all_text"))
    return cases.select(
        "case_id", (result & (~ok | evidence) & (F.size(forbidden) == 0)).alias("passed"), held("expected_terms", F.col("all_text")).alias("matched_terms"),
        F.array_except("expected_terms", held("expected_terms", F.col("all_text"))).alias("missing_terms"), forbidden.alias("forbidden_matched"),
    )


def failure_category(c: dict[str, Column]) -> Column:
    """Why a case failed, by its lists of forbidden, unsupported and missing terms and its answer."""
    some = lambda *names: F.coalesce(*[F.when(F.size(c[n]) > 0, True) for n in names], F.lit(False))
    empty = F.coalesce(c["answer_required"], F.lit(False)) & ~F.coalesce(c["answer_verified"], F.lit(True)) & (F.trim(F.coalesce(c["answer"], F.lit(""))) == "")
    return first_match(
        (c["result_msg"] == "NO_GROUNDS", "NO_GROUNDS"), (some("forbidden", "forbidden_answer"), "FORBIDDEN_EVIDENCE"), (some("unsupported"), "UNSUPPORTED_ANSWER"),
        (some("missing_answer"), "MISSING_ANSWER"), (empty, "TRANSIENT_EMPTY_ANSWER"), otherwise="OTHER",
    )


# What the frozen baseline of 24 training cases reaches.
BASELINE = {"cases": 24, "all_required": 7, "any_required": 14, "matched_groups": 22}


def expansion_verdict(cases: DataFrame, baseline: dict[str, int] = BASELINE) -> DataFrame:
    """One row: whether expansion may replace its control, over (run, case_id, required_groups, control, expanded), the last two arrays of groups found."""
    full = lambda c: F.size(F.array_distinct(c)) == F.col("required_groups")
    measures = [
        m for c in ("control", "expanded")
        for m in (F.count_if(full(c)).alias(f"{c}_all"), F.count_if(F.size(c) > 0).alias(f"{c}_any"), F.sum(F.size(F.array_distinct(c))).alias(f"{c}_groups"))
    ]
    runs = cases.groupBy("run").agg(F.count(F.lit(1)).alias("cases"), *measures, F.count_if(full("control") & ~full("expanded")).alias("lost"))
    kept = (F.col("cases") == baseline["cases"]) & (F.col("control_all") == baseline["all_required"]) & (F.col("control_any") == baseline["any_required"])
    kept = kept & (F.col("control_groups") == baseline["matched_groups"]) & (F.col("lost") == 0)
    better = F.col("expanded_all") > F.greatest(F.lit(baseline["all_required"]), F.col("control_all"))
    good = (F.col("expanded_any") >= baseline["any_required"]) & (F.col("expanded_groups") >= baseline["matched_groups"])
    whole = runs.agg(F.count(F.lit(1)).alias("runs"), F.bool_and(kept).alias("kept"), F.bool_and(better).alias("better"), F.bool_and(good).alias("good"))
    status = first_match(
        (F.col("runs") != 2, "INVALID_CAPTURE"), (~F.col("kept"), "BASELINE_REGRESSION"), (~F.col("better"), "NO_DOCUMENT_EXPANSION_IMPROVEMENT"),
        (~F.col("good"), "DOCUMENT_EXPANSION_QUALITY_REGRESSION"), otherwise="ELIGIBLE_FOR_DIFFICULT_EVAL",
    )
    return whole.select("runs", status.alias("status"))
