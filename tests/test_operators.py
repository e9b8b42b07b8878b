"""Operators on literal rows with known results."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import claims, cleaning, expansion, terms
from quern.functions.cleaning import compact
from quern.operators import audit, chunking, evaluation, evidence, lexical, ranking, selection
from quern.plans import audits, retrieval
from quern.sources import folders, payloads, sinks
from quern.sources.tables import chunks
from quern.streaming import refresh


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("제５５조 ＡＩ 검사 검사", {"제55조": 1, "ai": 1, "검사": 2}),
        ("어떻게 알려줘 계약금액 1,000만원 지급기한 30일 이내", {"계약금액": 1, "1000만원": 1, "지급기한": 1, "30일": 1, "이내": 1}),
        ("élan VITAL x 1,2,3", {"lan": 1, "vital": 1, "123": 1}),
        ("", {}),
        (None, {}),
    ],
)
def test_index_terms(spark, text, want):
    got = terms.term_counts(text)
    assert got == want
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(terms.terms_of(F.col("t"))).alias("x")).groupBy("x").count()
    assert {r["x"]: r["count"] for r in df.collect()} == want


def test_base_form_cuts_until_nothing_changes():
    assert terms.base_form("계약이란") == "계약"
    assert terms.base_form("과업심의를") == "과업심의"
    assert terms.base_form("사전협의") == "사전협의"
    assert terms.is_weak("어떻게") and terms.is_weak(" ") and not terms.is_weak("계약")


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, target string, chunk_id long, rank int")


def test_rrf_goldens(spark):
    v = _ranked(spark, [(1, "law", 10, 1), (1, "law", 20, 2), (1, "admrul", 30, 3)])
    x = _ranked(spark, [(1, "law", 20, 1), (1, "admrul", 30, 2), (1, "law", 10, 3)])
    rows = ranking.rrf(v, x).orderBy("rank").collect()
    assert [(r["target"], r["chunk_id"]) for r in rows] == [("law", 20), ("law", 10), ("admrul", 30)]
    assert (rows[0]["vector_rank"], rows[0]["lexical_rank"]) == (2, 1)
    ties = ranking.rrf(v.limit(0), _ranked(spark, [(1, "law", 20, 1), (1, "admrul", 30, 1), (1, "law", 10, 1)])).orderBy("rank").collect()
    assert [(r["target"], r["chunk_id"]) for r in ties] == [("admrul", 30), ("law", 10), ("law", 20)]
    again = ranking.rrf(_ranked(spark, [(1, "law", 1, 1), (1, "law", 1, 2), (1, "law", 2, 3)]), x.limit(0), limit=1).collect()
    assert [(r["chunk_id"], r["vector_rank"]) for r in again] == [(1, 1)]
    assert ranking.rrf(v, x, w_vector=0).filter("vector_rank is not null").count() == 0


def test_bm25_order_and_limits(spark):
    t = spark.createDataFrame([("law", 10, 1, "a", "body", 5, 1), ("law", 20, 2, "b", "body", 8, 1), ("law", 30, 3, "c", "body", 10, 1)], "target string, chunk_id long, document_id long, term string, field_kind string, tf int, weight int")
    lengths = spark.range(100).select(F.lit("law").alias("target"), F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit(100).alias("weighted_length"))
    asked = spark.createDataFrame([(1, "a", 2), (1, "b", 50), (1, "c", 99)], "query_id int, term string, document_frequency long")
    assert [r["chunk_id"] for r in lexical.bm25(asked, t, lengths).orderBy("rank").collect()] == [10, 20, 30]
    none = spark.createDataFrame([(1, "admrul")], "query_id int, target string")
    assert lexical.bm25(asked, t, lengths, targets=none).count() == 0
    many = spark.createDataFrame([(1, " ".join(f"w{i:02}" for i in range(30)))], "query_id int, question string")
    assert lexical.query_terms(many).count() == 24
    stats = spark.createDataFrame([("a", 3990), ("b", 4000), ("c", 1)], "term string, document_frequency long")
    picked = lexical.selected_terms(spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "b", 0)], "query_id int, term string, pos int"), stats)
    assert {(r["query_id"], r["term"]) for r in picked.collect()} == {(1, "c"), (1, "a"), (2, "b")}


def test_coverage_states(spark):
    rows = [(1, "law", i, i // 2, 1.0 / i, i if i % 2 else None, i if i in (1, 2, 6) or not i % 2 else None, i, i) for i in range(1, 9)]
    fused = spark.createDataFrame(rows, "query_id int, target string, chunk_id long, document_id long, score double, vector_rank int, lexical_rank int, best_source_rank int, rank int")
    off = ranking.coverage_rescue(fused, top_k=4, enabled=False)
    assert off.count() == 8 and {r["state"] for r in off.collect()} == {"DISABLED"}
    fused = fused.withColumn("document_id", F.when(F.col("chunk_id").isin(1, 7), 1).otherwise(F.col("chunk_id") + 100))
    on = ranking.coverage_rescue(fused, top_k=4).orderBy("final_rank").collect()
    assert [r["chunk_id"] for r in on] == [1, 2, 3, 7] and {r["state"] for r in on} == {"APPLIED"}


def test_quota_and_merge(spark):
    ranked = _ranked(spark, [(1, "ab"[i % 2], i, i) for i in range(1, 13)])
    got = ranking.target_quota(ranked, per_target=2, priority=2, limit=6).orderBy("quota_rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6]
    a = ranked.filter("rank <= 2").withColumn("score", F.lit(1.0))
    b = ranked.filter("rank between 2 and 3").withColumn("score", F.lit(2.0))
    assert [(r["chunk_id"], r["source"]) for r in ranking.merged(a, b).orderBy("merged_rank").collect()] == [(1, 0), (2, 0), (3, 1)]


def test_diversified_is_greedy(spark):
    rows = [(1, 1, "k1", "same text"), (1, 2, "k1", "other"), (1, 3, "k2", "same text"), (1, 4, "k3", "other"), (1, 5, "k4", ""), (1, 6, "k5", "")]
    df = spark.createDataFrame(rows, "query_id int, rank int, exact_key string, compact_text string")
    assert sorted(r["rank"] for r in ranking.diversified(df).collect()) == [1, 4, 5, 6]


def test_quality_gate_order(spark):
    long = "이 조항은 계약의 체결과 이행에 관한 사항을 정하고 당사자의 의무와 책임을 자세히 규정하는 것을 목적으로 하며 필요한 절차를 포함한다 " * 3
    rows = [(1, 1, 0, "제목", ""), (1, 2, 1, "제목", long), (1, 3, 2, "제목", long), (1, 4, 3, "제목", "Click the menu to download"), (1, 5, 4, "아주 긴 제목을 가진 문서", "아주 긴 제목을 가진 문서"),
            (1, 6, 5, "제목", "계약 기간은 삼 년으로 한다."), (1, 7, 6, "제목", "- 3 -"), (1, 8, 7, "제목", "요구사항 분류: 보안 항목 이름")]
    df = spark.createDataFrame(rows, "document_id long, chunk_id long, sort_order int, title string, chunk_text string")
    got = {r["chunk_id"]: (r["status"], r["reason"]) for r in audit.quality_gate(df).collect()}
    assert got[1] == ("REJECT", "EMPTY_TEXT") and got[2][0] == "PASS" and got[3] == ("REJECT", "DUPLICATE_TEXT")
    assert got[4][1].startswith("NAVIGATION") and got[5] == ("CONTEXT_ONLY", "TITLE_OR_HEADING_ONLY")
    assert got[6] == ("PASS", "SHORT_COMPLETE_STATEMENT") and got[7] == ("REJECT", "MEANINGLESS_FRAGMENT")


def _nodes(node, name):
    children = [node.children().apply(i) for i in range(node.children().size())]
    return ([node] if node.nodeName() == name else []) + [n for c in children for n in _nodes(c, name)]


def _output(node):
    return {node.output().apply(i).name() for i in range(node.output().size())}


def test_quality_gate_moves_digests(spark):
    rows = [(1, 1, 0, "Title", "Same words, said twice in here."), (1, 2, 1, "Title", "same WORDS said twice in here"), (None, 3, 0, None, "a lone <b>line</b> of words"), (1, 4, 2, "Title", "p. 1\u2028"),
            (1, 5, 3, "Title", "...... Contents of this whole book"), (1, 6, 4, "Title", "계약을 정한다\r끝났다."), (2, 7, 0, "Title", None)]
    got = audit.quality_gate(spark.createDataFrame(rows, "document_id long, chunk_id long, sort_order int, title string, chunk_text string"))
    window = _nodes(got._jdf.queryExecution().optimizedPlan(), "Window")[0]
    assert not _output(window.children().apply(0)) & {"chunk_text", "title", "seen", "low", "body", "head"}
    assert {r["chunk_id"]: r["reason"] for r in got.collect()} == {
        1: "SHORT_AMBIGUOUS", 2: "DUPLICATE_TEXT", 3: "SHORT_AMBIGUOUS", 4: "MEANINGLESS_FRAGMENT", 5: "TABLE_OF_CONTENTS", 6: "SHORT_AMBIGUOUS", 7: "EMPTY_TEXT"}


def test_a_title_is_made_once_a_document(spark):
    found = chunks(spark, "/root/testdata/sf0.001", F.upper(F.split("text", "\n")[0]).alias("loud")).select("chunk_id", "title", "loud", "chunk_text")
    generate = _nodes(found._jdf.queryExecution().optimizedPlan(), "Generate")[0]
    assert {"title", "loud"} <= _output(generate.children().apply(0)) and "text" not in _output(generate)


def test_short_classes(spark):
    rows = [("<img src='a'>",), ("<개정 2020.1.1>",), ("제3조에 따라 제출하여야 한다",), ("12.3",), ("hello",), ("자세한 내용은 첨부파일을 확인하십시오",)]
    df = spark.createDataFrame(rows, "t string").select("t", audit.short_class(F.col("t")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[0] == "image_only" and got[2:5] == ["meaningful_short_evidence", "layout_number", "ambiguous_short"] and got[5] == "navigation_notice"


def test_dates_and_keys(spark):
    df = spark.createDataFrame([("시행 2024-02-29",), ("20240230",), ("2024",), (None,)], "d string")
    got = [tuple(r) for r in df.select(cleaning.effective_date(F.col("d")), cleaning.shown_date(F.col("d"))).collect()]
    assert got == [("20240229", "2024. 2. 29."), (None, "20240230"), (None, "2024"), (None, None)]
    keys = spark.createDataFrame([("law", "도로 교통법!"), ("law", "--")], "t string, n string").select(cleaning.canonical_key(F.col("t"), F.col("n")))
    assert [r[0] for r in keys.collect()] == ["law:도로교통법", "law:unknown"]


def test_page_text(spark):
    html = "<html><script>x<b</script><p>One &amp; two</p><br>Three<style>p{}</style><div> </div><li>four</li>"
    assert spark.createDataFrame([(html,)], "h string").select(cleaning.page_text(F.col("h"))).first()[0] == "One & two\nThree\nfour"


def test_chunkers(spark):
    text = "\n\n".join(f"{i}. heading\n" + "word " * 150 for i in range(1, 8)) + "\n\nshort"
    cut = chunking.cut_page(text)
    assert all(len(c) <= chunking.PAGE_MOST + chunking.PAGE_LEAST for c in cut) and cut[-1].endswith("short")
    assert "".join("".join(cut).split()) == "".join(text.split())
    long = chunking.cut_page("x" * 5000)
    assert len(long) > 2 and chunking.cut_page(None) == [] and chunking.cut_page(" \n ") == []
    plan = chunking.plan_sections([("a", "가" * 500), ("a", "나" * 500), ("b", "다" * 100), ("c", "라" * 3000), ("d", " ")])
    assert all(len(t) <= chunking.CHILD_MOST for _, t in plan) and "".join(t for _, t in plan).count("다") == 100
    kept = chunking.plan_sections([("a", "가" * 500), ("b", "다" * 100)], keep_parents=True)
    assert [k for k, _ in kept] == ["a", "b"]


def test_section_kinds(spark):
    rows = [("", "목차", ""), ("", "지원 대상", ""), ("", "개요", "제출 서류는 다음과 같다"), ("", "개요", "신청 방법"), ("", "a", "b")]
    df = spark.createDataFrame(rows, "p string, h string, t string").select(chunking.section_kind(F.col("p"), F.col("h"), F.col("t")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["toc", "target_scope", "requirement", "procedure", "body"]


def test_organisations(spark):
    rows = spark.createDataFrame([(1, "t1", "행정안전부 고시", "x"), (2, "t2", "", "y"), (3, "t3", "", "z")], "document_id long, title string, text string, agency_name string")
    forced = spark.createDataFrame([(2, "조달청", "t2"), (3, "조달청", "no")], "document_id long, organisation string, guard string")
    got = {r["document_id"]: (r["organisation"], r["confidence"]) for r in chunking.inferred_organisation(rows, forced).collect()}
    assert got == {1: ("행정안전부", "medium"), 2: ("조달청", "high"), 3: ("조달청", "review")}


def test_payloads(spark):
    answer = {"LawSearch": {"resultCode": "00", "law": [{"법령명한글": " 도로교통법 ", "법령일련번호": "7", "시행일자": "20240101"}, {"제목": ""}], "extra": {"id": "9"}}}
    rows = spark.createDataFrame([("law", json.dumps(answer, ensure_ascii=False)), ("law", "not json"), ("law", None)], "target string, payload string")
    got = {r["external_id"]: (r["title"], r["effective_date"], r["canonical_key"]) for r in payloads.search_documents(rows).collect()}
    assert got["7"] == ("도로교통법", "20240101", "law:도로교통법") and got["9"][0] == "law-9" and len(got) == 3
    assert payloads.sections_of(json.dumps({"sections": [{"type": "a", "content": " b "}]})) == [{"type": "a", "no": None, "title": None, "body": "b"}]
    found = payloads.sections_of(json.dumps({"a": ["short", {"b": "x" * 30}], "c": "y" * 25}))
    assert [(s["title"], s["body"][0]) for s in found] == [("$.a[1].b", "x"), ("$.c", "y")]


def test_files_round_trip(spark, tmp_path):
    sinks.write_requests(spark.createDataFrame([("1:a", "text")], "custom_id string, input string"), f"{tmp_path}/req", "m")
    assert spark.read.json(f"{tmp_path}/req").first()["body"]["input"] == "text"
    (tmp_path / "out.jsonl").write_text('{"custom_id":"1","response":{"status_code":200,"body":{"data":[{"embedding":[0.5,1]}]}}}\n{"custom_id":"2","error":{"message":"no"}}\n')
    got = {r["custom_id"]: (r["embedding"], r["error"]) for r in sinks.read_responses(spark, f"{tmp_path}/out.jsonl").collect()}
    assert got == {"1": ([0.5, 1.0], None), "2": (None, "no")}
    (tmp_path / "cases.tsv").write_text('c1\t"two\nlines"\tx\nshort\n', encoding="utf-8")
    assert [tuple(r) for r in sinks.read_cases(spark, f"{tmp_path}/cases.tsv", ["id", "question", "terms"], least=3).collect()] == [("c1", "two\nlines", "x")]


def test_document_chunks_pass_headings_from_page_to_page(spark):
    body = "이 조항은 대상기관에 적용한다. " * 30
    pages = [
        (1, 2, "앞의 조에서 이어지는 내용\n" + body), (1, 1, f"제1조 목적\n{body}"), (1, 3, "목차\n제1조 ..... 1\n제2조 ..... 2"), (1, 4, "제2조 대상은\n\n대상기관이 추진하는 모든 정보화사업이다.\n\n-----\n\n" + body),
        (2, None, "no heading here\n" + "word " * 300), (2, None, None), (3, 1, " \n\n*** \n"), (None, 1, "제9조 기타\n" + body),
    ]
    got = chunking.document_chunks(spark.createDataFrame(pages, "document_id long, page_no int, text string")).collect()
    one = sorted((r for r in got if r["document_id"] == 1), key=lambda r: r["chunk_order"])
    assert [r["chunk_order"] for r in one] == list(range(len(one))) and [r["page_no"] for r in one] == sorted(r["page_no"] for r in one)
    assert {r["page_no"]: r["parent_title"] for r in one} == {1: "제1조 목적", 2: "제1조 목적", 4: "제2조 대상은"}
    (lead,) = [r for r in one if r["chunk_text"].startswith("제2조")]
    assert lead["chunk_text"].startswith("제2조 대상은\n대상기관이 추진하는") and "-----" not in lead["chunk_text"]
    two = [r for r in got if r["document_id"] == 2]
    assert [r["chunk_no"] for r in two] == ["chunk 1"] and two[0]["parent_title"] == two[0]["chunk_title"] == "no heading here"
    assert not [r for r in got if r["document_id"] == 3] and [r["parent_title"] for r in got if r["document_id"] is None] == ["제9조 기타"]
    assert all(len(r["chunk_text"]) <= chunking.PAGE_MOST + chunking.PAGE_LEAST for r in got)


def test_weights_are_chosen_where_two_runs_agree(spark):
    def rows(run, weights, *met):
        return [(run, *weights, i, m, 2) for i, m in enumerate(met)]

    base, x, y = (1.0, 1.0), (1.0, 0.5), (0.5, 1.0)
    schema = "run int, w_first double, w_second double, case_id long, met long, required long"

    def chosen(*parts):
        df = spark.createDataFrame([r for p in parts for r in p] + [(1, *base, 99, 0, 0)], schema)
        return {(r["w_first"], r["w_second"]): r for r in evaluation.selected_weights(df).collect()}

    got = chosen(rows(1, base, 2, 1, 0), rows(2, base, 2, 1, 1), rows(1, x, 2, 2, 0), rows(2, x, 2, 2, 1), rows(1, y, 0, 2, 2), rows(2, y, 2, 1, 1))
    assert {w: (r["chosen"], r["status"]) for w, r in got.items()} == {base: (False, "RECOMMENDED"), x: (True, "RECOMMENDED"), y: (False, "RECOMMENDED")}
    assert (got[x]["all_required"], got[x]["any_required"], got[x]["groups"], got[x]["eligible"], got[x]["reasons"]) == (2, 2, 4, True, [])
    assert got[y]["reasons"] == ["RUN1:BASELINE_CASE_REGRESSION:0", "RUN2:ALL_REQUIRED_NOT_IMPROVED:1/1"] and got[base]["reasons"] == ["RUN1:BASELINE", "RUN2:BASELINE"]
    # Two runs with different winners, then none that improves.
    apart = chosen(rows(1, base, 0, 0), rows(2, base, 0, 0), rows(1, x, 2, 0), rows(2, x, 0, 0), rows(1, y, 0, 0), rows(2, y, 0, 2))
    assert [w for w, r in apart.items() if r["chosen"]] == [base] and {r["status"] for r in apart.values()} == {"NO_STABLE_TRAINING_IMPROVEMENT"}
    none = chosen(rows(1, base, 2, 2), rows(2, base, 2, 2), rows(1, x, 2, 0), rows(2, x, 2, 2))
    assert [w for w, r in none.items() if r["chosen"]] == [base] and none[x]["status"] == "NO_TRAINING_IMPROVEMENT"
    assert none[x]["reasons"] == ["RUN1:ALL_REQUIRED_NOT_IMPROVED:1/2", "RUN1:BASELINE_CASE_REGRESSION:1", "RUN1:ANY_REQUIRED_REGRESSION:1/2", "RUN2:ALL_REQUIRED_NOT_IMPROVED:2/2"]


def test_tiny_sections_join_or_share_a_neighbour():
    full, half = "문장이 이어진다. " * 249, "짧은 문장. " * 150
    assert len(full) > chunking.CHILD_MOST - 40 and len(full.strip()) <= chunking.CHILD_MOST
    tiny = "끝에 남은 아주 짧은 항목이며 앞의 것에 붙을 자리가 없어 나누어야 하는 것"
    got = chunking.plan_sections([("a", full), ("b", tiny)])
    assert [k for k, _ in got] == ["a", "a"] and all(chunking.TINY <= len(t) <= chunking.CHILD_MOST for _, t in got)
    assert "".join("".join(t for _, t in got).split()) == "".join((full + tiny).split()) and abs(len(got[0][1]) - len(got[1][1])) < chunking.CHILD_LEAST
    assert [k for k, _ in chunking.plan_sections([("a", half), ("b", tiny)])] == ["a"]
    assert [(k, len(t) < chunking.TINY) for k, t in chunking.plan_sections([("a", full), ("b", tiny)], keep_parents=True)] == [("a", False), ("b", True)]
    assert chunking.plan_sections([("a", tiny)]) == [("a", tiny)] and chunking.plan_sections([]) == []
    first = chunking.plan_sections([("a", tiny), ("b", full)])
    assert len(first) == 2 and all(len(t) >= chunking.TINY for _, t in first)


def test_long_blocks_keep_their_heading():
    text = "제3조 절차\n" + "신청서를 제출하여야 한다. " * 400
    cut = chunking.cut_page(text)
    assert len(cut) > 2 and all(c.startswith("제3조 절차") for c in cut) and all(len(c) <= chunking.PAGE_MOST for c in cut)


def test_vector_search_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = [(["a", "b", None][i % 3], i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)] + [("a", 900, None), ("a", 901, [0.0] * 4), ("b", 902, [float("nan"), 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(vectors, "target string, chunk_id long, vector array<double>")
    q = v.filter("chunk_id % 9 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    good = [(t, i, np.array(x)) for t, i, x in vectors[:90] if any(x)]
    want = set()
    for t, i, x in [g for g in good if g[1] % 9 == 0]:
        near = [(-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), u or "", j) for u, j, y in good]
        best = sorted(n for u in ("", "a", "b") for n in sorted([n for n in near if n[1] == u], key=lambda n: (n[0], n[2]))[:3])[:7]
        want |= {(i, r + 1, u or None, j, -s) for r, (s, u, j) in enumerate(best)}
    for sent in (8192, 2):
        got = {(r["query_id"], r["rank"], r["target"], r["chunk_id"], r["score"] + 0.0) for r in ranking.vector_search(q, v, per_target=3, total=7, sent=sent).collect()}
        assert {(a, b, c, d, round(x, 6)) for a, b, c, d, x in got} == {(a, b, c, d, round(x, 6)) for a, b, c, d, x in want}


def test_polarity(spark):
    cases = [
        ("계약은 가능하다. 신청은 필요없다", "신청은 필요없다", True), ("신청은 필요없다", "신청은 필요", False), ("신청은 필요하다", "신청은 필요", True), ("", "x", False), ("x", None, False), (None, "x", False),
        ("출입은 금지가 아니라고 할 수 없다", "출입은 금지", True), ("출입은 금지가 아니다", "출입은 금지", False), ("대상이라고는 할 수 없습니다", "대상", False),
        ("대상이 아니다. 하지만 실제로는 대상입니다", "대상", True), ("대상입니다 하지만 결국 대상이 아니다", "대상", False), ("신청 대상 하지만 승인 대상이 아니다", "신청 대상", True),
        ("금액은 3.5 이다", "금액은 3.5", True), ("허가를 받지 않아도 된다", "허가를 받지 않", True), ("허가를 받지", "허가를 받지 않", False),
        ("권한을 관리자가 부여한다", "권한 부여", True), ("권한을 관리자가 부여하지 않는다", "권한 부여", True), ("권한을 관리자가 부여 안된다", "권한 부여", False),
    ]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(cases)], "i int, a string, e string")
    got = {r["i"]: r["s"] for r in df.select("i", evidence.states(F.col("a"), F.col("e")).alias("s")).collect()}
    assert [i for i, c in enumerate(cases) if got[i] != c[2]] == []


def test_claims_need_the_same_polarity(spark):
    a = spark.createDataFrame([("k", "신청 서류 제출 대상이다. 사업 계약 대상이 아니다.")], "key string, answer string")
    e = spark.createDataFrame([("k", "신청 서류 제출 대상이 아니다."), ("k", "사업 계약 대상이 아니다.")], "key string, evidence string")
    got = {r["claim_no"]: (r["supported"], r["shared"]) for r in evidence.verified_claims(a, e).collect()}
    assert got[1][0] and not got[0][0] and got[0][1] < got[1][1]


def test_contained_short_equals_pairs(spark):
    import random

    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 60))) for _ in range(60)]
    lines += [x[10:110] for x in lines[:20]] + [" - " * 40 + "ab", " . " * 50 + "xaby", "abc " * 25, "abc " * 40, "한글 " * 30, "한글 " * 60, ""]
    rows = [(d, d * 1000 + i, x) for d in (1, 2) for i, x in enumerate(lines)] + [(1, 5000, lines[0])]
    df = spark.createDataFrame(rows, "document_id long, chunk_id long, chunk_text string")
    bodies = {r["chunk_id"]: r["b"] for r in df.select("chunk_id", compact(F.col("chunk_text")).alias("b")).collect()}
    want = {}
    for d, c, x in rows:
        held = [h for e, h, y in rows if e == d and len(y) > len(x) and bodies[c] in bodies[h]]
        if 80 <= len(x) < 800 and bodies[c] and held:
            want[(d, c)] = min(held)
    assert len(want) > 30 and {(r["document_id"], r["chunk_id"]): r["holder_id"] for r in audit.contained_short(df).collect()} == want
    packed = df.groupBy("document_id").agg(F.collect_list(F.struct("chunk_id", "chunk_text")).alias("chunks"))
    found = audit.contained_short_lines(packed)
    assert {(r["document_id"], r["chunk_id"]): r["holder_id"] for r in found.collect()} == want
    for sought in (1 << 20, 0):  # as it is, and by an index of runs
        audit.SOUGHT, before, got = sought, audit.SOUGHT, {}
        for document in (1, 2):
            own = [(c, len(x), bodies[c]) for d, c, x in rows if d == document]
            got |= {(document, c): h for c, h in audit._holders(*map(list, zip(*own)), 80, 800)}
        audit.SOUGHT = before
        assert got == want
    assert "Exchange" not in audit.contained_short_lines(df.select("document_id", F.array(F.struct("chunk_id", "chunk_text")).alias("chunks")))._jdf.queryExecution().executedPlan().toString()


def test_contained_short_duplicates_with_repeated_ids(spark, tmp_path):
    """Documents of one id are compared with one another, null ids with nothing."""
    line = "a line of some length that is sought in other lines of the same document, alpha beta gamma"
    rows = [(1, line), (1, f"x {line} y"), (2, f"{line}\nx {line} y"), (None, f"{line}\nx {line} y"), (3, line)]
    spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in audits.contained_short_duplicates(spark, str(tmp_path)).select("document_id", "chunk_id", "holder_id").collect()}
    assert got == {(1, 1000000, 1000000), (2, 2000000, 2000001)}


def _tree_by_hand(leaves, bucket):
    import hashlib
    import math

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    depth = max(0, math.ceil(math.log(max(1, len(leaves)) / bucket, 16)))

    def node(prefix):
        own = [x for x in leaves if sha(x[0]).startswith(prefix)]
        if not own and prefix:
            return None
        if len(prefix) == depth:
            return sha("\n".join(f"{k}={h}" for k, h in sorted(own)))
        return sha("\n".join(f"{c}:{x}" for c in "0123456789abcdef" if (x := node(prefix + c))))

    return node(""), depth


def test_merkle_tree_equals_a_sequential_one_and_shows_changes(spark, monkeypatch):
    monkeypatch.setattr(audit, "BUCKET", 2)
    for n in (0, 1, 2, 40, 300):
        leaves = [(f"k{i}", f"h{i % 7}") for i in range(n)]
        tree = audit.merkle_tree(spark.createDataFrame(leaves, "key string, hash string"))
        root = tree.filter("level = 0").collect()
        assert [(r["hash"], r["leaves"]) for r in root] == [(_tree_by_hand(leaves, 2)[0], n)] and tree.agg(F.max("level")).first()[0] == _tree_by_hand(leaves, 2)[1]
    old = spark.createDataFrame([(f"k{i}", f"h{i}") for i in range(200)], "key string, hash string")
    new = old.filter("key not in ('k3', 'k4')").withColumn("hash", F.when(F.col("key") == "k5", F.lit(None)).otherwise(F.col("hash"))).unionByName(spark.createDataFrame([("k900", "x")], old.schema))
    before, after = audit.merkle_tree(old), audit.merkle_tree(new)
    got = {(r["key"], r["change"]) for r in audit.changed_leaves(before, after, old, new).collect()}
    assert got == {("k3", "REMOVED"), ("k4", "REMOVED"), ("k5", "CHANGED"), ("k900", "ADDED")}
    assert audit.changed_leaves(before, before, old, old).collect() == []


def test_claims(spark):
    a = spark.createDataFrame([(1, "The fee is 30 euros here. Nothing alike.")], "key int, answer string")
    e = spark.createDataFrame([(1, "A fee of 30 euros is due."), (1, "The fee is 40 euros here.")], "key int, evidence string")
    got = [(r["claim_no"], r["shared"], r["supported"]) for r in evidence.verified_claims(a, e).orderBy("claim_no").collect()]
    assert got == [(0, 4, True), (1, 0, False)]
    claims = evidence.verified_claims(a, e)
    assert evidence.repaired_answers(a, claims).first()["answer"] == "The fee is 30 euros here."


def test_rules_and_profiles(spark):
    rules = spark.createDataFrame([(1, ["a", "b"], 0.5), (2, ["z"], 9.0)], "rule_id int, terms array<string>, weight double")
    rows = spark.createDataFrame([("a b",), ("a",)], "t string")
    assert [r["rule_score"] for r in evidence.with_rules(rows, "t", rules).orderBy(F.desc("t")).collect()] == [0.5, 0.0]
    assert [r[0] for r in rows.select(evidence.in_profile(F.col("t"), [["a"], ["b", "c"]])).collect()] == [True, False]
    assert rows.select(evidence.term_match(F.lit("blue green car"), F.lit("blue car van"))).first()[0]


def test_presence_classes(spark):
    cases = spark.createDataFrame([(1, 0), (2, 2), (3, 2), (4, 2), (5, 2)], "query_id int, groups int")
    m = [(3, "lexicalHits", 0), (4, "lexicalHits", 0), (4, "vectorHits", 1), (4, "merged", 0), (4, "merged", 1), (4, "fused", 0)]
    m += [(5, s, g) for s in ("lexicalHits", "merged", "fused", "selected") for g in (0, 1)]
    got = {r["query_id"]: (r["classification"], r["first_loss_stage"]) for r in evaluation.presence(spark.createDataFrame(m, "query_id int, stage string, group_no int"), cases).collect()}
    assert got == {1: ("NO_EXPLICIT_ORACLE", None), 2: ("ABSENT_FROM_TOP_K_CANDIDATES", "candidateSources"), 3: ("PARTIAL_IN_CANDIDATES", "candidateSources"), 4: ("DROPPED_BEFORE_SELECTED", "fused"), 5: ("PRESENT_IN_SELECTED", None)}


def _index(spark, at):
    found = refresh.read_index(spark, at)
    return sorted(((r["doc_id"], r["term"], r["tf"]) for r in refresh.index_terms(found).collect()), key=str), found.count()


def test_stream_refresh_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta beta", "en"), (2, None, "en"), (None, "lost", "en")], "doc_id long, text string, lang string")
    rows.write.parquet(f"{tmp_path}/in")
    assert refresh.read_index(spark, f"{tmp_path}/index") is None
    for n in (1, 2):  # another checkpoint reads the source again and adds nothing
        refresh.refresh_index(spark, f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/check{n}")
        assert _index(spark, f"{tmp_path}/index") == ([(1, "alpha", 1), (1, "beta", 2), (None, "lost", 1)], 3)
    rows.withColumn("text", F.lit("gamma")).filter("doc_id = 1").write.mode("append").parquet(f"{tmp_path}/in")
    refresh.refresh_index(spark, f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/check2")
    assert _index(spark, f"{tmp_path}/index")[1] == 4


def test_stream_refresh_survives_a_batch_that_dies(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"word{i} again again", "en") for i in range(20)], "doc_id long, text string, lang string")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    at, check = f"{tmp_path}/index", f"{tmp_path}/check"
    from pyspark.sql import DataFrameWriter

    whole, calls = DataFrameWriter.parquet, []

    def dies(self, path, *a, **k):
        whole(self, path, *a, **k)
        if "stream=" in path and not calls:
            calls.append(path)
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="lost after the write|FOREACH_BATCH|STREAM"):
        refresh.refresh_index(spark, f"{tmp_path}/in", at, check)
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    assert calls
    refresh.refresh_index(spark, f"{tmp_path}/in", at, check)  # the same batch again, from the checkpoint
    assert _index(spark, at) == (sorted([(i, f"word{i}", 1) for i in range(20)] + [(i, "again", 2) for i in range(20)], key=str), 20)


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert "bm25_topk" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_numbers_have_one_form():
    assert claims.numeric_tokens("1억 2,000만 원을 2024년 3월 5일까지, 30일 이내 12.50% 7") == ["money:120000000", "date:2024-03-05", "day:30", "percent:12.5", "number:7"]
    assert claims.numeric_tokens("2024. 3. 5. 5,000원") == ["date:2024-03-05", "money:5000"] and claims.numeric_tokens(None) == []


def test_anchors_and_artifacts(spark):
    df = spark.createDataFrame([("도로교통법 제 5 조의 2 와 별표 3", "a\x07\r\nHWPHYPERLINK_URL\nhttps\\://x.kr 0http://y")], "q string, t string")
    r = df.select(claims.provisions(F.col("q")).alias("p"), claims.named_titles(F.col("q")).alias("n"), claims.without_artifacts(F.col("t")).alias("t")).first()
    assert r["p"] == ["제5조의2", "별표3"] and r["n"] == ["도로교통법"] and "HWP" not in r["t"] and "https://x.kr http://y" in r["t"]


def test_folder_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.txt", "one"), ("a.pdf", "%PDF"), ("b.md", "two"), ("c.exe", "no")):
        (tmp_path / "d" / name).write_text(text)
    got = {r["base"]: (r["kind"], r["text"]) for r in folders.folder_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("pdf", None), "b": ("md", "two")}


def test_vector_topk_takes_every_twentieth_row(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.array([v for *_, v in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    want = {}
    for q in range(0, 90, 20):
        score = np.round(x @ x[q], 6)
        best = [i for t in range(3) for i in sorted(range(t, 90, 3), key=lambda i: (-score[i], i))[:5]]
        want[q] = sorted(best, key=lambda i: (-score[i], i % 3, i))
    got: dict = {}
    for r in sorted(retrieval.vector_topk_balanced(spark, str(tmp_path)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want


def test_presence_finds_whole_passages_only(spark, tmp_path):
    long_one = "one two three four five six seven eight nine ten eleven twelve thirteen"
    asked = [(1, long_one), (2, long_one + " and another end"), (3, "of two"), (4, "no such words stand in any text"), (5, "A title of its own here"), (6, "rt of the words within a lin"), (7, "(old) Rules of the house")]
    docs = [(1, "a", f"t\nbefore {long_one} behind"), (2, "b", f"{long_one} and other end"), (3, "c", "x\npart of two"), (4, "d", "A  title of its own here\nbody"), (5, "a", "part of the words within a line"), (6, "e", "(new) Rules of the  house\nbody")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["item_id"]: (r["documents"], r["sources"], r["presence"]) for r in audits.document_presence(spark, str(tmp_path)).collect()}
    assert got == {1: (2, "a,b", "TEXT"), 2: (0, "", "NONE"), 3: (1, "c", "TEXT"), 4: (0, "", "NONE"), 5: (1, "d", "EXACT"), 6: (1, "a", "TEXT"), 7: (1, "e", "CANONICAL")}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_presence_counts_all_documents_that_contain_a_passage(spark, size):
    import duckdb

    at = f"/root/testdata/{size}"
    want = duckdb.connect().execute(f"select item_id, count(distinct doc_id) from '{at}/benchmark.parquet' b left join '{at}/documents.parquet' d on contains(d.text, b.text) group by 1").fetchall()
    assert {(r["item_id"], r["documents"]) for r in audits.document_presence(spark, at).collect()} == set(want)


def test_units_of_time_differ():
    assert claims.numeric_tokens("3월 3개월 3년 3시간 3단계 3차") == ["month:3", "duration-month:3", "year:3", "hour:3", "stage:3", "sequence-count:3"]


def test_total_of_statuses_is_one_row_beside_null(spark, tmp_path):
    spark.createDataFrame([(1, "view"), (2, None), (3, "view")], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["status"], r["n"]) for r in audits.status_totals(spark, str(tmp_path)).collect()}
    assert got == {("view", 2), (None, 1), ("TOTAL", 3)}


def test_upper_case_id_of_a_payload_is_read(spark):
    rows = spark.createDataFrame([("law", '{"law": [{"ID": "77", "id": "8", "title": "t"}, {"id": "9", "title": "u"}]}')], "target string, payload string")
    assert {r["external_id"] for r in payloads.search_documents(rows).collect()} == {"77", "9"}


def test_expanded_terms(spark):
    assert expansion.expanded("데이터위원회") == ["데이터위원회", "국가데이터전략위원회", "데이터전략위원회"]
    assert expansion.expanded("우회전") == ["우회전", "교차로 통행방법", "교차로통행방법"]
    assert expansion.expanded("사전협의를")[:3] == ["사전협의", "사전 협의", "사전협의의 대상사업"]
    assert "나라장터" in expansion.expanded("디지털카탈로그") and expansion.expanded("은행위원회") == ["은행위원회"]
    assert expansion.expanded(None) == expansion.expanded("") == []
    q = spark.createDataFrame([(1, "우회전 우회전", ["계약 Law"]), (2, "plain Words, plain", None), (3, None, None)], "query_id int, question string, more array<string>")
    got = lexical.query_terms(q, "more").orderBy("query_id", "pos").collect()
    assert [r["term"] for r in got if r["query_id"] == 1] == ["우회전", "교차로", "통행방법", "교차로통행", "계약", "law"]
    assert [r["term"] for r in got if r["query_id"] == 2] == ["plain", "words"] and not [r for r in got if r["query_id"] == 3]


def test_keyword_index_takes_the_weightiest_field(spark):
    rows = [(1, 9, "계약 절차", "계약", "계약을 관리합니다 Law-2 x"), (2, 9, None, None, None), (3, 9, "", "law law", "LAW été")]
    df = spark.createDataFrame(rows, "chunk_id int, document_id int, p string, t string, b string")
    got = lexical.keyword_index(df, {"parent_title": "p", "chunk_title": "t", "body": "b"}).collect()
    assert sorted((r["chunk_id"], r["term"], r["field_kind"], r["weight"]) for r in got) == [(1, "law", "body", 4), (1, "계약", "chunk_title", 7), (1, "절차", "parent_title", 6), (3, "law", "chunk_title", 7)]


def _anchors(spark, terms, targets=None):
    return spark.createDataFrame([(1, terms, targets, ["제2조"], ["목적"], ["보안"])], "query_id int, title_terms array<string>, targets array<string>, provision_terms array<string>, heading_terms array<string>, evidence_terms array<string>")


def test_anchored_documents_and_chunks(spark):
    cand = spark.createDataFrame(
        [(1, "law", 5, "보안 업무 규정", False), (1, "law", 3, "보안", False), (1, "doc", 4, "보안 안내", True), (1, "law", 3, "보안", True), (1, None, 7, "보안", True), (1, "law", 8, None, True)],
        "query_id int, target string, document_id long, title string, provision_match boolean",
    )
    rows = selection.anchored_documents(_anchors(spark, ["보안"]), cand).orderBy("selection_rank").collect()
    assert [(r["status"], r["document_id"], r["exact_title"]) for r in rows] == [("APPLIED", 3, True), ("APPLIED", 4, False), ("APPLIED", 5, False)]
    only = selection.anchored_documents(_anchors(spark, ["보안"], ["doc"]), cand).collect()
    assert [r["document_id"] for r in only] == [4]
    more = cand.unionByName(cand.filter("document_id = 5").withColumn("document_id", F.lit(6).cast("long")))
    assert [(r["status"], r["document_id"]) for r in selection.anchored_documents(_anchors(spark, ["보안"]), more).collect()] == [("DOCUMENT_MATCH_AMBIGUOUS", None)]
    assert [r["status"] for r in selection.anchored_documents(_anchors(spark, ["없음"]), cand).collect()] == ["DOCUMENT_NOT_FOUND"]
    assert [r["status"] for r in selection.anchored_documents(_anchors(spark, [""]), cand).collect()] == ["NO_STRONG_ANCHOR"]
    chunk = spark.createDataFrame(
        [(3, "law", 1, "제1조", "목적", None, "x", 1), (3, "law", 2, "제2조", "정의", None, "y", 2), (3, "law", 3, "제3조", "a", None, "보안", 3), (3, "law", 4, None, None, None, None, 0), (4, "law", 5, "제2조", "", "", "", 0)],
        "document_id long, target string, chunk_id long, chunk_no string, chunk_title string, parent_title string, chunk_text string, sort_order int",
    )
    selected = selection.anchored_documents(_anchors(spark, ["보안"]), cand)
    seen = spark.createDataFrame([(1, "law", 3)], "query_id int, target string, chunk_id long")
    got = selection.anchored_chunks(selected, chunk, _anchors(spark, ["보안"]), seen).orderBy("rank").collect()
    assert [(r["chunk_id"], r["reason"], r["overlaps"]) for r in got] == [(2, "EXACT_PROVISION", False), (1, "EXACT_HEADING", False), (3, "EVIDENCE_TERMS", True), (4, "DOCUMENT_ORDER", False)]


def test_base_scores(spark):
    s = lambda rows: spark.createDataFrame(rows, "query_id int, target string, chunk_id long, score double")
    first, second = s([(1, "a", 1, 0.5), (1, "a", 2, 0.9)]), s([(1, "a", 1, 0.7), (1, "a", 3, -1.0)])
    assert {r["chunk_id"]: r["score"] for r in selection.base_scores(first, second).collect()} == {1: 0.7, 2: 0.9, 3: 0.0}
    fused = s([(1, "a", 1, 0.02), (1, "a", 4, 0.01)])
    assert {r["chunk_id"]: round(r["score"], 9) for r in selection.base_scores(first, second, fused).collect()} == {1: 1.9, 2: 0.9, 3: 0.0, 4: 1.4}


def test_case_verdicts(spark):
    cases = spark.createDataFrame(
        [
            (1, "OK", None, ["계약 금액", "없음"], None, ["1"], None), (2, "OK", 2, ["계약"], None, None, None), (3, "OK", None, ["계약"], ["위반"], None, None),
            (4, "NO_GROUNDS", None, ["계약"], None, None, ["NO_GROUNDS"]), (5, "OK", None, ["계약"], None, None, None), (6, "OK", None, ["계약"], None, ["1", "3"], None),
        ],
        "case_id int, result_msg string, required_matches int, expected_terms array<string>, forbidden_terms array<string>, page_numbers array<string>, result_msgs array<string>",
    )
    none = F.lit(None).cast("array<string>")
    cases = cases.select("*", *[none.alias(c) for c in ("title_terms", "section_types", "document_terms", "parent_terms")])
    items = spark.createDataFrame([(c, n, t, "", "", "body", n) for c in (1, 2, 3, 6) for n, t in ((1, "계약금액 산정"), (2, "위반 시"))], "case_id int, rank int, text string, title_text string, parent_text string, section_type string, page_no int")
    got = {r["case_id"]: r for r in selection.case_verdicts(cases, items).collect()}
    assert {k: r["passed"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert (got[1]["matched_terms"], got[1]["missing_terms"], got[3]["forbidden_matched"]) == (["계약금액"], ["없음"], ["위반"])


def test_expansion_verdict(spark):
    control = [[0] if i < 14 else [] for i in range(24)]
    for i in range(8):
        control[i] = [0, 1]
    sizes = [2 if i < 7 else 3 for i in range(24)]

    def verdict(found, runs=(1, 2)):
        rows = [(run, i, sizes[i], control[i], found[i]) for run in runs for i in range(24)]
        return selection.expansion_verdict(spark.createDataFrame(rows, "run int, case_id int, required_groups int, control array<int>, expanded array<int>")).first()["status"]

    better = [*control[:7], [0, 1, 2], *control[8:]]
    assert verdict(better) == "ELIGIBLE_FOR_DIFFICULT_EVAL" and verdict(better, (1,)) == "INVALID_CAPTURE"
    assert verdict(control) == "NO_DOCUMENT_EXPANSION_IMPROVEMENT"
    assert verdict([[0], *better[1:]]) == "BASELINE_REGRESSION"


def test_requests_headings_and_states(spark):
    assert selection.page_request(" ", " ", 0, 500) == {"target": "law", "query": "*", "page": 1, "display": 100, "offset": 0, "all": True}
    assert selection.page_request("admrul", " x ", 3, 0)["offset"] == 2
    df = spark.createDataFrame([("q", "", "", 9), ("qa", "q", "", 8), ("aq", "", "", 7), ("", "q", "q", 6), (None, "qa", "", 5), ("", "aq", "", 4), ("", "", "q", 3), ("", "", "qa", 2), ("", None, "aq", 1), ("", "", None, 0)], "a string, b string, c string, want int")
    assert df.filter(selection.heading_score(F.lit("q"), F.col("a"), F.col("b"), F.col("c")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("law", "PAST", False, False), ("law", "FUTURE", False, True), ("law", None, True, True), ("admrul", "UNKNOWN", True, True), ("doc", "PAST", True, True)], "t string, s string, now boolean, later boolean")
    found = df.select(selection.searchable(F.col("t"), F.col("s")).alias("x"), selection.searchable(F.col("t"), F.col("s"), True).alias("y"), "now", "later")
    assert found.filter("x <> now or y <> later").count() == 0


def test_section_kinds_look_for_words_without_regular_expressions(spark):
    df = spark.createDataFrame([("a", "적용 대상", "x | y"), (None, "h", "제출 서류"), ("p", None, "a|b|c|d"), ("p", "h", "\ta\tb\tc"), ("p", "h", None)], "p string, h string, t string")
    df = df.select("*", chunking.section_kind(F.col("p"), F.col("h"), F.col("t")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["target_scope", "requirement", "table", "table", "body"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 1
