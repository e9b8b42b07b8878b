"""Rules met, anchors and plans of questions, on literal cases."""

import pytest
from pyspark.sql import functions as F

from quern.operators import questions

# A few rules in the dictionary's format.
LINES = """# a comment
entities=irm|project_review
synonyms=it_compliance|security_review
intents=procedure|penalty|period
policies=permission|quiet

entity.irm.label=IRM
entity.irm.aliases=IRM|정보자원관리시스템|정보자원 관리시스템|정보자원관리
entity.irm.stable_aliases=IRM|정보자원관리시스템
entity.irm.targets=official_doc|internal_doc
entity.irm.focused=정보자원 등록관리|성과측정
entity.irm.section_types=procedure
entity.irm.direct=등록 절차|등록;권한
entity.project_review.label=과업심의
entity.project_review.aliases=과업심의
synonym.security_review=보안성검토|보안성 검토
synonym.it_compliance=법제도 준수|미준수
synonym.it_compliance.match=정보화사업|word:정보시스템;준수|위반
intent.procedure.cues=절차|방법
intent.procedure.section_types=procedure|requirement
intent.procedure.terms=절차|신청
intent.penalty.cues=벌칙|위반
intent.period.cues=언제|기한
policy.permission.match=권한|permission;사용자|관리자
policy.permission.focused=권한 관리|관리자
policy.permission.concepts=사용자 권한|권한;관리자
policy.permission.section_types=operation_rule
policy.permission.intent_types=operation_rule
policy.quiet.match=조용
policy.quiet.suppress_intents=procedure
""".splitlines()


@pytest.fixture(scope="module")
def rules(spark):
    return questions.rules_of(questions.read_dictionary(spark.createDataFrame([(x,) for x in LINES], "value string")))


def _asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def _met(df):
    return {(r["query_id"], r["kind"], r["rule_id"]) for r in df.collect()}


def test_rules_are_met_when_every_group_is(spark, rules, monkeypatch):
    asked = _asked(
        spark, "정보자원 관리시스템 IRM 등록 절차는?", "정보시스템을 운영할 때 준수할 것", "행정정보시스템 준수", "사용자 권한을 언제 회수하나요", "권한만", "정보시스템하나 위반", None, "  ", "정보시스템 위반 벌칙"
    )
    want = {
        (0, "entity", "irm"), (0, "intent", "procedure"), (1, "synonym", "it_compliance"), (3, "policy", "permission"), (3, "intent", "period"),
        (5, "intent", "penalty"), (8, "synonym", "it_compliance"), (8, "intent", "penalty"),
    }
    assert _met(questions.matched_rules(asked, rules[0])) == want
    monkeypatch.setattr(questions, "MOST_PATTERNS", 3)  # the join instead of the automaton
    assert _met(questions.matched_rules(asked, rules[0])) == want


def test_automaton_and_join_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabcabcdefghij"), (2, ""), (3, None), (4, "aaaa"), (5, "가나다라마바사아자")], "query_id long, text string")
    forms = spark.createDataFrame([("a",), ("aa",), ("abcabc",), ("abcabcabcdef",), ("abcabcx",), ("",), ("나다",), ("가나다라마바사아자차",), ("j",), ("a",)], "form string")
    want = {(q, f, i) for q, t in ((1, "abcabcabcdefghij"), (4, "aaaa"), (5, "가나다라마바사아자")) for f in ("a", "aa", "abcabc", "abcabcabcdef", "나다", "j") for i in range(len(t)) if t.startswith(f, i)}
    assert {tuple(r) for r in questions.occurrences(texts, forms).collect()} == want
    monkeypatch.setattr(questions, "MOST_PATTERNS", 0)
    rows = questions.occurrences(texts, forms).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def _anchors(spark, rules, texts, plan=None):
    asked = _asked(spark, *texts)
    met = questions.matched_rules(asked, rules[0])
    plans = plan if plan is not None else questions.search_plans(asked, met, rules[1])
    aliases = rules[1].filter("field = 'stable_aliases'").select("rule_id", "ord", "pos", F.col("value").alias("alias"))
    return {r["query_id"]: r for r in questions.question_anchors(asked, plans, aliases, met).collect()}


def test_anchors_of_the_cases(spark, rules):
    titles = ["전자정부법", "전자정부법 시행령", "전자정부법 시행규칙", "정보보호 규정", "전자정부 지침", "전자정부 고시"]
    texts = [
        "「전자정부법」 제67조의2(사전협의 대상)에 따른 사전협의 대상은?", "인공지능 데이터 기반 행정 활성화 법은 언제부터 효력이 있어?", "정보자원관리시스템 IRM 등록 절차는?",
        "전자정부법 제12조 제12조의2 별표 3(사전협의 대상)은?", "전자정부법 별표 3 제12조의 적용 대상은?", None, " ", "등록 절차는?", "제3조는?", *[f"{t}의 적용 대상은?" for t in titles],
    ]
    plans = spark.createDataFrame(
        [(0, ["전자정부법", "사전협의", "대상"], ["사전협의", "대상"], []), (2, ["정보자원관리시스템", "IRM", "등록", "절차"], ["등록", "절차"], ["official_doc", "internal_doc"]),
         (3, ["전자정부법", "사전협의", "사전 협의", "대상"], ["사전협의", "사전 협의", "대상"], [])],
        "query_id long, lexical array<string>, focused array<string>, targets array<string>",
    )
    got = _anchors(spark, rules, texts, plans)
    shown = lambda i: (got[i]["title_terms"], got[i]["provision_terms"], got[i]["heading_terms"], got[i]["anchor_type"], got[i]["status"])
    assert shown(0) == (["전자정부법"], ["제67조의2"], ["사전협의 대상"], "TITLE_WITH_PROVISION", "ELIGIBLE")
    assert got[0]["evidence_terms"] == ["사전협의", "대상", "전자정부법"]
    assert shown(1) == (["인공지능", "데이터", "기반", "행정", "활성화", "법"], [], [], "EXPLICIT_TITLE", "ELIGIBLE")
    assert shown(2) == (["정보자원관리시스템", "IRM"], [], [], "STABLE_ALIAS", "ELIGIBLE") and got[2]["targets"] == ["official_doc", "internal_doc"]
    assert shown(3)[1:3] == (["제12조", "제12조의2", "별표 3"], ["사전협의 대상"]) and got[3]["evidence_terms"] == ["사전협의", "대상", "전자정부법"]
    assert got[4]["provision_terms"] == ["별표 3", "제12조"]
    assert shown(5)[3:] == shown(6)[3:] == ("NONE", "INVALID") and shown(7)[3:] == ("NONE", "NO_STRONG_ANCHOR")
    assert shown(8) == ([], ["제3조"], [], "NONE", "NO_STRONG_ANCHOR")
    for i, t in enumerate(titles, 9):
        assert got[i]["title_terms"] == t.split() and got[i]["anchor_type"] == "EXPLICIT_TITLE"


def test_aliases_leftmost_longest_without_overlaps(spark):
    asked = _asked(spark, "abcdef xyz", "bcd", "xyzxyz")
    aliases = spark.createDataFrame([("r", 0, 0, "cde"), ("r", 0, 1, "abc"), ("r", 0, 2, "ABCD"), ("s", 1, 0, "ef"), ("s", 1, 1, "x y z"), ("s", 1, 2, "XYZ"), ("t", 2, 0, "def")], "rule_id string, ord int, pos int, alias string")
    met = spark.createDataFrame([(0, "r"), (0, "s"), (1, "r"), (2, "s")], "query_id long, rule_id string")
    got = {r["query_id"]: r["aliases"] for r in questions.chosen_aliases(asked, aliases, met).collect()}
    assert got == {0: ["ABCD", "ef", "x y z"], 2: ["x y z"]}


def test_plans_of_the_cases(spark, rules):
    asked = _asked(spark, "IRM 등록 절차", "사용자 권한 절차", "조용한 절차", None, "x")
    met = questions.matched_rules(asked, rules[0])
    got = {r["query_id"]: r for r in questions.search_plans(asked, met, rules[1]).collect()}
    assert got[0]["lexical"] == ["irm", "등록", "IRM", "정보자원관리시스템", "정보자원 관리시스템", "정보자원관리", "절차", "신청", "등록 절차", "권한", "정보자원 등록관리", "성과측정", "procedure", "requirement"] or "절차" in got[0]["lexical"][:3]
    assert got[0]["focused"] == ["정보자원 등록관리", "성과측정", "등록 절차", "권한", "procedure", "requirement"]
    assert got[0]["sections"] == ["procedure", "requirement"] and got[0]["targets"] == ["official_doc", "internal_doc"] and got[0]["intents"] == ["procedure"]
    first, concepts, sections = got[0]["embedding_query"].split("\n")
    assert first == "IRM 등록 절차" and concepts.startswith("핵심 개념: ") and len(concepts[7:].split(", ")) <= 10 and all(len(k) >= 3 for k in concepts[7:].split(", "))
    assert sections == "찾을 근거 유형: procedure, requirement"
    assert got[0]["expanded"] == [" ".join(got[0]["embedding_query"].split()), "IRM 정보자원 등록관리 성과측정 등록 절차 권한 절차 신청"]
    assert got[1]["intents"] == ["procedure", "operation_rule"] and got[1]["focused"] == ["권한 관리", "관리자", "procedure", "requirement", "operation_rule"]
    assert got[2]["intents"] == [] and got[2]["sections"] == []
    assert got[3]["lexical"] == got[3]["expanded"] == [] and got[3]["embedding_query"] == "" and got[4]["embedding_query"] == "x"


def test_plans_keep_their_limits(spark):
    lines = ["policies=p|q", "policy.p.match=a", "policy.p.concepts=" + ";".join("|".join(f"c{i}x{j}" for j in range(9)) for i in range(9)), "policy.p.focused=" + "|".join(f"f{i}" for i in range(15)), "policy.p.direct=" + ";".join(f"d{i}|e{i}" for i in range(20)), "policy.q.match= ;"]
    matches, values = questions.rules_of(questions.read_dictionary(spark.createDataFrame([(x,) for x in lines], "value string")))
    asked = _asked(spark, " ".join(f"word{i}" for i in range(30)) + " a")
    met = questions.matched_rules(asked, matches)
    assert _met(met) == {(0, "policy", "p")}
    (r,) = questions.search_plans(asked, met, values).collect()
    concepts = [f"c{i}x{j}" for i in range(9) for j in range(9)]
    assert r["lexical"] == [f"word{i}" for i in range(24)] + concepts[:24]
    assert r["focused"] == [f"f{i}" for i in range(10)] + [f"d{i}" for i in range(8)]
