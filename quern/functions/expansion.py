"""Further keywords for a question's terms: spellings with and without spaces, names of the same thing, committees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.terms import PLAIN, base_form, index_terms, is_weak, terms_of

# A term that holds one of the first words is also searched by the second ones, in this order.
EXPANSIONS = (
    (("보안성검토",), ("보안성 검토", "정보화사업 보안성 검토", "보안성 검토 개요", "보안성 검토 대상")),
    (("사전협의",), ("사전 협의", "사전협의의 대상사업", "사전협의 대상사업", "대상기관이 추진하는 모든 정보화사업", "예산과목 및 계약방식과 관계없이")),
    (("기타공공기관", "기타공공"), ("기타공공기관", "공공기관", "중앙·공공기관", "중앙 공공기관", "대상기관", "대상기관이 추진하는 모든 정보화사업")),
    (("과업심의",), ("과업 심의",)),
    (("업무성과계획",), ("업무 성과 계획",)),
    (("성과측정",), ("성과 측정",)),
    (("우회전",), ("우회전", "교차로 통행방법", "교차로통행방법")),
    (("횡단보도",), ("횡단보도", "보행자 보호의무", "보행자보호의무", "보행자")),
    (
        ("공공데이터베이스", "표준화"),
        ("공공데이터베이스 표준화", "공공데이터베이스 표준화 관리 매뉴얼", "표준용어", "표준도메인", "데이터 표준", "품질관리 진단", "예방적 품질관리"),
    ),
    (("전처리",), ("데이터 전처리", "데이터 전처리 절차", "오류 원인 분석", "대상 선정", "방법 결정")),
    (("가명정보", "추가정보"), ("가명정보", "가명정보 처리", "추가정보", "분리보관", "분리하여 보관", "파기")),
    (("영상정보", "cctv"), ("고정형 영상정보처리기기", "설치 목적", "촬영범위", "촬영시간", "보관기간", "30일 이내")),
    (("멈추", "멈춰", "정지", "서야", "세워", "서야하", "일시정지"), ("정지", "일시정지", "정지하여야", "정지하거나", "멈추")),
    (("운전",), ("운전", "운전자", "차의 운전자")),
    (
        ("조달청", "나라장터", "종합쇼핑몰", "디지털서비스몰", "디지털서비스", "디지털카탈로그", "디지털카달로그", "카탈로그", "카달로그"),
        (
            "디지털서비스몰", "디지털 서비스몰", "디지털카탈로그", "디지털카달로그", "디지털 카탈로그", "디지털 카달로그", "조달청 종합쇼핑몰", "종합쇼핑몰",
            "나라장터", "상용SW 직접구매", "상용소프트웨어 직접구매", "상용 SW 직접구매", "직접구매", "상용SW", "상용소프트웨어",
        ),
    ),
)
COMMITTEE, COMMITTEE_NAMES = "위원회", ("국가{}전략위원회", "{}전략위원회")


def expanded(term: str | None) -> list[str]:
    """The term's base form and what else to search for it, each once; nothing for a term without a base form."""
    own = base_form(term)
    found = [own, *(k for cues, keywords in EXPANSIONS if any(c in own for c in cues) for k in keywords)]
    subject = own.removesuffix(COMMITTEE)
    if own.endswith(COMMITTEE) and len(subject) >= 3:
        found += [name.format(subject) for name in COMMITTEE_NAMES]
    return [k for k in dict.fromkeys(found) if own and len(k) >= 2]


def question_terms(text: str | None) -> list[str]:
    """Index terms of what each index term of a text expands to, each once, in order of first occurrence."""
    wider = (k for term in dict.fromkeys(index_terms(text)) for k in expanded(term))
    return list(dict.fromkeys(t for k in wider for t in index_terms(k)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _question_terms(texts: pd.Series) -> pd.Series:
    return texts.map(question_terms, na_action="ignore")


def question_terms_of(text: Column) -> Column:
    """``question_terms`` as a column; plain texts hold no word of the tables, so built-in functions do for them."""
    plain = text.rlike(PLAIN)
    return F.when(text.isNull() | plain, terms_of(F.when(plain, text))).otherwise(_question_terms(F.when(~plain, text)))


def plan_terms(text: str | None) -> list[str]:
    """A question's words in base form, each followed by what it expands to; of a single word also the whole question as one."""
    own = [t for t in map(base_form, (text or "").split()) if len(t) >= 2 and not is_weak(t)]
    whole = base_form(text)
    if len(own) == 1 and len(whole) >= 4:
        own.append(whole)
    return list(dict.fromkeys(k for t in own for k in (t, *expanded(t))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plan_terms(texts: pd.Series) -> pd.Series:
    return texts.map(plan_terms, na_action="ignore")


def plan_terms_of(text: Column) -> Column:
    """``plan_terms`` as a column; native for plain texts, whose words have no endings and expand to nothing else."""
    plain = text.rlike(PLAIN)
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    own = F.filter(F.transform(F.split(text, r"\s+"), bare), lambda t: F.length(t) >= 2)
    whole = F.when((F.size(own) == 1) & (F.length(bare(text)) >= 4), F.array(bare(text))).otherwise(F.array().cast("array<string>"))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(plain, F.array_distinct(F.concat(own, whole))).otherwise(_plan_terms(F.when(~plain, text)))
