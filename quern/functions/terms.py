"""Normal forms of words, and the word lists that Korean questions need.

The lists are data: which endings are cut, in which order, and which words say
nothing.  Everything else is regular expressions.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must equal the ones that indexes and queries were built with.
WEAK_TERMS = (
    "알려줘 알수있어 알수있나요 위한 어떻게 어떤 어디 어디까지 가능 가능해 가능한가 가능한가요 가능하나요 가능한지 무엇 무슨 뭐야 뭔가요 뭔지 이란 란 정의 질문 방안 유형 새로운 "
    "한걸 하는게 받아야해 받아야하나 받아야하나요 받아야하는지 해야해 해야하나 해야하나요 하나 적어야해 확인 확인하는게 확인해 확인하나 확인하나요 확인하는지 여부 "
    "있나 있나요 되나요 된다 있어 관련 대해 대한 만으로 만으로도"
).split()
QUESTION_ENDINGS = (
    "이라는건뭐야 라는건뭐야 이라는거뭐야 라는거뭐야 이라는게뭐야 라는게뭐야 이란건뭐야 란건뭐야 이란게뭐야 란게뭐야 이란거뭐야 란거뭐야 이라는건 라는건 이라는거야 라는거야 "
    "이라는거 라는거 이라는게 라는게 이라는것 라는것 이란건 란건 이란거야 란거야 이란거 란거 이란게 란게 이란 란 무엇인가요 무엇인가 무엇인지 뭔가요 뭔지 뭐야 무엇 정의 "
    "받아야하나요 받아야하나 받아야해요 받아야해 해야하나요 해야하나 해야해요 해야해 하나요 하나"
).split()
PARTICLES = "이라고 라고 으로 에서 에게 까지 부터 하고 하면 은 는 이 가 을 를 에 의 와 과 도".split()
UNCUT_TERMS = "과업심의 사전협의 횡단보도 공공데이터 수의계약 직접구매 디지털서비스몰 디지털카탈로그 디지털카달로그 종합쇼핑몰 상용소프트웨어 상용sw".split()
INTENT_ENDINGS = (
    "대상사업 대상시스템 대상기관 적용대상 필수요소 검토내용 추진절차 신청방법 제출서류 가능하나요 가능한가요 가능한가 가능한지 가능해 가능 언제하나요 언제해요 언제인지 언제해 언제 "
    "어디까지 시기 기한 기간 대상 시스템 사업 기관 요소 항목 절차 방법 서류 인가요 인가 인지 일까요 일까 건가요 건가 할때에는 할때는 할때에 할때 하는때 때에는 때는 때에 "
    "받아야하나요 받아야하나 받아야해요 받아야해 받아야 해야하나요 해야하나 해야해요 해야해 해야 하나요 하나 하는게 한걸 정의 이란 란"
).split()
#: Lengths of index terms and keywords.
SHORTEST, LONGEST = 2, 80
#: Words with these endings are no keywords.
POLITE_ENDINGS = ("합니다", "됩니다", "입니다", "있습니다", "없습니다")

_KOREAN = regex.compile(r"\p{Hangul}")
_KEPT = regex.compile(r"[^\p{Hangul}A-Za-z0-9]+")
_SPLIT = regex.compile(r"[^\p{Hangul}\p{L}\p{N}]+")
_TONES = regex.compile("[〮〯]+")
_COMMA = regex.compile(r"(?<=[0-9]),(?=[0-9])")
_WEAK = frozenset(WEAK_TERMS)
#: Texts of these characters are unchanged by NFKC and have no Korean endings, so built-in functions suffice.
PLAIN = r"^[\x00-\x7FÀ-ÿ]*$"


def match_form(text: Column) -> Column:
    """Only Hangul and ASCII letters and digits, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{IsHangul}\p{Alnum}]", ""))


def _without(term: str, endings: list[str], least: int, spare: int) -> str:
    """``term`` without the first of the endings that leaves more than ``spare`` characters."""
    if len(term) < least:
        return term
    return next((term[: -len(e)] for e in endings if term.endswith(e) and len(term) > len(e) + spare), term)


def _without_particle(term: str) -> str:
    for word in UNCUT_TERMS if len(term) >= 3 else ():
        if term.startswith(word) and len(term) - len(word) in (0, 1):
            return word
    return _without(term, PARTICLES, 3, 1)


def base_form(term: str | None) -> str:
    """The term without question endings, particles and words of intent, cut until nothing changes."""
    now, before = _KEPT.sub("", term or "").lower(), None
    while now != before:
        before = now
        now = _without(now, INTENT_ENDINGS, 4, 2)
        now = _without(now, QUESTION_ENDINGS, 3, 1)
        now = _without(_without_particle(now), QUESTION_ENDINGS, 3, 1)
    return now


def is_weak(term: str | None) -> bool:
    plain = _KEPT.sub("", term or "").lower()
    return not plain or plain in _WEAK


def weak(term: Column) -> Column:
    """``is_weak`` as a column."""
    form = match_form(term)
    return (form == "") | form.isin(WEAK_TERMS)


def is_korean(text: str) -> bool:
    """Whether a text has Hangul."""
    return bool(_KOREAN.search(text))


def index_terms(text: str | None) -> list[str]:
    """All index terms of a text, repeats included, in order."""
    if not text or not text.strip():
        return []
    folded = _COMMA.sub("", _TONES.sub(" ", unicodedata.normalize("NFKC", text).lower()))
    terms = map(base_form, _SPLIT.split(folded))
    return [t for t in terms if SHORTEST <= len(t) <= LONGEST and t not in _WEAK]


def term_counts(text: str | None) -> dict[str, int]:
    return dict(Counter(index_terms(text)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _index_terms(texts: pa.Array) -> pa.Array:
    from quern.functions.words import index_words, listed  # which imports this module

    return listed(len(texts), *index_words(texts))


def terms_of(text: Column) -> Column:
    """``index_terms`` as a column; null has none."""
    return _index_terms(text.cast("string"))


def keywords(text: str | None) -> list[str]:
    """Keywords of a text in order, repeats included: base forms of its words but weak ones and polite verbs."""
    found = map(base_form, _KEPT.split(text or ""))
    return [t for t in found if SHORTEST <= len(t) <= LONGEST and t not in _WEAK and not t.endswith(POLITE_ENDINGS)]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _keywords(texts: pa.Array) -> pa.Array:
    from quern.functions.words import keyword_words, listed

    return listed(len(texts), *keyword_words(texts))


def keywords_of(text: Column) -> Column:
    """``keywords`` as a column; null has none."""
    return _keywords(text.cast("string"))
