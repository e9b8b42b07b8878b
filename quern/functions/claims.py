"""Numbers, provisions and titles in text, in one form each, and leftovers of document formats."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scales of amounts and names of units.
SCALES = {"천만": 10_000_000, "백만": 1_000_000, "십만": 100_000, "억": 100_000_000, "만": 10_000, "천": 1_000, "백": 100, "십": 10}
UNITS = {
    "%": "percent", "퍼센트": "percent", "년": "year", "개월": "duration-month", "월": "month", "일": "day", "점": "point", "개": "item-count", "건": "case-count",
    "명": "person-count", "회": "occurrence-count", "차": "sequence-count", "단계": "stage", "시간": "hour",
}

_NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
_TOKEN = re.compile(
    rf"(?P<date>(?<!\d)\d{{4}}\s*(?:년|\.)\s*\d{{1,2}}\s*(?:월|\.)\s*\d{{1,2}}(?:\s*일)?(?!\d))"
    rf"|(?P<money>(?:{_NUMBER}\s*(?:{'|'.join(SCALES)})\s*)+(?:{_NUMBER}\s*)?원|{_NUMBER}\s*원)"
    rf"|(?P<unit>{_NUMBER}\s*(?:{'|'.join(map(re.escape, sorted(UNITS, key=len, reverse=True)))}))|(?P<plain>{_NUMBER})"
)
_PART = re.compile(rf"({_NUMBER})\s*({'|'.join(SCALES)})?")


def _plain(number: str) -> str:
    return f"{Decimal(number.replace(',', '')).normalize():f}"


def numeric_tokens(text: str | None) -> list[str]:
    """Dates, amounts, values with units and other numbers of a text, in order, each as ``kind:value``."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        kind, found = m.lastgroup, m.group()
        if kind == "date":
            y, mo, d = re.findall(r"\d+", found)
            out.append(f"date:{y}-{int(mo):02}-{int(d):02}")
        elif kind == "money":
            total = sum(Decimal(n.replace(",", "")) * SCALES.get(s, 1) for n, s in _PART.findall(found))
            out.append(f"money:{total.normalize():f}")
        elif kind == "unit":
            number = re.match(_NUMBER, found).group()
            out.append(f"{UNITS[found[len(number) :].strip()]}:{_plain(number)}")
        else:
            out.append(f"number:{_plain(found)}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def numeric_tokens_udf(texts: pd.Series) -> pd.Series:
    return texts.map(numeric_tokens)


def provisions(text: Column) -> Column:
    """Articles and appendices named in a text, without blanks."""
    found = F.regexp_extract_all(text, F.lit(r"(제\s*\d+\s*조(?:\s*의\s*\d+)?|별표\s*\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"\s+", "")))


def named_titles(text: Column) -> Column:
    """Names of statutes and rules in a text: words that end in one of their kinds."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{IsHangul}\p{Alnum}][\p{IsHangul}\p{Alnum} ]{0,70}?(?:시행규칙|시행령|규정|지침|고시|법))(?![\p{IsHangul}\p{Alnum}]{2,})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))))


def without_artifacts(text: Column) -> Column:
    """Text without control characters and field codes that extraction from office formats leaves behind."""
    t = F.regexp_replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"(?m)^\s*HWPHYPERLINK_[A-Z_]*\s*$|HWPHYPERLINK_[A-Z_]*", "")
    t = F.replace(F.replace(t, F.lit("\\://"), F.lit("://")), F.lit("\\:"), F.lit(":"))
    t = F.regexp_replace(t, r"(?i)(^|[^\p{Alnum}])0(?=https?://|mailto:)", "$1")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \t\n"))
