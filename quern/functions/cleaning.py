"""Visible text, hashes, keys and dates as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.terms import match_form


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def _simple_entities(text: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_text(markup: Column, all_entities: bool = False) -> Column:
    """Text of HTML: scripts and styles dropped, a line for each block, tags blanked, entities resolved, blank lines dropped."""
    t = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = _unescaped(t) if all_entities else _simple_entities(t)
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def visible_text(text: Column) -> Column:
    """Tags and four entities blanked, control characters blanked, runs of blanks folded, three line ends or more to two."""
    given = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(given, "<[^>]+>", " ")
    t = F.regexp_replace(t, "&(nbsp|lt|gt|amp);", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", " ")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, r"(\r\n|\n|\r){3,}", "\n\n")
    # Most texts hold nothing of these, which one search tells.
    return F.trim(F.when(given.rlike(r"[<&\x00-\x1F\x7F-\x9F]|  "), t).otherwise(given), F.lit(" \t\r\n"))


def compact(text: Column) -> Column:
    """Lower-case visible text without white space and punctuation."""
    return unpunctuated(F.lower(visible_text(text)))


def unpunctuated(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Punct}·ㆍ]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))


def canonical_key(target: Column, title: Column) -> Column:
    normal = match_form(title)
    return F.concat(target, F.lit(":"), F.when(normal == "", F.lit("unknown")).otherwise(normal))


def effective_date(text: Column) -> Column:
    """The first eight digits if they are a date, else null."""
    digits = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", ""), 1, 8)
    return F.when((F.length(digits) == 8) & F.try_to_timestamp(digits, F.lit("yyyyMMdd")).isNotNull(), digits)


def shown_date(text: Column) -> Column:
    d = effective_date(text)
    return F.when(d.isNotNull(), F.format_string("%s. %d. %d.", F.substring(d, 1, 4), F.substring(d, 5, 2).cast("int"), F.substring(d, 7, 2).cast("int"))).otherwise(text)


def snippet(text: Column, chars: int = 260) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def question_key(text: Column) -> Column:
    """Questions that differ in blanks, question marks and case only are one."""
    return F.lower(F.translate(F.trim(text), " \t?？", ""))


def metric_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}\p{S}\s]+", "")


def missing(text: Column) -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit(""))) == ""


def first_present(*columns: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])
