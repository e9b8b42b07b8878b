"""JSON payloads of a statute service as documents and sections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.cleaning import canonical_key, effective_date, first_present, sha256

# Envelope keys, and the names under which a field may be found, first wins.
ENVELOPE = "resultCode resultMsg target 키워드 section totalCnt page numOfRows".split()
FIELDS = {
    "title": "법령명한글 법령명 법령명_한글 행정규칙명 자치법규명 판례명 사건명 제목".split(),
    "external_id": "법령일련번호 행정규칙일련번호 자치법규일련번호 판례일련번호 행정규칙ID ID id".split(),
    "agency_name": "소관부처명 부처명 기관명 법원명 자치단체명 발령기관명".split(),
    "category_name": "법령구분명 행정규칙종류 자치법규종류 구분 분류".split(),
    "source_date": "시행일자 공포일자 발령일자 선고일자 의결일자 자치법규시행일자".split(),
}
LONG = 20


def search_rows(payload: str | None) -> list[str]:
    """The rows of a search answer as JSON; text that isn't JSON has none."""
    try:
        node = json.loads(payload or "null")
    except ValueError:
        return []
    if isinstance(node, dict) and len(node) == 1:
        node = next(iter(node.values()))
    values = node if isinstance(node, list) else [v for k, v in node.items() if k not in ENVELOPE] if isinstance(node, dict) else []
    rows = [r for v in values for r in (v if isinstance(v, list) else [v])]
    return [json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in rows if isinstance(r, dict)]


def sections_of(payload: str | None) -> list[dict]:
    """Named sections if the payload has them, else every long text with its path."""
    try:
        node = json.loads(payload or "null")
    except ValueError:
        return []
    if isinstance(node, dict) and isinstance(node.get("sections"), list):
        text = lambda s, *names: next((str(s[n]).strip() for n in names if str(s.get(n) or "").strip()), None)
        return [{"type": text(s, "type"), "no": text(s, "no"), "title": text(s, "title"), "body": text(s, "body", "text", "content")} for s in node["sections"] if isinstance(s, dict)]
    out, todo = [], [("$", node)]
    while todo:
        path, n = todo.pop()
        if isinstance(n, dict):
            todo += [(f"{path}.{k}", v) for k, v in reversed(n.items())]
        elif isinstance(n, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed([*enumerate(n)])]
        elif isinstance(n, str) and len(n.strip()) >= LONG:
            out.append({"type": "text", "no": None, "title": path, "body": n.strip()})
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rows(payloads: pd.Series) -> pd.Series:
    return payloads.map(search_rows)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "no", "title", "body")])))
def _sections(payloads: pd.Series) -> pd.Series:
    return payloads.map(sections_of)


def search_documents(payloads: DataFrame) -> DataFrame:
    """Documents of search answers (target, payload): the first name that isn't blank gives a field, a hash stands in for a missing id."""
    rows = payloads.select("target", F.explode(_rows("payload")).alias("row"))
    # One parse of the JSON for all names, not one for each.
    asked = ", ".join(f"`{n}` string" for names in FIELDS.values() for n in names if n != "ID")
    parsed = rows.withColumn("j", F.from_json("row", asked))
    # ID and id would be one name in a schema that ignores case.
    value = lambda n: F.get_json_object("row", "$.ID") if n == "ID" else F.col("j").getField(n)
    found = {k: first_present(*map(value, names)) for k, names in FIELDS.items()}
    out = parsed.select("target", "row", *[c.alias(k) for k, c in found.items()])
    out = out.withColumn("external_id", F.coalesce("external_id", F.substring(sha256(F.col("row")), 1, 32)))
    out = out.withColumn("title", F.coalesce("title", F.concat_ws("-", "target", "external_id")))
    return out.withColumn("canonical_key", canonical_key(F.col("target"), F.col("title"))).withColumn("effective_date", effective_date(F.col("source_date")))


def detail_sections(payloads: DataFrame) -> DataFrame:
    """(key, sort_order, type, no, title, body) of detail answers (key, payload)."""
    rows = payloads.select("key", F.posexplode(_sections("payload")).alias("sort_order", "s"))
    return rows.select("key", "sort_order", "s.type", "s.no", "s.title", "s.body")
