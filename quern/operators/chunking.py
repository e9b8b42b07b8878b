"""Cutting texts into chunks, and telling headings and kinds of sections apart.

Each text is cut on its own inside a task; documents never meet, so any number
of them is one map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes in characters.
PAGE_MOST, PAGE_LEAST, OVERLAP = 1700, 220, 160
CHILD_LEAST, CHILD_MOST, TINY = 800, 2500, 80
# Words of section kinds.
SCOPE = "적용대상 대상사업 대상기관 검토대상 지원대상 대상시스템".split()
EXCEPTION = "제외 비대상 예외 생략 면제".split()
REQUIREMENT = "제출서류 필수항목 요구사항 기재사항 명시하여야 평가요소 평가방법".split()
PROCEDURE = "절차 신청 제출 통보 처리 등록 조회 방법 구성및운영 운영방법 위원회구성".split()
EXAMPLE = "작성예시 작성예 예시 샘플 양식 서식".split()

# Ends of a line that leave a sentence open, and marks that stand alone before what they mark.
OPEN_ENDS = ("은", "는", ":", "관계없이", "대하여", "경우")
ALONE = "*※"
#: A lead of so many characters, blanks aside, may join what it leads to.
LEAD_MOST = 80

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"^(?:제\s*\d+\s*[장절조]|[IVX]+\.|\d{1,2}(?:\.\d{1,2})*[.)]?\s|[①-⑩]|#+\s)")


def windows(text: str, most: int, least: int = PAGE_LEAST, overlap: int = OVERLAP) -> list[str]:
    """Overlapping windows that end at a line or sentence if one ends late enough."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text):
            soft = max(text.rfind("\n", start, end), text.rfind(". ", start, end))
            end = soft + 1 if soft > start + least else end
        out.append(text[start:end].strip())
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return [w for w in out if w]


def packed(pieces: list[str], most: int) -> list[str]:
    """Neighbouring pieces joined by line ends while they fit."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + 1 + len(piece) <= most:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
    return out


def _is_open(block: str) -> bool:
    """A short heading, or what stands below one, that ends in the middle of a sentence."""
    last = block.rsplit("\n", 1)[-1].strip()
    return len("".join(block.split())) <= LEAD_MOST and (last.endswith(OPEN_ENDS) or (bool(last) and not last.strip(ALONE)))


def _says_nothing(block: str) -> bool:
    return not any(c.isalnum() for c in block)


def _blocks(text: str) -> list[str]:
    """Blocks of a page: they end at blank lines and before headings; decoration is left out, and an open lead joins the block behind it."""
    blocks: list[str] = []
    for part in re.split(r"\n\s*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        own: list[str] = []
        for line in filter(None, (re.sub(r"[ \t]+", " ", x).strip() for x in part.split("\n"))):
            if own and _HEADING.match(line):
                blocks.append("\n".join(own))
                own = []
            own.append(line)
        blocks += ["\n".join(own)] if own else []
    out: list[str] = []
    for block in blocks:
        if out and _is_open(out[-1]):
            out[-1] += "\n" + block
        elif not _says_nothing(block) or not block.strip(ALONE):
            out.append(block)
    return [b for b in out if not _says_nothing(b)]


def cut_page(text: str | None, most: int = PAGE_MOST, least: int = PAGE_LEAST) -> list[str]:
    """Chunks of a page from its blocks: long ones are cut at sentences, then by windows, each piece under the block's heading; short ends join the chunk before."""
    pieces: list[str] = []
    for block in _blocks(text or ""):
        if len(block) <= most:
            pieces.append(block)
            continue
        head = block.split("\n", 1)[0]
        room = most - len(head) - 1 if _HEADING.match(head) and len(head) < most // 4 else most
        cuts = packed([w for s in _SENTENCE.split(block) for w in windows(s, room)], room)
        pieces += [c if room == most or c.startswith(head) else f"{head}\n{c}" for c in cuts]
    out: list[str] = []
    for chunk in packed(pieces, most):
        if out and len(chunk) < least and not _HEADING.match(chunk):
            out[-1] += "\n" + chunk
        else:
            out.append(chunk)
    return out


_TOC = re.compile(r"(?:\.{3,}|·{3,}|…+)\s*\d+\s*$")


def _is_contents(text: str) -> bool:
    """A table of contents: named so, or three lines or more that lead to numbers."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return bool(lines) and (re.sub(r"\s", "", lines[0]).lower() in ("목차", "차례", "contents", "tableofcontents") or sum(bool(_TOC.search(x)) for x in lines) >= 3)


class _DocumentChunks:
    """Chunks of the pages of one document, which come in order; the last heading passes from page to page."""

    def __init__(self) -> None:
        self.parent, self.order = "", 0

    def eval(self, page: Row) -> Iterator[tuple]:
        no = page["page_no"]
        for text in cut_page(page["text"]):
            if _is_contents(text):
                continue
            first = text.split("\n", 1)[0].strip()
            if _HEADING.match(first):
                self.parent = first
            title = first if 0 < len(first) <= LEAD_MOST else ""
            shown = f"chunk {self.order + 1}" if no is None else f"page {no}"
            yield page["document_id"], self.order, no, shown, self.parent or title, title or shown, text
            self.order += 1


def document_chunks(pages: DataFrame) -> DataFrame:
    """(document_id, chunk_order, page_no, chunk_no, parent_title, chunk_title, chunk_text) of pages (document_id, page_no, text).

    A table function gets a document's pages in their order, one at a time, and
    keeps only the heading that the next page continues, so documents of any
    length are streamed.  Pages without a number come first and are numbered by
    chunk; equal numbers are ordered by text; tables of contents are left out.
    """
    types = "document_id long, chunk_order int, page_no int, chunk_no string, parent_title string, chunk_title string, chunk_text string"
    rows = pages.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_no").cast("int").alias("page_no"), F.col("text").cast("string").alias("text"))
    cut = F.udtf(_DocumentChunks, returnType=types)
    return cut(rows.asTable().partitionBy("document_id").orderBy("page_no", "text"))


def _joined(parts: list[tuple[str, str]], wanted) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for key, text in parts:
        if out and wanted(out[-1], (key, text)) and len(out[-1][1]) + 1 + len(text) <= CHILD_MOST:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{text}")
        else:
            out.append((key, text))
    return out


def _balanced(text: str) -> list[str]:
    """A text in as few parts as fit, of about the same size, cut at the line or sentence end nearest to where it should be."""
    n = -(-len(text) // CHILD_MOST)
    ends, cuts = [m.end() for m in re.finditer(r"\n|[.!?]\s", text)], [0]
    for k in range(1, n):
        aim = len(text) * k // n
        near = [e for e in ends if abs(e - aim) <= CHILD_LEAST // 2 and e > cuts[-1]]
        cuts.append(min(near, key=lambda e: abs(e - aim), default=aim))
    return [text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _without_orphans(parts: list[tuple[str, str]], may) -> list[tuple[str, str]]:
    """Tiny parts join a neighbour if that fits, the one before first, or else share its text anew so that none stays tiny."""
    out: list[tuple[str, str]] = []
    rest = list(reversed(parts))
    while rest:
        part = rest.pop()
        if len(part[1]) >= TINY:
            out.append(part)
            continue
        before, after = (out[-1] if out else None), (rest[-1] if rest else None)
        for left, right, of in ((before, part, out), (part, after, rest)):
            if left is None or right is None or not may(left, right):
                continue
            whole = f"{left[1]}\n{right[1]}"
            pieces = [whole] if len(whole) <= CHILD_MOST else _balanced(whole)
            if all(TINY <= len(p) <= CHILD_MOST for p in pieces) or len(pieces) == 1:
                of.pop()
                out += [(left[0], p) for p in pieces]
                break
        else:
            out.append(part)
    return out


def plan_sections(sections: list[tuple[str, str]], keep_parents: bool = False) -> list[tuple[str, str]]:
    """(parent key, text) children of a statute's sections: neighbours of one parent joined, short ones merged, contained short ones dropped."""
    parents: list[tuple[str, list[str]]] = []
    for key, text in ((k, t.strip()) for k, t in sections if t and t.strip()):
        if parents and parents[-1][0] == key:
            parents[-1][1].append(text)
        else:
            parents.append((key, [text]))
    children = [(k, w) for k, texts in parents for p in packed(texts, CHILD_MOST) for w in ([p] if len(p) <= CHILD_MOST else windows(p, CHILD_MOST, CHILD_LEAST))]
    may = lambda a, b: not keep_parents or a[0] == b[0]
    children = _joined(children, lambda a, b: may(a, b) and len(a[1]) < CHILD_LEAST)
    children = _joined(children, lambda a, b: may(a, b) and len(b[1]) < CHILD_LEAST)
    children = _without_orphans(children, may)
    plain = [" ".join(t.split()) for _, t in children]
    inside = lambda i: TINY <= len(plain[i]) < CHILD_LEAST and any(len(o) > len(plain[i]) and plain[i] in o for j, o in enumerate(plain) if j != i)
    return [c for i, c in enumerate(children) if not inside(i)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(texts: pd.Series) -> pd.Series:
    return texts.map(cut_page)


_CHILD = T.ArrayType(T.StructType([T.StructField("parent_key", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_CHILD)
def _planned(sections: pd.Series) -> pd.Series:
    return sections.map(lambda rows: [{"parent_key": k, "text": t} for k, t in plan_sections([(r["key"], r["text"]) for r in rows])])


def page_chunks(pages: DataFrame) -> DataFrame:
    """(document_id, page_no, chunk_order, chunk_text) of pages (document_id, page_no, text)."""
    return pages.select("document_id", "page_no", F.posexplode(_cut("text")).alias("chunk_order", "chunk_text"))


def section_children(sections: DataFrame) -> DataFrame:
    """(document_id, child_order, parent_key, text) of sections (document_id, sort_order, key, text); a document's sections are one row."""
    rows = sections.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sort_order", "key", "text"))).alias("s"))
    return rows.select("document_id", F.posexplode(_planned("s")).alias("child_order", "c")).select("document_id", "child_order", "c.parent_key", "c.text")


def embedding_text(title: Column, parent: Column, heading: Column, kind: Column, page: Column, body: Column) -> Column:
    """Header lines that aren't blank, then the text."""
    line = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    return F.trim(F.concat_ws("\n", line("문서", title), line("상위 섹션", parent), line("섹션", heading), F.concat(F.lit("섹션유형: "), kind), line("페이지", page.cast("string")), F.lit("본문:"), F.trim(F.coalesce(body, F.lit("")))))


def heading_score(line: Column, general: list[str], domain: list[str]) -> Column:
    """How much a line looks like a heading; 3 or more, with a sign of one, is."""
    n, s = F.length(line), lambda c, v: F.when(c, v).otherwise(0)
    structural, has = line.rlike(_HEADING.pattern), lambda words: F.lower(line).rlike("|".join(words))
    ends = line.rlike(r"(다|요|함|됨)?[.!]$")
    score = s(structural, 2) + s(n <= 80, 1) + F.when(ends, -2).otherwise(1) + s(has(general), 1) + s(has(domain), 1) + s(n > 100, -2) + s(F.regexp_count(line, F.lit("[,，]")) >= 2, -2) + s(line.rlike("[?？]"), -2)
    return F.when((F.trim(line) == "") | (n > 120), 0).otherwise(score)


def section_kind(parent: Column, heading: Column, text: Column) -> Column:
    """The kind of a section by its heading's words, else by all its words.

    Words are plain, so they are looked for as bytes and not by a regular
    expression; both texts are bound by an array of one, so that each is made once a row.
    """
    tight = lambda *c: F.regexp_replace(F.lower(F.concat_ws(" ", *c)), r"\s+", "")

    def has(where: Column, words: list[str]) -> Column:
        found = F.contains(where, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(where, F.lit(word))
        return found

    def by_words(x: Column) -> Column:
        out = F.when(has(x["whole"], ["목차", "contents"]), "toc")
        for where in (x["head"], x["whole"]):
            for words, kind in ((SCOPE, "target_scope"), (EXCEPTION, "exception"), (REQUIREMENT, "requirement"), (PROCEDURE, "procedure")):
                out = out.when(has(where, words), kind)
        return out.when(has(x["whole"], EXAMPLE), "example")

    def with_whole(x: Column) -> Column:
        return F.struct(x["head"].alias("head"), F.concat(x["head"], x["text"]).alias("whole"))

    made = F.transform(F.array(F.struct(tight(parent, heading).alias("head"), tight(text).alias("text"))), with_whole)
    table = (F.contains(text, F.lit("|")) | F.contains(text, F.lit("\t"))) & text.rlike(r"(?m)^(.*\|){3,}|(\t.*){3,}")
    return F.coalesce(F.transform(made, by_words)[0], F.when(table, "table").otherwise("body"))


def inferred_organisation(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """(document_id, organisation, confidence): an override by document first (high, or review if its guard isn't in the title), else a rule on the text.

    The table of overrides is written by hand; Spark broadcasts it when it is small.
    """
    o = overrides.select("document_id", F.col("organisation").alias("forced"), "guard")
    joined = rows.join(o, "document_id", "left")
    found = F.regexp_extract("text", r"(\p{IsHangul}{2,12}(?:부|처|청|위원회|공사|공단))", 1)
    org = F.coalesce("forced", F.when(found != "", found), F.col("agency_name"))
    sure = F.when(F.col("forced").isNotNull(), F.when(F.contains("title", F.col("guard")), "high").otherwise("review")).when(found != "", "medium").otherwise("low")
    return joined.select("document_id", org.alias("organisation"), sure.alias("confidence"))


def first_per_document(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).filter(F.col("n") <= n)
