"""Corpus audits and operations: profiles, gaps, duplicates, versions, integrity, ledgers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.cleaning import compact, missing, unpunctuated, visible_text
from quern.sources.scratch import written


def first_match(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds; null conditions don't hold."""
    out = None
    for condition, label in cases:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def latest_versions(chunks: DataFrame) -> DataFrame:
    """Active, searchable chunks of each document's highest version among those."""
    usable = chunks.filter("use_yn = 'Y' and activation_status = 'ACTIVE' and coalesce(quality_status, 'PASS') in ('PASS', 'REVIEW')")
    newest = F.max("chunk_version").over(Window.partitionBy("document_id"))
    return usable.withColumn("newest", newest).filter("chunk_version = newest").drop("newest")


def version_status(documents: DataFrame, today: str) -> DataFrame:
    """CURRENT for the latest effective rows of a version group, else FUTURE, PAST or UNKNOWN; unversioned rows are CURRENT."""
    started = F.when((F.col("use_yn") == "Y") & (F.col("effective_date") <= today), F.col("effective_date"))
    group = Window.partitionBy("target", "canonical_key")
    rows = documents.withColumn("newest", F.max(started).over(group))
    status = first_match(
        (~F.col("versioned"), "CURRENT"), ((F.col("use_yn") == "Y") & (F.col("effective_date") == F.col("newest")), "CURRENT"),
        (F.col("effective_date").isNull(), "UNKNOWN"), (F.col("effective_date") > today, "FUTURE"), otherwise="PAST",
    )
    return rows.withColumn("effective_status", status).drop("newest")


def is_stale(status: Column, indexed_hash: Column, content_hash: Column, found: Column) -> Column:
    """No embedding, a failed one, or one of other content; null hashes are equal."""
    return ~found | F.coalesce(status.isin("FAILED", "ERROR"), F.lit(False)) | (F.coalesce(indexed_hash, F.lit("")) != F.coalesce(content_hash, F.lit("")))


def integrity_cause(active: Column, content_hash: Column, indexed_hash: Column, status: Column, point: Column, point_exists: Column) -> Column:
    """Why an index entry can't be trusted, or null."""
    state = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    same = F.coalesce(F.lower(F.trim(content_hash)) == F.lower(F.trim(indexed_hash)), F.lit(False))
    return first_match(
        (state == "", "MISSING_EMBEDDING_ROW"), (state.isin("FAILED", "ERROR"), "RETRYABLE_EMBEDDING_FAILURE"), (~same, "CONTENT_HASH_MISMATCH"),
        (point.isNull() | ~point_exists, "QDRANT_POINT_MISSING"), (state != "INDEXED", "STALE_DATABASE_STATUS"), (~active, "INACTIVE_CHUNK_COUNTED"),
    )


def length_profile(chunks: DataFrame, *groups: str) -> DataFrame:
    n = F.length("chunk_text")
    below = [F.count_if(n < v).alias(f"lt{v}") for v in (20, 80, 200)]
    above = [F.count_if(n > v).alias(f"gt{v}") for v in (1200, 2500)]
    return chunks.groupBy(*groups).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(n), 1).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), *below, *above)


def parent_projection(chunks: DataFrame) -> DataFrame:
    """Per target: parents, and the children they would be cut into at 1,800 characters beyond 2,500."""
    n = F.length("chunk_text")
    parents = chunks.groupBy("target", "document_id", "parent_key").agg(
        F.count(F.lit(1)).alias("source_chunks"), F.sum(n).alias("text_len"), F.count_if(n < 20).alias("lt20"), F.count_if(n < 80).alias("lt80")
    )
    children = F.when(F.col("text_len") <= 2500, 1).otherwise(F.ceil(F.col("text_len") / 1800))
    return parents.groupBy("target").agg(
        F.count(F.lit(1)).alias("parent_groups"), F.sum("source_chunks").alias("source_chunks"), F.sum(children).alias("projected_child_chunks"),
        F.round(F.avg("text_len"), 1).alias("avg_parent_len"), F.max("text_len").alias("max_parent_len"), F.sum("lt20").alias("lt20"), F.sum("lt80").alias("lt80"),
    )


def gaps(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group: rows, and for each column how many are null or blank."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(F.col(c))).alias(f"no_{c}") for c in columns])


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """Groups of equal keys: how many, their members, and the members beyond the first."""
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


#: Characters of a run by which texts meet, and neighbouring runs of which the one of least hash is kept.
RUN, NEAR = 12, 24


#: Characters of a document in which each short chunk is sought as it is; longer documents have an index of runs.
SOUGHT = 1 << 16


def _kept(text: str | None) -> list[int]:
    """Hashes of a text's runs, of ``NEAR`` neighbours the least: a text of RUN + NEAR - 1 characters or more shares all of its own with any text that holds it."""
    if not text or len(text) < RUN + NEAR - 1:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashed = np.zeros(len(codes) - RUN + 1, np.uint64)
    for i in range(RUN):
        hashed = hashed * np.uint64(6364136223846793005) + (codes[i : i + len(hashed)] + np.uint64(1442695040888963407))
    hashed ^= hashed >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashed, NEAR).min(axis=1)).astype(np.int64).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _kept_runs(texts: pd.Series) -> pd.Series:
    return texts.map(_kept)


def _holders(ids: list[int], sizes: list[int], bodies: list[str], least: int, most: int) -> Iterator[tuple[int, int]]:
    """(chunk, holder of least id) of a document's short chunks that lie in a longer one."""
    short = [i for i, n in enumerate(sizes) if least <= n < most and bodies[i]]
    if len(short) * len(bodies) < 2:
        return
    order = sorted(range(len(ids)), key=ids.__getitem__)
    whole = "\n".join(bodies)  # a compact text has no line end
    index: dict[int, list[int]] = {}
    if len(whole) > SOUGHT:
        for i in order:
            for run in _kept(bodies[i]):
                index.setdefault(run, []).append(i)
    for i in short:
        body, among = bodies[i], order
        runs = _kept(body) if index else []
        if runs:
            among = min((index[run] for run in runs), key=len)
        elif whole.find(body, whole.find(body) + 1) < 0:  # it lies in itself only
            continue
        held = next((j for j in among if sizes[j] > sizes[i] and body in bodies[j]), None)
        if held is not None:
            yield ids[i], ids[held]


def contained_short_lines(documents: DataFrame, least: int = 80, most: int = 800) -> DataFrame:
    """``contained_short`` of documents (document_id, chunks array<struct<chunk_id, chunk_text>>) whose ids differ: a row has all that is compared, so nothing is shuffled."""
    packed = F.transform("chunks", lambda c: F.struct(c["chunk_id"].cast("long").alias("chunk_id"), F.coalesce(F.length(c["chunk_text"]), F.lit(0)).alias("n"), compact(c["chunk_text"]).alias("body")))
    rows = documents.filter((F.size("chunks") > 1) & F.exists("chunks", lambda c: F.length(c["chunk_text"]).between(least, most - 1))).select(F.col("document_id").cast("long").alias("document_id"), packed.alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("chunks")
            ids, sizes, bodies = [x.to_pylist() for x in lists.flatten().flatten()]
            ends, found = np.cumsum(np.asarray(lists.value_lengths())).tolist(), []
            for document, a, b in zip(batch.column("document_id").to_pylist(), [0, *ends], ends, strict=False):
                found += [(document, *x) for x in _holders(ids[a:b], sizes[a:b], bodies[a:b], least, most)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["document_id", "chunk_id", "holder_id"])

    return rows.mapInArrow(run, "document_id long, chunk_id long, holder_id long")


def contained_short(chunks: DataFrame, least: int = 80, most: int = 800) -> DataFrame:
    """Short chunks whose compact text lies in a longer chunk of their document; (document_id, chunk_id, holder_id), the holder of least id.

    Chunks meet by an inverted index of runs of characters: a short one by the
    rarest of its kept runs in the document, so a document of many lines makes
    few pairs, and contains() decides.  Compact texts too short for a run meet
    all longer chunks of their document.
    """
    rows = chunks.select("document_id", "chunk_id", F.length("chunk_text").alias("n"), compact(F.col("chunk_text")).alias("body"))
    index = rows.select("document_id", "chunk_id", "n", F.explode(_kept_runs(F.col("body"))).alias("run"))
    counts = index.groupBy("document_id", "run").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    own = index.filter(F.col("n").between(least, most - 1)).join(counts, ["document_id", "run"])
    rarest = own.groupBy("document_id", "chunk_id", "n").agg(F.min(F.struct("holders", "run")).alias("r")).select("document_id", F.col("chunk_id").alias("short_id"), F.col("n").alias("short_n"), F.col("r.run").alias("run"))
    pairs = rarest.join(index, ["document_id", "run"]).filter("n > short_n").select("document_id", "short_id", "chunk_id")
    body = lambda name: rows.select("document_id", F.col("chunk_id").alias(name), F.col("body").alias(f"{name}_body"))
    pairs = pairs.withColumnRenamed("chunk_id", "holder_id").join(body("short_id"), ["document_id", "short_id"]).join(body("holder_id"), ["document_id", "holder_id"])
    tiny = rows.filter(F.col("n").between(least, most - 1) & (F.col("body") != "") & (F.length("body") < RUN + NEAR - 1)).select("document_id", F.col("chunk_id").alias("short_id"), "n", F.col("body").alias("short_id_body"))
    longer = rows.select("document_id", F.col("chunk_id").alias("holder_id"), F.col("n").alias("m"), F.col("body").alias("holder_id_body"))
    pairs = pairs.unionByName(tiny.join(longer, "document_id").filter("m > n").select(*pairs.columns))
    return pairs.filter(F.contains("holder_id_body", F.col("short_id_body"))).groupBy("document_id", F.col("short_id").alias("chunk_id")).agg(F.min("holder_id").alias("holder_id"))


#: Leaves in a bucket of the lowest level, about; each node has up to 16 children.
BUCKET = 64


def merkle_tree(leaves: DataFrame) -> DataFrame:
    """(level, node, hash, leaves) of a hash tree over leaves (key, hash), both strings, the root at level 0.

    A leaf lies where the hash of its key says, a hexadecimal digit a level, so
    an insertion moves no other leaf and no task holds more than a bucket; depth
    follows from the number of leaves.  A bucket hashes its leaves
    ``key=hash`` in the order of key and hash, a node its children ``digit:hash``
    in the order of digits.  Null keys and hashes are empty; without leaves the root is the hash of nothing.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = leaves.select(F.sha2(none("key"), 256).alias("place"), F.struct(none("key").alias("key"), none("hash").alias("hash")).alias("leaf"))
    depth = max(0, math.ceil(math.log(max(1, leaves.count()) / BUCKET, 16)))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("leaf")), lambda x: F.concat(x["key"], F.lit("="), x["hash"])), "\n")
    level = rows.groupBy(F.substring("place", 1, depth).alias("node")).agg(F.sha2(listed, 256).alias("hash"), F.count(F.lit(1)).alias("leaves"))
    if not depth:
        level = leaves.sparkSession.range(1).select(F.lit("").alias("node")).join(level, "node", "left").select("node", F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("hash"), F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"))
    level = written(level, "level")
    out = level.select(F.lit(depth).alias("level"), "node", "hash", "leaves")
    for n in range(depth - 1, -1, -1):
        child = F.struct(F.substring("node", n + 1, 1).alias("digit"), "hash")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat(x["digit"], F.lit(":"), x["hash"])), "\n")
        level = written(level.groupBy(F.substring("node", 1, n).alias("node")).agg(F.sha2(joined, 256).alias("hash"), F.sum("leaves").alias("leaves")), "level")
        out = out.unionByName(level.select(F.lit(n).alias("level"), "node", "hash", "leaves"))
    return out


def changed_leaves(before: DataFrame, after: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, path) of what differs between leaves ``old`` and ``new`` with trees ``before`` and ``after``: only leaves below the differing nodes are compared.

    ``path`` names the node at the lowest level that both trees have.
    """
    depth = min(before.agg(F.max("level")).first()[0], after.agg(F.max("level")).first()[0])
    side = lambda t, name: t.filter(F.col("level") == depth).select("node", F.col("hash").alias(name))
    if before.agg(F.max("level")).first()[0] == after.agg(F.max("level")).first()[0]:
        nodes = side(before, "a").join(side(after, "b"), "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    else:  # trees of different depth hash their nodes differently
        nodes = side(before, "a").select("node").union(side(after, "b").select("node")).distinct()
    below = lambda leaves, name: leaves.select("key", F.substring(F.sha2(F.coalesce("key", F.lit("")), 256), 1, depth).alias("node"), F.col("hash").alias(name)).join(nodes, "node", "left_semi")
    both = below(old, "was").withColumn("in_old", F.lit(True)).join(below(new, "is").withColumn("in_new", F.lit(True)), ["key", "node"], "full_outer")
    change = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").when(~F.col("was").eqNullSafe(F.col("is")), "CHANGED")
    return both.select("key", change.alias("change"), F.col("node").alias("path")).filter("change is not null")


def dedup_plan(files: DataFrame) -> DataFrame:
    """Equal files of a folder: the one to keep by references, plain name, age and path, and what each other frees.

    files: path, dir, size, mtime, sha256, unsuffixed, doc_refs, imported_refs.
    """
    order = Window.partitionBy("dir", "sha256").orderBy(F.desc("doc_refs"), F.desc("imported_refs"), F.desc("unsuffixed"), "mtime", "path")
    group = Window.partitionBy("dir", "sha256")
    rows = files.withColumn("n", F.row_number().over(order)).withColumn("members", F.count(F.lit(1)).over(group))
    rows = rows.withColumn("canonical_path", F.first("path").over(order)).filter("members > 1")
    return rows.select("dir", "sha256", "path", "canonical_path", (F.col("n") == 1).alias("canonical"), F.when(F.col("n") > 1, F.col("size")).otherwise(0).alias("recoverable_bytes"))


def failure_class(c: dict[str, Column]) -> Column:
    """The step of the retrieval chain at which a question without an answer was lost, from its counters."""
    none = lambda name: c[name] == 0
    says = lambda text: F.contains(F.coalesce(c["diagnostic"], F.lit("")), F.lit(text))
    some = (c["topic_aligned"] > 0) | (c["relevant"] > 0) | says("직접 근거")
    return first_match(
        ((c["result_msg"] == "OK") & (c["final"] > 0), "NONE"), (says("운영 내부 상태"), "UNSUPPORTED_OPERATIONAL_STATUS"),
        (says("근거를 만들어내") | says("문서를 있다고 말"), "UNSUPPORTED_FABRICATION_REQUEST"), (c["scope_mismatch"], "DOCUMENT_SCOPE_MISMATCH"),
        ((c["vector_hits"] > 0) & none("vector_chunks") & none("lexical_chunks"), "INDEX_DB_MAPPING_MISMATCH"),
        (none("merged") | (none("vector_hits") & none("lexical_chunks")), "SEARCH_NO_CANDIDATE"), (none("ranked"), "RANKING_DROPPED_ALL"),
        (none("intent_filtered"), "DICTIONARY_OR_INTENT_GAP"), (none("judge_candidates"), "JUDGE_CANDIDATE_EMPTY"),
        (none("judged") & none("direct") & some, "JUDGE_NO_DIRECT_EVIDENCE"), (none("judged") & says("핵심 개념"), "JUDGE_NO_CONCEPT_EVIDENCE"),
        (none("judged"), "JUDGE_REJECTED_ALL"), (none("final"), "CHUNK_QUALITY_REJECTED"), (c["result_msg"] == "NO_GROUNDS", "EVIDENCE_SELECTION_REJECTED"),
        otherwise="PIPELINE_INCONSISTENT",
    )


# Words of page navigation and of actions on it, and signs of substance in a short text.
NAVIGATION = "상단 메뉴 버튼 첨부파일 다운로드 클릭 이용하십시오 download attachment click menu button".split()
ACTIONS = "클릭 선택 누르 이동 다운로드 열기 확인 click select press move download open confirm".split()
NOTICE = "첨부 첨부파일 상단 메뉴 클릭 버튼 화면 이미지 다운로드 누르 이용".split()
STRONG_NOTICE = "자세한내용 확인하십시오 이용하십시오 상단메뉴 상단첨부파일 첨부파일을다운로드 버튼을이용 메뉴를이용 첨부파일을이용".split()
SUBSTANCE = "하여야 해야 기준 대상 절차 요건 의무 금지 제외 가능 신청 처리 보유 파기 동의 공개 고지 제출 심사 계약 설치 운영 관리".split()
SENTENCE_END = r"(?i)\A.*(?:다[.!?]?|함[.!?]?|됨[.!?]?)\z"
FIELD_LABEL = r"(?i)^(?:요구사항(?:분류|고유번호|명칭)|관련요구사항|준수항목|requirement\s*(?:id|name|type))\s*[:：-]?.{0,50}$"


def any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def holds_any(text: Column, words: list[str]) -> Column:
    """As ``any_of``, each word sought by itself: quicker on a column that has been made."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def short_class(text: Column) -> Column:
    """What a tiny chunk is."""
    seen = visible_text(text)
    tight = F.regexp_replace(seen, r"\s+", "")
    article = r"제\s*\d+\s*(조|항|호|목)"
    substance = seen.rlike(article) | any_of(seen, SUBSTANCE)
    strong = any_of(tight, STRONG_NOTICE) & any_of(tight, NOTICE) & ~tight.rlike(article)
    return first_match(
        (F.contains(F.lower(text), F.lit("<img")) & (F.length(tight) <= 20), "image_only"),
        (tight.rlike(r"^<[^>]{1,45}>?$") | tight.rlike(r"^\d{4}\.\d{1,2}\.\d{1,2}(,\d{4}\.\d{1,2}\.\d{1,2})*>?$"), "revision_marker"),
        ((F.length(seen) <= 160) & (strong | (any_of(seen, NOTICE) & ~substance)), "navigation_notice"),
        ((F.length(tight) <= 30) & tight.rlike(r"^[\d.,:;()\[\]\-_/\\]+$"), "layout_number"), (substance, "meaningful_short_evidence"),
        otherwise="ambiguous_short",
    )


def short_action(kind: Column) -> Column:
    return first_match(
        (kind.isin("image_only", "navigation_notice"), "suppress_or_downrank"), (kind == "revision_marker", "suppress_except_revision_questions"),
        (kind == "layout_number", "suppress"), (kind == "meaningful_short_evidence", "keep"), otherwise="manual_review",
    )


def quality_gate(chunks: DataFrame, head: Column | None = None) -> DataFrame:
    """Status and reason of each chunk (document_id, chunk_id, sort_order, title, chunk_text): duplicates count among those not rejected before.

    A chunk is judged where it lies; what meets those of its document is a digest.  ``head`` is the title's compact form where chunks bring it along.
    """
    seen, low, body = F.col("seen"), F.col("low"), F.col("body")
    rows = chunks.withColumn("head", compact(F.col("title")) if head is None else head).withColumn("seen", visible_text(F.col("chunk_text")))
    rows = rows.withColumn("low", F.lower("seen")).withColumn("body", unpunctuated(low)).withColumn("short", F.length("seen") <= 160)
    # An end that can't be a sentence's is seen without a search of the whole text, as is a beginning with eight letters.
    rows = rows.withColumn("sentence", F.when(F.substring("seen", -2, 2).rlike(r"[다함됨][.!?]?\z"), seen.rlike(SENTENCE_END)).otherwise(F.lit(False)))
    few = ~seen.rlike(r"\A(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){8}")
    marks = seen.rlike(r"(?i)\A\s*[p\^()\[\].,;:ㆍ·\-0-9]")
    squeezed = F.regexp_replace("seen", r"\s+", "")
    early = first_match(
        (F.trim("seen") == "", "EMPTY_TEXT"), (F.contains(seen, F.lit(".....")) & holds_any(low, ["contents", "목차"]), "TABLE_OF_CONTENTS"),
        (F.when(few | marks, (few & (F.length(squeezed) < 80)) | squeezed.rlike(r"(?i)^(p\.?\d+)?[\^()\[\].,;:ㆍ·\-0-9]+$")).otherwise(F.lit(False)), "MEANINGLESS_FRAGMENT"),
    )
    navigation = ~F.col("sentence") & holds_any(low, ACTIONS) & holds_any(low, [*NAVIGATION, ">", "→"])
    rest = F.regexp_replace(F.regexp_replace(low, "|".join(sorted(NAVIGATION + ACTIONS, key=len, reverse=True)), " "), r"[^\p{L}\p{N}]", "")
    heading = ~F.col("sentence") & (F.col("head") != "") & (F.contains("head", "body") | F.contains("body", "head"))
    long = F.when(F.length("seen") >= 120, "STRUCTURAL_CHECKS_PASSED").otherwise(F.when(F.col("sentence"), "SHORT_COMPLETE_STATEMENT").otherwise("SHORT_AMBIGUOUS"))
    alone = (
        F.when(seen.rlike(FIELD_LABEL), "FIELD_LABEL_ONLY").when(~F.col("short"), "STRUCTURAL_CHECKS_PASSED")
        .when(navigation, F.when(F.length(rest) >= 4, "NAVIGATION_WITH_SUBJECT").otherwise("NAVIGATION_NOTICE")).when(heading, "TITLE_OR_HEADING_ONLY").otherwise(long)
    )
    rows = rows.withColumn("early", early)
    digest = F.when(F.col("early").isNull() & (body != ""), F.unhex(F.sha2("body", 256)))
    rows = rows.select("document_id", "chunk_id", "sort_order", "early", F.when(F.col("early").isNull(), alone).alias("alone"), digest.alias("digest"))
    again = F.row_number().over(Window.partitionBy("document_id", "digest").orderBy("sort_order", "chunk_id"))
    rows = rows.withColumn("reason", F.when(F.col("digest").isNotNull() & (again > 1), "DUPLICATE_TEXT").otherwise(F.coalesce("early", "alone")))
    status = first_match(
        (F.col("early").isNotNull() | (F.col("reason") == "DUPLICATE_TEXT"), "REJECT"),
        (F.col("reason").isin("FIELD_LABEL_ONLY", "NAVIGATION_NOTICE", "TITLE_OR_HEADING_ONLY"), "CONTEXT_ONLY"),
        (F.col("reason").isin("NAVIGATION_WITH_SUBJECT", "SHORT_AMBIGUOUS"), "REVIEW"), otherwise="PASS",
    )
    return rows.select("document_id", "chunk_id", status.alias("status"), "reason")
