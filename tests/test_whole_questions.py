"""Queries that search by the whole of a question: terms behind its 24th, and more than the rarest six, find their chunks."""

import pytest
from pyspark.sql import functions as F

from quern.operators import lexical, scan
from quern.plans import evaluation, operations, retrieval, selection

QUERIES = {k: f for p in (evaluation, operations, retrieval, selection) for k, f in p.QUERIES.items()}
#: (query_id, chunk_id): by terms behind the 24th; the same in a title; by terms behind the six rarest.
LATE, TITLED, COMMON = (0, 7_000_001), (0, 8_000_000), (1, 17_000_001)


def _finds(*hits):
    return lambda rows: set(hits) <= {(r["query_id"], r["chunk_id"]) for r in rows}


CASES = {
    "audit_groups": _finds(LATE, COMMON),  # F1
    "base_scores": _finds(LATE),  # F2
    "candidate_merge": _finds(LATE),  # F3
    "case_verdicts": lambda rows: {r["case_id"]: "w01" in r["matched_terms"].split() for r in rows}[0],  # F4
    "coverage_policy_grid": lambda rows: sorted((r["policy"], r["questions"], r["hits"]) for r in rows) == [(i, 1, 1) for i in range(5)],  # F5
    "coverage_rescue": lambda rows: (0, 7_000_002, "APPLIED") in {(r["query_id"], r["chunk_id"], r["state"]) for r in rows},  # F6
    "direct_preservation": _finds(LATE, COMMON),  # F7
    "diversified_candidates": _finds(LATE, COMMON),  # F8
    "evidence_judge": _finds(LATE),  # F9
    "expansion_chunks": _finds(TITLED),  # F10
    "expansion_fusion": _finds(LATE, TITLED, COMMON),  # F11
    "gate_summary": lambda rows: {r["case_class"]: r["passed"] for r in rows}["curated"] == 1,  # F12
    "hydrated_hits": _finds(LATE, COMMON),  # F13
    "judge_candidates_quota": _finds(LATE, COMMON),  # F14
    "keyword_scores": _finds(LATE, COMMON),  # F15
    "neighbour_context": _finds(LATE, COMMON),  # F16
    "title_lookup": lambda rows: (0, 8, 0) in {(r["query_id"], r["document_id"], r["way"]) for r in rows},  # F17
}


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    texts = {i + 1: f"zz\nw{29 - i}" for i in range(6)} | {i + 11: f"zz\nv{i}" for i in range(6)}
    texts |= {1: "zz\nw29\nw29", 7: "zz\nw00 w01 w02\nw00x", 8: "w00 w03 w04", 17: "zz\nv6 v7", 18: "zz\nv6 v7 zz"}
    documents = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    asked = [(0, " ".join(f"w{i:02}" for i in range(29, -1, -1))), (1, " ".join(f"v{i}" for i in range(8)))]
    documents.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(CASES))
def test_the_whole_question_is_searched_by(spark, at, name):
    assert CASES[name](QUERIES[name](spark, at).collect())


def test_more_hits_than_are_kept_are_searched_again(spark, at, monkeypatch):
    want = sorted(retrieval.bm25_hits(spark, at, 8, whole=True).collect())
    monkeypatch.setattr(retrieval, "MOST_HITS", 2)
    assert len(want) > 4 and sorted(retrieval.bm25_hits(spark, at, 8, whole=True).collect()) == want


def test_few_matches_at_once_give_the_same(spark, at, monkeypatch):
    fields = {"document_title": "title", "body": "chunk_text"}
    own, asked = retrieval.chunks(spark, at).repartition(2), retrieval.asked_terms(spark, at, whole=True)
    postings = lexical.postings(own, fields)
    lengths, known = lexical.chunk_lengths(own, postings), lexical.known_terms(asked, lexical.term_stats(postings))
    whole = tuple(lengths.agg(F.count(F.lit(1)), F.sum("weighted_length")).first())
    for most in (1, 3, 1 << 21):
        monkeypatch.setattr(scan, "MATCHES", most)
        assert sorted(scan.bm25(known, whole, own, fields, 3).collect()) == sorted(lexical.bm25(known, postings, lengths, 3).collect())
        want = lexical.prefix_search(asked, postings, 3)
        assert sorted(scan.prefix_search(asked, own, fields, 3).select(*want.columns).collect()) == sorted(want.collect())
