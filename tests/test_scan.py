"""Searches by passes over the texts, and words of whole columns, against the functions for single texts and for stored postings."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions.terms import index_terms, keywords
from quern.functions.words import index_words, keyword_words, listed
from quern.operators import lexical, scan
from quern.plans import operations, retrieval
from quern.sources.scratch import shared_dir

FIELDS = {"document_title": "title", "body": "chunk_text"}


def _texts(n, seed):
    rng = random.Random(seed)
    own = [*"abZ09,,, .\n\t-", "é", "×", "÷", "À", "ÿ", "1,2", "ab", "12,34"]
    other = [*own, "Ā", "한글은", "이", "검토대상", "\x00", "ﬁ", "𝒜", "K"]
    return [None if rng.random() < 0.05 else "".join(rng.choices(own if rng.random() < 0.7 else other, k=rng.randint(0, 30))) for _ in range(n)] + ["x" * 80, "x" * 81, "1,", "2", ",3", "12"]


@pytest.mark.parametrize("of_column,of_one", [(index_words, index_terms), (keyword_words, keywords)])
def test_words_of_columns_equal_those_of_texts(of_column, of_one):
    texts = pa.array(_texts(3000, 1))
    for column in (texts, texts.slice(100, 700), texts.slice(0, 0), pa.array([None, ""], pa.string())):
        assert listed(len(column), *of_column(column)).to_pylist() == [of_one(t) for t in column.to_pylist()]


def test_scans_equal_searches_over_postings(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{'abc'[i % 3]}{i}" for i in range(40)] + ["한국", "조달청"]
    text = lambda n: None if rng.random() < 0.05 else " ".join(rng.choices(words, k=n))
    rows = [(rng.choice(["en", "de", None]), i, i // 4, text(3), text(rng.randint(0, 12))) for i in range(600)]
    chunks = spark.createDataFrame(rows + [("en", 1000 + i, 300, "wa0 wa0", "wb1 wc2") for i in range(30)], "target string, chunk_id long, document_id long, title string, chunk_text string").repartition(5)
    questions = spark.createDataFrame([(f"q{i}", " ".join(rng.choices([*words, "wa", "wb1", "none"], k=6))) for i in range(9)], "query_id string, question string")
    asked = lexical.query_terms(questions)
    postings = lexical.postings(chunks, FIELDS)
    lengths, stats = lexical.chunk_lengths(chunks, postings), lexical.term_stats(postings)
    for sent in (4096, 2):
        for name in ("SENT", "TERMS"):
            monkeypatch.setattr(scan, name, sent)
        made = scan.statistics(asked, chunks, FIELDS)
        whole = tuple(made.filter("term is null").select("chunks", "length").first())
        assert whole == tuple(lengths.agg(F.count(F.lit(1)), F.sum("weighted_length")).first())
        own = made.filter("term is not null").select("term", "document_frequency")
        assert sorted(own.collect()) == sorted(stats.join(asked.select("term").distinct(), "term").collect())
        chosen = lexical.selected_terms(asked, own, budget=150)
        assert sorted(scan.bm25(chosen, whole, chunks, FIELDS, 7).collect(), key=str) == sorted(lexical.bm25(chosen, postings, lengths, 7).collect(), key=str)
        want = lexical.prefix_search(asked, postings, 7).select("query_id", "target", "chunk_id", "matched_term_count", "term_score", "rank")
        assert sorted(scan.prefix_search(asked, chunks, FIELDS, 7).select(*want.columns).collect(), key=str) == sorted([r for r in want.collect()], key=str)
    monkeypatch.setattr(scan, "CELLS", 64)
    monkeypatch.setattr(scan, "BYTES", 100)
    assert sorted(scan.prefix_search(asked, chunks, FIELDS, 7).select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    none = asked.filter("false")
    assert scan.prefix_search(none, chunks, FIELDS).count() == 0 and scan.statistics(none, chunks, FIELDS).count() == 1


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path.removeprefix("file://")) for f in files)


def test_retrieval_writes_no_postings(spark, tmp_path):
    os.symlink("/root/testdata/sf0.01", at := f"{tmp_path}/in")
    before = _size(shared_dir(spark))
    assert retrieval.keyword_prefix_search(spark, at).count() and operations.title_lookup(spark, at).count()
    assert retrieval.chunk_lengths(spark, at).count() == 9344
    assert _size(shared_dir(spark)) - before < os.path.getsize(f"{at}/documents.parquet") / 3


def test_keywords_are_cut_by_the_column(spark):
    df = spark.createDataFrame([(1, 1, "Alpha beta", "src", "alpha GAMMA 한국의 조달청은"), (2, 1, None, None, None)], "chunk_id long, document_id long, p string, t string, b string")
    found = lexical.keyword_index(df, {"parent_title": "p", "chunk_title": "t", "body": "b"})
    assert sorted((r["term"], r["field_kind"]) for r in found.collect()) == sorted([("src", "chunk_title"), ("alpha", "parent_title"), ("beta", "parent_title"), *[(t, "body") for t in ["gamma", *keywords("한국의 조달청은")]]])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_replace" not in plan
