"""Vector search, fusion of ranked lists, coverage rescue and document expansion, for batches of questions.

Every list is a DataFrame keyed (query_id, target, chunk_id); ties are broken by
rounded score, then keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


#: Queries that are sent to all tasks at once, and that one product of matrices takes.
SENT, AT_ONCE = 8192, 256


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null or zero and has finite numbers only."""
    return vectors.filter(F.coalesce(F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def vector_search(queries: DataFrame, vectors: DataFrame, per_target: int = 50, total: int = 100, sent: int = SENT) -> DataFrame:
    """The nearest chunks by exact cosine, at most ``per_target`` of each target and ``total`` in all; equal ones by target and chunk_id.

    queries: (query_id, vector), a stated set that is sent in blocks of about
    ``sent``; vectors: (target, chunk_id, vector).  A task multiplies its Arrow
    batch with a block and gives each target's best of the batch only, so what
    is shuffled is a small share of the products.  Null, zero and non-finite
    vectors take no part.
    """
    asked, blocks, out = _usable(queries.select("query_id", "vector"), "vector"), max(1, -(-queries.count() // sent)), None
    rows = _usable(vectors, "vector").select(F.col("target").cast("string").alias("target"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"))
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        ids, matrix = np.array([r["query_id"] for r in block], np.int64), np.array([r["vector"] for r in block], float)
        if len(ids):
            shared = queries.sparkSession.sparkContext.broadcast((ids, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))
            found = rows.filter(F.size("vector") == matrix.shape[1]).mapInArrow(_nearest(shared, per_target), "query_id long, target string, chunk_id long, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, target string, chunk_id long, score double")
    each = Window.partitionBy("query_id", "target").orderBy(F.desc("score"), "chunk_id")
    best = out.withColumn("n", F.row_number().over(each)).filter(F.col("n") <= per_target).drop("n")
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("target").asc_nulls_first(), "chunk_id")
    return best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= total)


def _nearest(shared, most: int):
    """Each query's ``most`` best of each target in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(1).to_numpy(zero_copy_only=False)
            by_id = np.argsort(chunk, kind="stable")
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[by_id]
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            chunk, names = chunk[by_id], batch.column(0).take(pa.array(by_id)).dictionary_encode()
            codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            groups = [(names.dictionary[c].as_py() if c >= 0 else None, np.flatnonzero(codes == c)) for c in np.unique(codes).tolist()]
            for a in range(0, len(ids), AT_ONCE):
                score = np.round(matrix[a : a + AT_ONCE] @ vectors.T, 6)
                for target, at in groups:
                    # One whole number orders by score, then by id: a million steps of score, the place by id below.
                    key = np.rint(score[:, at] * 1e6).astype(np.int64) * len(at) + (len(at) - 1 - np.arange(len(at)))
                    k = min(most, len(at))
                    best = np.argpartition(key, len(at) - k, axis=1)[:, len(at) - k :]
                    n, found = len(best), at[best.ravel()]
                    values = np.take_along_axis(score[:, at], best, axis=1).ravel()
                    columns = [pa.array(np.repeat(ids[a : a + n], k)), pa.array([target] * (n * k), pa.string()), pa.array(chunk[found].astype(np.int64)), pa.array(values)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "target", "chunk_id", "score"])

    return run


def both_ranks(vector: DataFrame, lexical: DataFrame, keep_vector: bool = True, keep_lexical: bool = True) -> DataFrame:
    """(query_id, target, chunk_id, vector_rank, lexical_rank) of two lists, a key's least rank in each."""
    keys = ["query_id", "target", "chunk_id"]
    v = vector.groupBy(*keys).agg(F.min("rank").alias("vector_rank")).filter(F.lit(keep_vector))
    return v.join(lexical.groupBy(*keys).agg(F.min("rank").alias("lexical_rank")).filter(F.lit(keep_lexical)), keys, "full_outer")


def rrf(vector: DataFrame, lexical: DataFrame, w_vector: float = 1.0, w_lexical: float = 1.0, k: int = RRF_K, limit: int = 100) -> DataFrame:
    """Reciprocal rank fusion of two lists with ranks; a source of weight 0 or less gives no rows."""
    k = max(1, k)
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    both = both_ranks(vector, lexical, w_vector > 0, w_lexical > 0).withColumn("score", F.round(part(w_vector, "vector_rank") + part(w_lexical, "lexical_rank"), 9))
    both = both.withColumn("best_source_rank", F.least("vector_rank", "lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_source_rank", "target", "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, limit))


def coverage_rescue(fused: DataFrame, top_k: int = 30, most: int = 3, per_document: int = 1, source_limit: int = 40, enabled: bool = True) -> DataFrame:
    """Puts hits of one source behind the cut back in if their document is anchored by a hit of both sources before it.

    fused: ``rrf`` with document_id.  A question whose unprotected rows are
    fewer than its rescues falls back to the baseline; only APPLIED questions
    are cut to ``top_k``.  Columns: those of ``fused``, final_rank, state.
    """
    both = F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull()
    base = fused.withColumn("cross", both)
    anchors = base.filter(F.col("cross") & (F.col("rank") <= top_k)).groupBy("query_id", "document_id").agg(F.min("rank").alias("anchor_rank"))
    proposals = base.filter(~F.col("cross") & (F.col("rank") > top_k) & (F.col("best_source_rank") <= source_limit) & F.lit(enabled)).join(anchors, ["query_id", "document_id"])
    line = [F.col(c) for c in ("anchor_rank", "best_source_rank", "rank", "target", "document_id", "chunk_id")]
    in_doc = Window.partitionBy("query_id", "document_id").orderBy(*line)
    proposals = proposals.withColumn("n", F.row_number().over(in_doc)).filter(F.col("n") <= per_document)
    proposals = proposals.withColumn("rescue", F.row_number().over(Window.partitionBy("query_id").orderBy(*line))).filter(F.col("rescue") <= most)
    proposals = proposals.select("query_id", "target", "chunk_id", "rescue")
    wanted = proposals.groupBy("query_id").agg(F.max("rescue").alias("rescues"))
    rows = base.join(proposals, ["query_id", "target", "chunk_id"], "left").join(wanted, "query_id", "left")
    rows = rows.join(anchors.withColumnRenamed("anchor_rank", "a"), ["query_id", "document_id"], "left")
    protected = F.col("cross") & (F.col("rank") == F.col("a"))
    rows = rows.withColumn("loose", (F.col("rank") <= top_k) & ~F.coalesce(protected, F.lit(False)))
    from_last = Window.partitionBy("query_id", "loose").orderBy(F.desc("rank"))
    rows = rows.withColumn("from_last", F.row_number().over(from_last))
    query = Window.partitionBy("query_id")
    rows = rows.withColumn("spare", F.count(F.when(F.col("loose"), 1)).over(query))
    rows = rows.withColumn(
        "state",
        F.when(F.lit(not enabled), "DISABLED").when(F.col("rescues").isNull(), "NO_ELIGIBLE_SIBLING").when(F.col("spare") < F.col("rescues"), "FALLBACK").otherwise("APPLIED"),
    )
    stays = (F.col("state") != "APPLIED") | F.col("rescue").isNotNull() | ((F.col("rank") <= top_k) & ~(F.col("loose") & (F.col("from_last") <= F.col("rescues"))))
    rows = rows.filter(stays)
    appended = (F.col("state") == "APPLIED") & F.col("rescue").isNotNull()
    final = Window.partitionBy("query_id").orderBy(appended, F.when(appended, F.col("rescue")).otherwise(F.col("rank")))
    return rows.withColumn("final_rank", F.row_number().over(final)).select(*fused.columns, "final_rank", "state")


def title_seeds(hits: DataFrame, titles: DataFrame, planned: DataFrame, least: int = 2, most: int = 3, ratio: float = 0.05) -> DataFrame:
    """Documents whose titles hold at least ``least`` of a question's planned terms among their BM25 hits' matched terms.

    hits: ``bm25``; titles: (document_id, norm_title); planned: (query_id,
    term).  A question is dropped when the cut falls between documents with
    equally many terms whose scores differ by ``ratio`` or less, or when one of
    its hits is malformed (no document, or a score that isn't positive).
    """
    bad = hits.groupBy("query_id").agg(F.bool_or(F.col("document_id").isNull() | ~(F.col("score") > 0)).alias("bad")).filter("bad")
    hits = hits.join(bad, "query_id", "left_anti")
    by_doc = hits.groupBy("query_id", "document_id").agg(F.max("score").alias("bm25_score"), F.min("rank").alias("bm25_rank"), F.min("target").alias("target"))
    matched = hits.select("query_id", "document_id", F.explode("matched_terms").alias("term")).distinct()
    matched = matched.join(planned, ["query_id", "term"], "left_semi").join(titles, "document_id").filter(F.col("norm_title").contains(F.col("term")))
    terms = matched.groupBy("query_id", "document_id").agg(F.sort_array(F.collect_set("term")).alias("title_terms"))
    rows = by_doc.join(terms, ["query_id", "document_id"]).withColumn("n_terms", F.size("title_terms")).filter(F.col("n_terms") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("n_terms"), F.desc("bm25_score"), "bm25_rank", "target", "document_id")
    rows = rows.withColumn("seed_rank", F.row_number().over(order)).withColumn("next_terms", F.lead("n_terms").over(order)).withColumn("next_score", F.lead("bm25_score").over(order))
    close = (F.col("bm25_score") - F.col("next_score")) / F.col("bm25_score") <= ratio + 1e-12
    unclear = (F.col("seed_rank") == most) & (F.col("n_terms") == F.col("next_terms")) & close
    rows = rows.withColumn("unclear", F.bool_or(F.coalesce(unclear, F.lit(False))).over(Window.partitionBy("query_id")))
    return rows.filter(~F.col("unclear") & (F.col("seed_rank") <= most)).select("query_id", "target", "document_id", "title_terms", "bm25_score", "bm25_rank", "seed_rank")


def expansion_chunks(documents: DataFrame, chunks: DataFrame, planned: DataFrame, seen: DataFrame | None = None, per_document: int = 8, total: int = 24) -> DataFrame:
    """Chunks of chosen documents (query_id, document_id, seed_rank): headings first, then by how many terms they hold.

    ``seen`` (query_id, target, chunk_id) are left out before counting.
    """
    rows = documents.select("query_id", "document_id", "seed_rank").join(chunks.select("document_id", "target", "chunk_id", "chunk_text", "sort_order"), "document_id")
    if seen is not None:
        rows = rows.join(seen, ["query_id", "target", "chunk_id"], "left_anti")
    terms = planned.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    rows = rows.join(terms, "query_id", "left")
    count = F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower("chunk_text"), t)))
    rows = rows.withColumn("evidence", count)
    kind = F.when((F.col("sort_order") == 0) & (count > 0), 1).when(count > 0, 2).otherwise(3)
    rows = rows.withColumn("match_class", kind)
    each = Window.partitionBy("query_id", "document_id").orderBy("match_class", F.desc("evidence"), "sort_order", "chunk_id")
    rows = rows.withColumn("in_document", F.row_number().over(each)).filter(F.col("in_document") <= per_document)
    whole = Window.partitionBy("query_id").orderBy("seed_rank", "in_document")
    rows = rows.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= total)
    return rows.select("query_id", "document_id", "target", "chunk_id", "match_class", "evidence", "in_document", "rank")


def expansion_fusion(fused: DataFrame, expanded: DataFrame, k: int = RRF_K) -> DataFrame:
    """Adds 1 / (k + rank) of expanded chunks to the fused scores and ranks again."""
    keys = ["query_id", "target", "chunk_id"]
    extra = expanded.select(*keys, F.round(1.0 / (k + F.col("rank")), 9).alias("score"))
    both = fused.select(*keys, "score").unionByName(extra).groupBy(*keys).agg(F.round(F.sum("score"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "target", "chunk_id")
    return both.withColumn("rank", F.row_number().over(order))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists by (query_id, target, chunk_id); a key's first list, then its best rank, wins."""
    keys = ["query_id", "target", "chunk_id"]
    rows = first.select(*keys, "rank", "score", F.lit(0).alias("source")).unionByName(second.select(*keys, "rank", "score", F.lit(1).alias("source")))
    best = rows.groupBy(*keys).agg(F.min(F.struct("source", "rank", "score")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.source", "b.rank", "target", "chunk_id")
    return best.select(*keys, "b.source", F.col("b.score").alias("score"), F.row_number().over(order).alias("merged_rank"))


def target_quota(ranked: DataFrame, per_target: int = 6, priority: int = 8, limit: int = 30) -> DataFrame:
    """The first ``priority`` rows, then six of each target in the order targets are first met, then the rest, ``limit`` in all."""
    whole, each = Window.partitionBy("query_id"), Window.partitionBy("query_id", "target")
    rows = ranked.withColumn("first_met", F.min("rank").over(each)).withColumn("n", F.row_number().over(each.orderBy("rank")))
    kind = F.when(F.col("rank") <= priority, 0).when(F.col("n") <= per_target, 1).otherwise(2)
    order = whole.orderBy("quota_class", F.when(F.col("quota_class") == 1, F.col("first_met")).otherwise(0), "rank")
    return rows.withColumn("quota_class", kind).withColumn("quota_rank", F.row_number().over(order)).filter(F.col("quota_rank") <= limit).drop("first_met", "n")


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 2, chars: int = 2800) -> DataFrame:
    """Each hit with the lines around it in its document, cut at ``chars``: context for an answer."""
    line = Window.partitionBy("document_id").orderBy("sort_order")
    around = [F.lag("chunk_text", d).over(line) for d in range(radius, 0, -1)] + [F.col("chunk_text")] + [F.lead("chunk_text", d).over(line) for d in range(1, radius + 1)]
    wanted = hits.select("document_id").distinct()
    ctx = chunks.join(wanted, "document_id", "left_semi").select("chunk_id", F.substring(F.concat_ws("\n", *around), 1, chars).alias("context"))
    return hits.join(ctx, "chunk_id")


def diversified(ranked: DataFrame, prefix: int = 140) -> DataFrame:
    """Greedy by rank: a row goes if its key or its text's first characters were taken by an earlier row that stays."""

    def pick(pdf):
        keys, texts, keep = set(), set(), []
        for row in pdf.sort_values("rank").itertuples():
            text = (row.compact_text or "")[:prefix]
            ok = row.exact_key not in keys and (not text or text not in texts)
            keep.append((row.Index, ok))
            if ok:
                keys.add(row.exact_key), texts.add(text)
        return pdf.loc[[i for i, ok in keep if ok]]

    return ranked.groupBy("query_id").applyInPandas(pick, ranked.schema)
