"""Ranked lexical search over a clustered index.

Documents are reordered by recursive graph bisection: halves of the graph of
documents and terms swap documents while that shortens the logarithms of the
gaps between a term's documents, and each half is cut again.  The bisection is
fitted on about ``SAMPLE`` documents; what it learns at each cut (how many bits
a term saves on either side) routes every document of the corpus to its leaf.
A leaf is stored in shards of about ``SHARD_ROWS`` documents, so that a large
group of copies is many shards.  A shard holds the postings of the terms asked
for, and for each term its greatest impact.

A question's bound in a shard is the sum of its terms' weights times these
greatest impacts.  Shards are visited by bound, the ``FIRST`` best, then the
``NEXT`` best, then all whose bound still reaches the k-th best score so far:
equal bounds are visited, since a tie may go to a smaller doc_id, so stopping
is exact.  Questions and thresholds are sent to the shards, never postings to
questions, and are bounded: more than ``MOST_PAIRS`` pairs of question and term
are searched in blocks, each with an index of its own.

Terms are the maximal runs of letters and digits of ASCII and of all other
characters, only A-Z lower-cased.  N counts documents with a term, L their
terms.  A term in df documents weighs floor(1000 * ln((2N + 2) / (2df + 1)));
m is 50 + 50nN div L for a document of n terms; its score sums, over a
question's terms, weight * (1000000000tf div (1000tf + 20m)), in whole numbers.

Defined cases: null and empty texts have no terms and are never found; rows
that repeat an item_id are one question with the terms of all; a null item_id
is a question of its own; repeated documents are all ranked, equal scores by
doc_id (nulls last), then by row; empty tables give no rows; extra columns are
ignored.  Questions without a hit give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import bounded_batches, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = [c if chr(c).isalnum() or c > 127 else 32 for c in range(256)]
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in _KEPT)

#: The bisection is fitted on about so many documents, so many terms of each, and the commonest terms among them.
SAMPLE, SAMPLE_TERMS, MODEL_TERMS = 2048, 256, 20_000
DEPTH, SWAPS = 6, 12
SHARD_ROWS = 4096
FIRST, NEXT = 2, 16
MOST_PAIRS = 200_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _terms_of(text: Column) -> Column:
    lower = F.call_function("translate", text, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


class Graph:
    """Documents and the terms they hold, as a flat list of edges in the order of documents."""

    def __init__(self, docs: int, edge_doc: np.ndarray, edge_term: np.ndarray, terms: int):
        self.docs, self.edge_doc, self.edge_term, self.terms = docs, edge_doc, edge_term, terms

    def degrees(self, members: np.ndarray) -> np.ndarray:
        return np.bincount(self.edge_term[members[self.edge_doc]], minlength=self.terms)


def _bits(n: int, degree: np.ndarray) -> np.ndarray:
    """Bits of the gaps between ``degree`` documents among n, for each term."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisected(graph: Graph, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``members`` (document numbers): pairs swap while that saves bits."""
    half = len(members) // 2
    left = np.zeros(graph.docs, bool)
    left[members[:half]] = True
    right = np.zeros(graph.docs, bool)
    right[members[half:]] = True
    for _ in range(SWAPS):
        a, b, n, k = graph.degrees(left), graph.degrees(right), half, len(members) - half
        now = _bits(n, a) + _bits(k, b)
        out = now - _bits(n, np.maximum(a - 1, 0)) - _bits(k, b + 1)
        back = now - _bits(n, a + 1) - _bits(k, np.maximum(b - 1, 0))
        on_left = left[graph.edge_doc]
        gain = np.bincount(graph.edge_doc, np.where(on_left, out[graph.edge_term], back[graph.edge_term]), graph.docs)
        ls, rs = np.flatnonzero(left), np.flatnonzero(right)
        ls, rs = ls[np.argsort(-gain[ls], kind="stable")], rs[np.argsort(-gain[rs], kind="stable")]
        m = min(len(ls), len(rs))
        swapped = np.flatnonzero(gain[ls[:m]] + gain[rs[:m]] > 1e-9)
        if not len(swapped):
            break
        left[ls[swapped]], right[ls[swapped]], left[rs[swapped]], right[rs[swapped]] = False, True, True, False
    return np.flatnonzero(left), np.flatnonzero(right)


class Order:
    """The cuts of the bisection: for each known term the bits it saves on the left of every cut."""

    def __init__(self, numbers: dict[bytes, int], saved: np.ndarray):
        self.numbers, self.saved = numbers, saved

    def leaf(self, known: list[int]) -> int:
        node, sums = 0, self.saved[known].sum(axis=0)
        for _ in range(DEPTH):
            node = 2 * node + (1 if sums[node] >= 0 else 2)
        return node - (2**DEPTH - 1)


def fitted(samples: list[list[bytes]]) -> Order:
    """Cuts learnt from the terms of sampled documents."""
    df = Counter(t for own in samples for t in own)
    common = sorted((t for t, n in df.items() if n > 1), key=lambda t: (-df[t], t))[:MODEL_TERMS]
    numbers = {t: i for i, t in enumerate(common)}
    edges = [[numbers[t] for t in own if t in numbers] for own in samples]
    graph = Graph(len(samples), np.repeat(np.arange(len(samples)), [len(e) for e in edges]), np.array([t for e in edges for t in e], np.int64), len(numbers))
    saved = np.zeros((len(numbers) + 1, 2**DEPTH - 1), np.float32)
    groups = {0: np.arange(len(samples))}
    for node in range(2**DEPTH - 1):
        members = groups.pop(node)
        left, right = bisected(graph, members) if len(members) > 1 else (members, members[:0])
        groups[2 * node + 1], groups[2 * node + 2] = left, right
        if len(left) and len(right):
            a, b = (graph.degrees(np.isin(np.arange(graph.docs), side)) for side in (left, right))
            saved[:-1, node] = np.log2((a + 1) / (b + 1)) - np.log2((len(left) + 1) / (len(right) + 1))
    return Order(numbers, saved)


def learn_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Order:
    """The bisection of about ``SAMPLE`` documents, chosen by hash; of a long one the ``SAMPLE_TERMS`` terms of least hash."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.octet_length(text_col)), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            own = [sorted(set(terms(t)), key=zlib.crc32)[:SAMPLE_TERMS] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.binary()))], ["terms"])

    found = chosen.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "terms array<binary>").collect()
    return fitted(sorted([bytes(t) for t in r["terms"]] for r in found))


def tokenised(docs: DataFrame, vocabulary: dict[bytes, int], order: Order, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n, leaf, terms, tfs) of every document with a term; of its terms those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, cuts = shared.value
        for batch in batches:
            kept, ns, leaves, ids, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = terms(text)
                if not own:
                    continue
                counts = Counter(own)
                found = [(v, c) for t, c in counts.items() if (v := asked.get(t)) is not None]
                kept.append(i)
                ns.append(len(own))
                leaves.append(cuts.leaf([k for t in counts if (k := cuts.numbers.get(t)) is not None]))
                ids.append([v for v, _ in found])
                tfs.append([c for _, c in found])
            rows = [batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())), pa.array(ns, pa.int64()), pa.array(leaves, pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "row", "n", "leaf", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n long, leaf int, terms array<int>, tfs array<long>")


def shards(found: DataFrame, count: int, length: int) -> DataFrame:
    """One row for each shard of tokenised documents: ids, and the postings and greatest impact of each term, as packed numbers."""
    sizes = {r["leaf"]: -(-r["count"] // SHARD_ROWS) for r in found.groupBy("leaf").count().collect()}  # 2**DEPTH rows at most
    parts = F.element_at(F.array(*[F.lit(sizes.get(leaf, 1)) for leaf in range(2**DEPTH)]), F.col("leaf") + 1)
    dealt = found.filter(F.size("terms") > 0).withColumn("shard", F.col("leaf") + 2**DEPTH * F.pmod(F.xxhash64("row"), parts))

    def pack(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        held, tf = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(rows)), np.diff(held.offsets.to_numpy()))
        m = 50 + 50 * rows.column("n").to_numpy() * count // length
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        term = held.flatten().to_numpy(zero_copy_only=False)
        by = np.argsort(term, kind="stable")
        known, starts = np.unique(term[by], return_index=True)
        ids = rows.column("doc_id")
        parts = [
            ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy().astype(np.int8), rows.column("row").to_numpy().astype(np.int64), known.astype(np.int32),
            starts.astype(np.int32), np.maximum.reduceat(impact[by], starts).astype(np.int32), doc[by].astype(np.int32), impact[by].astype(np.int32),
        ]
        return pa.table({"shard": [rows.column("shard")[0].as_py()], **{name: [p.tobytes()] for name, p in zip(PACKED, parts, strict=True)}})

    return dealt.groupBy("shard").applyInArrow(pack, "shard long, " + ", ".join(f"{n} binary" for n in PACKED))


#: Columns of a shard, each an array of numbers of the type beside it.
PACKED = {"ids": "<i8", "lost": "i1", "rows": "<i8", "known": "<i4", "starts": "<i4", "most": "<i4", "docs": "<i4", "impacts": "<i4"}


def _unpacked(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), [np.frombuffer(batch.column(j + 1)[i].as_py(), PACKED[n]) for j, n in enumerate(names)]


def _placed(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a question's terms a shard knows, and where."""
    at = np.searchsorted(known, asked)
    there = at < len(known)
    there[there] = known[at[there]] == asked[there]
    return there, at[there]


def bounds(index: DataFrame, questions: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(question, shard, bound): what a document of the shard can score at most, where that isn't zero."""
    shared, names = index.sparkSession.sparkContext.broadcast(questions), ["known", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, (known, most) in _unpacked(batch, names):
                found = []
                for asked, weights in shared.value:
                    there, at = _placed(known, asked)
                    found.append(int((weights[there] * most[at]).sum()))
                found = np.array(found, np.int64)
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), shard, np.int64)), pa.array(found[some])], ["question", "shard", "bound"])

    return index.select("shard", *names).mapInArrow(run, "question int, shard long, bound long")


def visited(index: DataFrame, questions: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray, only: dict[int, list[int]] | None, but: dict[int, list[int]]) -> DataFrame:
    """(question, doc_id, row, score): the k best documents of each visit, if they reach the question's ``least``.

    A shard is visited for the questions that ``only`` names, or else for all whose bound there reaches ``least`` but those in ``but``.
    """
    shared = index.sparkSession.sparkContext.broadcast((questions, least, only, but))
    if only is not None:
        index = index.filter(F.col("shard").isin(sorted(only)))  # FIRST + NEXT shards a question at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_all, lows, wanted, done = shared.value
        for batch in batches:
            for shard, (ids, lost, rows, known, starts, most, docs, impacts) in _unpacked(batch, list(PACKED)):
                ends = np.append(starts[1:], len(docs))
                skip = set(done.get(shard, ()))
                for q in range(len(asked_all)) if wanted is None else wanted.get(shard, ()):
                    if q in skip:
                        continue
                    asked, weights = asked_all[q]
                    there, at = _placed(known, asked)
                    weights = weights[there]
                    if (weights * most[at]).sum() < lows[q]:
                        continue
                    score = np.zeros(len(ids), np.int64)
                    for w, a in zip(weights.tolist(), at.tolist(), strict=True):
                        score[docs[starts[a] : ends[a]]] += w * impacts[starts[a] : ends[a]].astype(np.int64)
                    best = np.flatnonzero(score >= lows[q])
                    if len(best) > k:  # ties with the k-th are told by doc_id
                        best = best[score[best] >= np.partition(score[best], len(best) - k)[len(best) - k]]
                        best = best[np.lexsort((rows[best], ids[best], lost[best], -score[best]))[:k]]
                    if len(best):
                        out = [pa.array(np.full(len(best), q, np.int32)), pa.array(ids[best], mask=lost[best] == 1), pa.array(rows[best]), pa.array(score[best])]
                        yield pa.RecordBatch.from_arrays(out, ["question", "doc_id", "row", "score"])

    return index.select("shard", *PACKED).mapInArrow(run, "question int, doc_id long, row long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, order: Order, pairs: list, k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(p["term"]) for p in pairs}))}
    items = sorted({p["item_id"] for p in pairs}, key=lambda i: (i is None, i))
    found = written(tokenised(docs, vocabulary, order, id_col, text_col), "tokenised")
    whole = found.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    count, length = whole["count"], max(1, whole["length"])
    df = {r["term"]: r["count"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # as many as the vocabulary
    weight = {v: math.floor(1000 * math.log((2 * count + 2) / (2 * df.get(v, 0) + 1))) for v in vocabulary.values()}
    by_item = {item: [] for item in items}
    for p in pairs:
        by_item[p["item_id"]].append(vocabulary[bytes(p["term"])])
    questions = [(np.array(sorted(by_item[i]), np.int32), np.array([weight[v] for v in sorted(by_item[i])], np.int64)) for i in items]

    index = written(shards(found, count, length), "shards")
    by_bound = Window.partitionBy("question").orderBy(F.desc("bound"), "shard")
    ahead = bounds(index, questions).withColumn("no", F.row_number().over(by_bound)).filter(F.col("no") <= FIRST + NEXT).collect()
    least, parts, done = np.ones(len(items), np.int64), [], {}
    for low, high in ((0, FIRST), (FIRST, FIRST + NEXT)):
        only: dict[int, list[int]] = {}
        for r in ahead:
            if low < r["no"] <= high and r["bound"] >= least[r["question"]]:
                only.setdefault(r["shard"], []).append(r["question"])
                done.setdefault(r["shard"], []).append(r["question"])
        parts.append(written(visited(index, questions, k, least, only, {}), "visited"))
        so_far = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        kth = _best(so_far, k).filter(F.col("rank") == k).select("question", "score").collect()  # one row a question
        for r in kth:
            least[r["question"]] = r["score"]
    parts.append(visited(index, questions, k, least, None, done))
    names = docs.sparkSession.createDataFrame([(n, i) for n, i in enumerate(items)], "question int, item_id long")
    best = _best(parts[0].unionByName(parts[1]).unionByName(parts[2]), k)
    return best.join(F.broadcast(names), "question").select("item_id", "rank", "doc_id", "score")  # as many as the block's questions


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each question."""
    bounded_batches(docs.sparkSession)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(_terms_of(F.col(item_text).cast("string"))).alias("term")).distinct()
    asked = written(asked.select("item_id", F.encode("term", "UTF-8").alias("term")), "asked")
    order, blocks = learn_order(docs, id_col, text_col), max(1, -(-asked.count() // MOST_PAIRS))
    out = None
    for b in range(blocks):
        # Blocks are of whole questions.
        pairs = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _search_block(docs, order, pairs, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out
