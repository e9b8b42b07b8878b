"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised apart, so that k + k centroids make
k * k cells.  A query visits centroid pairs in order of summed distance (here
the negative inner product, which is the sum over the halves) with a heap, until
the visited cells hold its share of the index and as many entries as it asks
for, or all; entries of visited cells are reranked by the exact measure in
double precision.

Codebooks are fitted on at most ``SAMPLE`` vectors, the first by hash of the id;
every vector is indexed.  The share is calibrated on the same sample: the least
that finds ``RECALL`` of the true neighbours of ``TRIALS`` of its vectors among
it.  A cell counts toward the share as at most ``CROWD`` mean cells, so that one
crowded cell doesn't use it up.  With vectors in clusters a small share
suffices; those that fill their space evenly need much of the index.  Where
more is wanted, ``share=1`` is exact.

Lists of first-half centroids are put in bins of about ``PART`` entries, longer
ones are dealt to several; a query goes to each bin that holds a cell it visits.

Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part.  Rows that repeat a query's id are never
its neighbours.  Fewer candidates than asked for are all returned; an empty
table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import written

SAMPLE = 20_000
STEPS = 12
RECALL, TRIALS = 0.96, 200
#: Mean entries of a cell, and centroids of a half at most.
CELL, CENTROIDS = 40, 256
CROWD = 4
PART = 8192


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = rows.filter("vec_id is not null and vector is not null").filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (sizes["d"] if sizes else 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    centroids = np.unique(x, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)]
    for _ in range(STEPS):
        own = _nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class Codebooks:
    """Centroids of both halves, and how much each cell counts toward a query's share."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.weights = np.zeros((len(first), len(second)))
        self.entries, self.share = self.weights, 1.0

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.half], self.first), _nearest(x[:, self.half :], self.second)

    def visits(self, q: np.ndarray, share: float, least: int = 0) -> dict[int, list[int]]:
        """Second-half centroids by first-half centroid of the cells that a query visits: its share, and ``least`` entries or all."""
        near, far = self.first @ q[: self.half], self.second @ q[self.half :]
        rows, columns = np.argsort(-near, kind="stable"), np.argsort(-far, kind="stable")
        wanted, got, held, out = share * self.weights.sum() if share < 1 else np.inf, 0.0, 0, {}
        heap, reached = [(-(near[rows[0]] + far[columns[0]]), 0, 0)], {(0, 0)}
        while heap and (got < wanted or held < least):
            _, i, j = heapq.heappop(heap)
            r, c = int(rows[i]), int(columns[j])
            if self.weights[r, c]:
                out.setdefault(r, []).append(c)
                got += self.weights[r, c]
                held += self.entries[r, c]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(rows) and b < len(columns) and (a, b) not in reached:
                    reached.add((a, b))
                    heapq.heappush(heap, (-(near[rows[a]] + far[columns[b]]), a, b))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def calibrated_share(x: np.ndarray, books: Codebooks, k: int = 20) -> float:
    """The least share that finds ``RECALL`` of the k nearest of the first vectors among the others."""
    c1, c2 = books.assign(x)
    cell = c1 * books.weights.shape[1] + c2
    total, needed = books.weights.sum(), []
    for i, q in enumerate(x[:TRIALS]):
        score = x @ q
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        order = np.argsort(-((books.first @ q[: books.half])[:, None] + (books.second @ q[books.half :])[None]), axis=None, kind="stable")
        reached = np.empty(len(order))
        reached[order] = np.cumsum(books.weights.ravel()[order])
        needed.append(reached[cell[best]] / max(total, 1e-9))
    every = np.sort(np.concatenate(needed)) if needed else np.empty(0)
    return float(every[min(len(every) - 1, int(RECALL * len(every)))]) if len(every) else 1.0


def _bins(entries: np.ndarray) -> dict[int, tuple[int, int]]:
    """(first bin, number of bins) by first-half centroid: short lists share a bin, long ones are dealt to several."""
    at, held, out = 0, 0, {}
    for c, n in enumerate(entries.astype(int).tolist()):
        if n:
            parts = -(-n // PART)
            if held and held + n > PART:
                at, held = at + 1, 0
            out[c] = (at, parts)
            at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


def build(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """(index table (vec_id, vector, c1, c2), codebooks) of ``usable`` vectors."""
    vectors = written(vectors, "vectors")
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vector"]
    x = np.array(sample.tolist(), float).reshape(len(sample), len(sample.iloc[0]) if len(sample) else 0)
    k = int(min(CENTROIDS, max(4, np.sqrt(n / CELL))))
    half = x.shape[1] // 2
    books = Codebooks(_kmeans(x[:, :half], k), _kmeans(x[:, half:], k)) if len(x) else Codebooks(np.zeros((1, 1)), np.zeros((1, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = books.assign(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], ["vec_id", "vector", "c1", "c2"])

    index = written(vectors.mapInArrow(run, "vec_id long, vector array<double>, c1 int, c2 int"), "index")
    counts = index.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 256 * 256 rows
    cells = np.zeros((len(books.first), len(books.second)))
    cells[counts["c1"], counts["c2"]] = counts["n"]
    books.entries = cells
    books.weights = np.minimum(cells, CROWD * cells[cells > 0].mean()) if len(counts) else cells
    books.share = calibrated_share(x, books) if len(x) else 1.0
    return index, books


def search(index: DataFrame, books: Codebooks, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, vector), ties to the smaller id."""
    share = books.share if share is None else share
    bins, width, cells = _bins(books.entries.sum(1)), len(books.second), books.entries.size

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                rows = batch.slice(a, 200)
                at, bin_, own = [], [], []
                # A query's own rows, all that repeat its id, are no candidates.
                for i, (q, same) in enumerate(zip(_matrix(rows.column(1)), rows.column(2).to_pylist(), strict=True)):
                    visited: dict[int, list[int]] = {}
                    for c, second in books.visits(q, share, k + same).items():
                        first, parts = bins[c]
                        for b in range(first, first + parts):
                            visited.setdefault(b, []).extend(c * width + s for s in second)
                    at += [i] * len(visited)
                    bin_ += visited
                    own += visited.values()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bin_, pa.int32()), pa.array([1] * len(at), pa.int32()), rows.column(0).take(take), pa.array(own, pa.list_(pa.int32())), rows.column(1).take(take)],
                    ["bin", "kind", "id", "cells", "vector"],
                )

    same = index.groupBy("vec_id").agg(F.count(F.lit(1)).alias("same"))
    asked = queries.select("vec_id", "vector").join(same, "vec_id", "left").select("vec_id", "vector", F.coalesce("same", F.lit(0)).alias("same"))
    asked = asked.mapInArrow(route, "bin int, kind int, id long, cells array<int>, vector array<double>")
    of_list = lambda j: F.create_map(*[x for c, v in (bins or {0: (0, 1)}).items() for x in (F.lit(c), F.lit(v[j]))])[F.col("c1")]
    held = index.select(
        (of_list(0) + F.pmod(F.xxhash64("vec_id"), of_list(1))).cast("int").alias("bin"), F.lit(0).alias("kind"),
        F.col("vec_id").alias("id"), F.array(F.col("c1") * width + F.col("c2")).alias("cells"), "vector",
    )
    # Entries come first within a bin: they are held, at most about PART of them, while the queries stream past.
    both = held.unionByName(asked).repartition("bin").sortWithinPartitions("bin", "kind")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        whole: tuple | None = None
        for batch in batches:
            keys, kinds, names = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lists, x = batch.column(3), _matrix(batch.column(4))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
                if here != keys[a]:
                    here, parts, whole = keys[a], [], None
                if kinds[a] == 0:
                    parts.append((names[a:b], lists[a:b].flatten().to_numpy(), x[a:b]))
                elif parts:
                    whole = whole or tuple(map(np.concatenate, zip(*parts, strict=True)))
                    for s in range(a, b, 64):
                        e = min(b, s + 64)
                        yield _best(names[s:e], x[s:e], lists[s:e], whole, cells, k)

    found = both.mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(names: np.ndarray, queries: np.ndarray, lists: pa.Array, held: tuple, n_cells: int, k: int) -> pa.RecordBatch:
    """The k best entries of one bin for each query; products of the shortlist are summed alike for all entries."""
    ids, cells, vectors = held
    rough = queries @ vectors.T
    out: tuple[list, list, list] = ([], [], [])
    for name, q, own, s in zip(names, queries, lists, rough, strict=True):
        visited = np.zeros(n_cells, bool)
        visited[own.values.to_numpy()] = True
        at = np.flatnonzero(visited[cells] & (ids != name))
        if len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= least - 1e-9 * (1 + abs(least))]
        score = (vectors[at] * q).sum(1)
        best = np.lexsort((ids[at], -score))[:k]
        out[0].extend([name] * len(best)), out[1].extend(ids[at][best]), out[2].extend(score[best])
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])
