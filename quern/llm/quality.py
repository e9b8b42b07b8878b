"""Quality by hierarchical empirical Bayes.

A classifier of a text's surface (character classes, repetition, lengths) gives
the document's own evidence.  Sites are then judged by all their documents:
a host's posterior shrinks the mean of its documents' evidence toward the
global prior, a path's toward its host's, each by a prior strength estimated
from the spread between groups.  A document's odds are those of its own
evidence times those of its path, its own share taken out of the path first.

Hosts are ``source`` and paths ``lang`` within it unless other columns are
named; nulls are a group of their own.  The classifier is fitted on about
``SAMPLE`` labelled texts of each class; the groups' statistics cover all rows.
Null and empty texts have no evidence of quality: they are rejected.  Without
labels of both classes the classifier gives the smoothed share of the one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.fitting import Logistic, sampled_texts
from quern.llm.shared import bounded_batches, written

SAMPLE = 4000
KEEP_FROM = 0.5
#: Prior strengths, in documents, are held within these bounds.
WEAKEST, STRONGEST = 2.0, 10_000.0
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words, lines = data.split(), data.split(b"\n")
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out = [counts[65:91].sum() / max(1, letters), counts[48:58].sum() / n, counts[128:].sum() / n, counts[10] / n, counts[32] / n, letters / n]
    out += [min(1.0, 10 * float(counts[b]) / n) for b in _PUNCTUATION]
    k = max(1, len(words))
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    return [float(v) for v in out] + [len(set(words)) / np.sqrt(k) / 10, len(set(words)) / k, len(set(lines)) / len(lines), runs, len(data) / k / 10, np.log1p(k)]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Logistic:
    bounded_batches(docs.sparkSession)
    sample = sampled_texts(docs, labels, label, SAMPLE, id_col, text_col).select("label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    seen = sample.mapInArrow(measure, "label int, x array<double>").toPandas()
    return Logistic.fit(np.array(seen["x"].tolist()).reshape(-1, len(features(""))), seen["label"].to_numpy(float))


def evidence(text: Column, model: Logistic) -> Column:
    """The classifier's probability that the text is good; null for texts without a word."""

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        p = model.predict(np.array([features(t) for t in texts])) if len(texts) else np.empty(0)
        return pd.Series(p).where([bool(t and not t.isspace()) for t in texts])

    return own(text)


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame) -> float:
    """Documents that the prior is worth: by moments, from the spread of the means of groups (columns n, s)."""
    row = groups.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"),
        F.sum("sq").alias("sq"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"),
    ).first()
    if not row["n"] or row["k"] < 2:
        return STRONGEST
    n, k = float(row["n"]), float(row["k"])
    mean = row["s"] / n
    within = max(1e-9, (row["sq"] - row["ss"]) / max(1.0, n - k))
    between = (row["ss"] - n * mean * mean - (k - 1) * within) / max(1e-9, n - row["nn"] / n)
    return float(min(STRONGEST, max(WEAKEST, within / between))) if between > 0 else STRONGEST


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, n, s, host_posterior, strength), global mean) from rows of (host, path, p): a row per path."""
    known = scored.filter("p is not null")
    paths = written(
        known.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("sq")), "paths"
    )
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq")), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = float(total[1] / total[0]) if total[0] else 0.5
    host_strength, path_strength = _strength(hosts), _strength(paths)
    of_host = hosts.select(
        F.col("host").alias("h"), ((F.lit(host_strength * mean) + F.col("s")) / (F.lit(host_strength) + F.col("n"))).alias("host_posterior")
    )
    joined = paths.join(of_host, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "host_posterior")
    return written(joined.withColumn("strength", F.lit(path_strength)), "sites"), mean


def _decided(rows: DataFrame, sites: DataFrame, mean: float) -> DataFrame:
    """``rows`` (with host, path, p) with host_posterior, path_posterior and score."""
    s = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_posterior", "strength")
    joined = rows.join(s, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left").drop("h", "q")
    base = F.coalesce("host_posterior", F.lit(mean))
    others = (F.col("strength") * base + F.col("s") - F.col("p")) / (F.col("strength") + F.col("n") - 1)
    joined = joined.withColumn("host_posterior", base).withColumn("path_posterior", F.coalesce(others, base))
    odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    return joined.withColumn("score", F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.0))).drop("n", "s", "strength")


def judge(
    docs: DataFrame, model: Logistic, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """(doc_id, doc_score, host_posterior, path_posterior, score, kept) of every document."""
    bounded_batches(docs.sparkSession)
    scored = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"),
            evidence(F.col(text_col), model).alias("p"),
        ),
        "evidence",
    )
    sites, mean = site_posteriors(scored)
    decided = _decided(scored, sites, mean)
    return decided.select(
        "doc_id", F.coalesce("p", F.lit(0.0)).alias("doc_score"), "host_posterior", "path_posterior", "score",
        (F.col("score") >= KEEP_FROM).alias("kept"),
    )


def keep_good(
    docs: DataFrame, model: Logistic, text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Rows are written once with their evidence, so that the classifier, far
    dearer than a read, sees each text once; only (host, path, evidence) is
    gathered for the groups.  The join with the groups moves no row while their
    table is small enough for Spark to broadcast it; beyond that rows are
    shuffled by host and path.  Null and blank texts have no evidence and go;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[host_col].cast("string").alias("host"),
        docs[path_col].cast("string").alias("path"), evidence(docs[text_col], model).alias("p"),
    )
    rows = written(rows, "evidence")
    sites, mean = site_posteriors(rows.select("host", "path", "p"))
    return _decided(rows, sites, mean).filter(F.col("score") >= KEEP_FROM).select("row.*")
