"""Measuring retrieval by stages: hits, survival, presence of what answers need, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("vectorHits", "lexicalHits")
DOWNSTREAM = ("merged", "fused", "selected")


def _meets(terms: Column, text: Column) -> Column:
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(text, t))


def stage_hits(items: DataFrame, gold: DataFrame, stages: tuple[str, ...] = SOURCES + DOWNSTREAM) -> DataFrame:
    """Per case and stage: a hit is one item that has a term of every group of gold terms.

    items: query_id, stage, document_text, section_text; gold: query_id,
    document_terms, section_terms (arrays; an empty one asks for nothing).
    """
    grid = gold.select("query_id", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    rows = items.join(gold, "query_id")
    d, s = _meets(F.col("document_terms"), F.col("document_text")), _meets(F.col("section_terms"), F.col("section_text"))
    hits = rows.groupBy("query_id", "stage").agg(
        F.count(F.lit(1)).alias("candidates"), F.bool_or(d & s).alias("direct_hit"), F.bool_or(d).alias("document_hit"), F.bool_or(s).alias("section_hit")
    )
    out = grid.join(hits, ["query_id", "stage"], "left")
    return out.select("query_id", "stage", F.coalesce("candidates", F.lit(0)).alias("candidates"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("direct_hit", "document_hit", "section_hit")])


def survival(hits: DataFrame, downstream: tuple[str, ...] = DOWNSTREAM) -> DataFrame:
    """Per case: whether the sources found it and the first stage that lost it."""
    at = lambda s: F.bool_or((F.col("stage") == s) & F.col("direct_hit"))
    found = F.bool_or(F.col("stage").isin(*SOURCES) & F.col("direct_hit"))
    rows = hits.groupBy("query_id").agg(found.alias("entered"), *[at(s).alias(f"in_{s}") for s in downstream])
    lost = F.coalesce(*[F.when(~F.col(f"in_{s}"), F.lit(s)) for s in downstream])
    return rows.select("query_id", "entered", F.when(~F.col("entered"), "candidateSources").otherwise(lost).alias("first_drop_stage"), *[(F.col("entered") & F.col(f"in_{s}")).alias(f"survived_{s}") for s in downstream])


def presence(matches: DataFrame, cases: DataFrame, downstream: tuple[str, ...] = DOWNSTREAM) -> DataFrame:
    """Where the groups of terms an answer needs are lost.  matches: query_id, stage, group_no; cases: query_id, groups (count)."""
    at = lambda cond: F.count_distinct(F.when(cond, F.col("group_no")))
    n = matches.groupBy("query_id").agg(at(F.col("stage").isin(*SOURCES)).alias("candidate"), *[at(F.col("stage") == s).alias(f"n_{s}") for s in downstream])
    rows = cases.join(n, "query_id", "left").fillna(0, ["candidate", *[f"n_{s}" for s in downstream]])
    full = lambda c: F.col(c) == F.col("groups")
    kind = (
        F.when(F.col("groups") == 0, "NO_EXPLICIT_ORACLE").when(F.col("candidate") == 0, "ABSENT_FROM_TOP_K_CANDIDATES").when(~full("candidate"), "PARTIAL_IN_CANDIDATES")
        .when(full(f"n_{downstream[-1]}"), "PRESENT_IN_SELECTED").otherwise("DROPPED_BEFORE_SELECTED")
    )
    rows = rows.withColumn("classification", kind)
    lost = F.coalesce(*[F.when(~full(f"n_{s}"), F.lit(s)) for s in downstream], F.lit(downstream[-1]))
    first = F.when(F.col("classification").isin("ABSENT_FROM_TOP_K_CANDIDATES", "PARTIAL_IN_CANDIDATES"), "candidateSources").when(F.col("classification") == "DROPPED_BEFORE_SELECTED", lost)
    return rows.select("query_id", "groups", F.col("candidate").alias("candidate_groups"), "classification", first.alias("first_loss_stage"))


def summary(hits: DataFrame) -> DataFrame:
    """Rates per stage; null where nothing could be hit."""
    rate = lambda c: F.round(F.try_divide(F.count_if(F.col(c)), F.count(F.lit(1))), 6)
    return hits.groupBy("stage").agg(F.count(F.lit(1)).alias("cases"), F.count_if("direct_hit").alias("direct_hits"), rate("direct_hit").alias("direct_rate"), rate("document_hit").alias("document_rate"), rate("section_hit").alias("section_rate"))


def duplicate_cases(cases: DataFrame, *keys: str) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first_id")).filter("n > 1")


def selected_policy(results: DataFrame) -> DataFrame:
    """The policy with most questions found, then most hits, then the smallest number; results: policy, questions, hits."""
    return results.orderBy(F.desc("questions"), F.desc("hits"), "policy").limit(1)


#: The weights that others must beat.
BASELINE = (1.0, 1.0)


def weight_metrics(measured: DataFrame) -> DataFrame:
    """Per run and weights: cases, those with all and with any of their groups, and groups met in all.

    measured: (run, w_first, w_second, case_id, met, required), a row for each case; cases that require nothing are left out.
    """
    rows = measured.filter("required > 0").withColumn("whole", F.col("met") >= F.col("required")).withColumn("some", F.col("met") > 0)
    keys = ["run", "w_first", "w_second"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if("whole").alias("all_required"), F.count_if("some").alias("any_required"), F.sum("met").alias("groups"))


def selected_weights(measured: DataFrame) -> DataFrame:
    """Which weights two runs agree on: one row for each pair of weights, with its status and why it isn't eligible.

    Weights are eligible in a run if more cases have all their groups than
    under the baseline, no case that passed there fails, and no fewer have any.
    A run's winner has most whole cases, then cases with any group, then
    groups; then it is nearest to equal weights, then has smaller ones.  Both
    runs must improve and have the same winner, or the baseline stays.  Numbers
    over both runs count cases that hold in each of them.
    """
    keys = ["run", "w_first", "w_second"]
    rows = measured.filter("required > 0").select(*keys, "case_id", (F.col("met") >= F.col("required")).alias("whole"), (F.col("met") > 0).alias("some"))
    metrics = weight_metrics(measured)
    is_base = (F.col("w_first") == BASELINE[0]) & (F.col("w_second") == BASELINE[1])
    base = metrics.filter(is_base).select("run", F.col("all_required").alias("base_all"), F.col("any_required").alias("base_any"))
    passed = rows.filter(is_base & F.col("whole")).select("run", "case_id")
    # Cases of the training split: a bounded set, listed as reasons.
    lost = rows.filter("not whole").join(passed, ["run", "case_id"], "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("case_id")).alias("lost"))
    judged = metrics.join(base, "run").join(lost, keys, "left")
    none = F.array().cast("array<string>")
    shown = lambda name, a, b: F.concat(F.lit(f"{name}:"), F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
    reasons = F.concat(
        F.when(F.col("all_required") <= F.col("base_all"), F.array(shown("ALL_REQUIRED_NOT_IMPROVED", "all_required", "base_all"))).otherwise(none),
        F.coalesce(F.transform("lost", lambda c: F.concat(F.lit("BASELINE_CASE_REGRESSION:"), c.cast("string"))), none),
        F.when(F.col("any_required") < F.col("base_any"), F.array(shown("ANY_REQUIRED_REGRESSION", "any_required", "base_any"))).otherwise(none),
    )
    judged = judged.withColumn("reasons", F.when(is_base, F.array(F.lit("BASELINE"))).otherwise(reasons)).withColumn("eligible", F.size("reasons") == 0)
    # The first in a run is the greatest of one struct.
    order = F.struct("all_required", "any_required", "groups", (-F.abs(F.log(F.col("w_first") / F.col("w_second")))).alias("near"), (-F.col("w_first")).alias("a"), (-F.col("w_second")).alias("b"))
    best = judged.groupBy("run").agg(F.max(F.when(F.col("eligible"), order)).alias("best"))
    winners = best.select("run", F.when(F.col("best").isNotNull(), F.struct((-F.col("best.a")).alias("w_first"), (-F.col("best.b")).alias("w_second"))).alias("winner"))
    agreed = winners.agg(F.count("winner").alias("improved"), F.count(F.lit(1)).alias("runs"), F.count_distinct("winner").alias("different"), F.any_value("winner", True).alias("winner"))
    status = F.when((F.col("improved") == F.col("runs")) & (F.col("different") == 1), "RECOMMENDED").when(F.col("improved") > 0, "NO_STABLE_TRAINING_IMPROVEMENT").otherwise("NO_TRAINING_IMPROVEMENT")
    agreed = agreed.select(status.alias("status"), F.when(status == "RECOMMENDED", F.col("winner")).otherwise(F.struct(F.lit(BASELINE[0]).alias("w_first"), F.lit(BASELINE[1]).alias("w_second"))).alias("choice"))
    both = rows.groupBy("w_first", "w_second", "case_id").agg(F.bool_and("whole").alias("whole"), F.bool_and("some").alias("some"))
    both = both.groupBy("w_first", "w_second").agg(F.count_if("whole").alias("all_required"), F.count_if("some").alias("any_required"))
    tagged = F.transform("reasons", lambda r: F.concat(F.lit("RUN"), F.col("run").cast("string"), F.lit(":"), r))
    over = judged.withColumn("tagged", tagged).groupBy("w_first", "w_second").agg(F.bool_and("eligible").alias("eligible"), F.min("groups").alias("groups"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "tagged"))), lambda x: x["tagged"])).alias("reasons"))
    found = over.join(both, ["w_first", "w_second"]).crossJoin(F.broadcast(agreed))  # one row
    chosen = (F.col("choice.w_first") == F.col("w_first")) & (F.col("choice.w_second") == F.col("w_second"))
    return found.select("w_first", "w_second", "all_required", "any_required", "groups", "eligible", "reasons", chosen.alias("chosen"), "status")
