"""Scoring and choosing evidence, and checking answers against it.

Domain rules are data: weights and word groups are parameters, so that another
domain brings its own.  Scores are rounded before they rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.terms import match_form
from quern.operators.audit import first_match

# What a match adds to a score.
KEYWORD_WEIGHTS = {"base": 0.28, "title": 0.08, "body": 0.055, "more_title": 0.055, "more_body": 0.04, "cap": 1.35}
RERANK_WEIGHTS = {"title": 0.12, "body": 0.045, "no_term": -0.65, "short_body": -0.25, "CONTEXT_ONLY": -1.5, "REVIEW": -0.2, "REJECT": -10.0}
# Negations, what may stand between an expression and its negation, words that part clauses or begin a final statement, endings that are cut.
NEGATIONS = ("안됩니다", "안된다", "안됨", "아닙", "아니", "않", "없", "불가")
BRIDGES = (
    "이라고는", "라고는", "이라고", "라는", "라고", "다고", "한다면", "하면", "할경우", "하는경우", "한경우", "했을경우", "단정해서는", "단정할수", "말할수", "볼수", "할수", "해서는",
    "이라는것은", "라는것은", "인것은", "것은", "반드시", "절대", "전혀", "으로", "은", "는", "이", "가", "도", "만", "지",
)
CLAUSE_SEPARATORS = ("하지만", "그러나", "반면", "다만")
TURNS, FINAL_WORDS = ("하지만", "그러나", "반면", "지만", "으나"), (r"실제로(?:는)?", "사실상", "사실은", "결론적으로", "결국", "오히려")
ENDINGS = ("이라고", "으로", "라고", "은", "는", "이", "가")
#: Negations and bridges that are read behind an expression.
MOST_STEPS = 24


def held(terms: Column, text: Column) -> Column:
    """How many of the terms the text holds."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def keyword_score(title: Column, body: Column, terms: Column, more: Column | None = None) -> Column:
    w = KEYWORD_WEIGHTS
    score = F.lit(w["base"]) + w["title"] * held(terms, title) + w["body"] * held(terms, body)
    if more is not None:
        score = score + w["more_title"] * held(more, title) + w["more_body"] * held(more, body)
    return F.round(F.least(F.lit(w["cap"]), score), 6)


def rerank_score(title: Column, body: Column, terms: Column, quality: Column) -> Column:
    w = RERANK_WEIGHTS
    n, m = held(terms, title), held(terms, body)
    score = w["title"] * n + w["body"] * m
    score = score + F.when((F.size(terms) > 0) & (n + m == 0), w["no_term"]).otherwise(0.0) + F.when(F.length(body) < 20, w["short_body"]).otherwise(0.0)
    score = score + F.when(quality == "CONTEXT_ONLY", w["CONTEXT_ONLY"]).when(quality == "REVIEW", w["REVIEW"]).otherwise(0.0)
    return F.round(F.when(quality == "REJECT", w["REJECT"]).otherwise(score), 6)


def with_rules(rows: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """``rows`` with rule_score; the table of rules is written by hand, a few hundred rows."""
    one = rules.agg(F.collect_list(F.struct("rule_id", "terms", "weight")).alias("rules"))
    hits = F.filter("rules", lambda r: F.forall(r["terms"], lambda t: F.contains(F.col(text), t)))
    total = F.aggregate(hits, F.lit(0.0), lambda s, r: s + r["weight"])
    return rows.crossJoin(F.broadcast(one)).withColumn("rule_score", F.round(total, 6)).drop("rules")


def in_profile(text: Column, groups: list[list[str]]) -> Column:
    """Every group has a term in the text."""
    out = F.lit(True)
    for group in groups:
        out = out & F.array_contains(F.array(*[F.contains(text, F.lit(t)) for t in group]), True)
    return out


def judged(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The best level of evidence that a question has, and its best rows.  rows: query_id, rank, score, title_terms, body_terms."""
    level = first_match(((F.col("body_terms") >= 4), "DIRECT"), ((F.col("body_terms") >= 2), "RELEVANT"), ((F.col("title_terms") > 0), "TOPIC"), otherwise="NONE")
    order = F.array_position(F.array(*[F.lit(x) for x in ("DIRECT", "RELEVANT", "TOPIC", "NONE")]), F.col("level"))
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("level", level).withColumn("o", order).withColumn("best", F.min("o").over(whole))
    rows = rows.filter("o = best and level <> 'NONE'").withColumn("judge_rank", F.row_number().over(whole.orderBy(F.desc("score"), "rank")))
    return rows.filter(F.col("judge_rank") <= limit).drop("o", "best")


def preserved(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Candidates that a judge left out but that state the answer themselves come first, with a score above the best.

    rows: query_id, rank, score, selected, target_ok, obsolete, noise, contradicts, matches.
    """
    reason = first_match(
        (F.col("selected"), "SELECTED"), (~F.col("target_ok"), "TARGET"), (F.col("obsolete"), "OBSOLETE"), (F.col("noise"), "NOISE"), (F.col("contradicts"), "CONTRADICTION"),
        (~F.col("matches"), "MISMATCH"), otherwise="PRESERVED",
    )
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "reason").orderBy("rank")))
    rows = rows.withColumn("reason", F.when((F.col("reason") == "PRESERVED") & (F.col("n") > limit), "LIMIT").otherwise(F.col("reason")))
    best = F.max("score").over(whole)
    return rows.withColumn("score", F.round(F.when(F.col("reason") == "PRESERVED", F.greatest(F.col("score") + 2, best + 1)).otherwise(F.col("score")), 6)).drop("n")


def noise_flags(text: Column) -> Column:
    """Whether a chunk is to be left out of evidence, or is context only."""
    suppress = text.rlike(r"(?i)^\s*(table of contents|목차|contents)\b") | text.rlike(r"(\.\s?){5,}\s*\d+\s*$") | text.rlike(r"^[\s\d.,:;()\[\]\-_/\\|*#$%&]+$")
    context = text.rlike(r"(?i)\b(click|menu|download|see also|license)\b") | (F.length(F.trim(text)) < 20)
    return first_match((suppress, "SUPPRESS"), (context, "CONTEXT_ONLY"), otherwise="EVIDENCE")


def term_match(text: Column, term: Column) -> Column:
    """The text holds the term, or all but one of its tokens and two at least."""
    plain = match_form(text)
    tokens = F.array_distinct(F.filter(F.split(F.lower(term), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2))
    n = held(tokens, plain)
    return F.contains(plain, match_form(term)) | ((F.size(tokens) == 1) & (n == 1)) | ((F.size(tokens) > 1) & (n >= F.greatest(F.lit(2), F.size(tokens) - 1)))


_CLAUSE = r"[!?\r\n]+|\.\s*(?=[^0-9\s]|$)"
_SUPERSEDED = rf"(?s)(^|[.!?\r\n])\s*[^.!?\r\n]*?(?:{'|'.join(TURNS)})[,:;\s]*(?=(?:{'|'.join(FINAL_WORDS)}))"
_NEGATION, _BRIDGE = "|".join(NEGATIONS), "|".join(BRIDGES)


def clauses(answer: Column) -> Column:
    """Clauses of an answer without those that a final statement supersedes."""
    kept = F.regexp_replace(F.regexp_replace(answer, _SUPERSEDED, "$1"), "|".join(CLAUSE_SEPARATORS), ".")
    return F.filter(F.transform(F.split(kept, _CLAUSE), lambda c: F.trim(c)), lambda c: c != "")


def odd_negations(suffix: Column) -> Column:
    """Whether an odd number of negations follows directly, reading over bridges: a scanner of two states over the normal form."""
    run = F.regexp_extract(suffix, rf"^(?:{_NEGATION}|{_BRIDGE}){{0,{MOST_STEPS}}}+", 0)
    marks = F.filter(F.regexp_extract_all(run, F.lit(rf"({_NEGATION})|(?:{_BRIDGE})"), F.lit(1)), lambda m: m != "")
    return F.size(marks) % 2 == 1


def _cut(term: Column) -> Column:
    return F.regexp_replace(term, rf"(?<=.)(?:{'|'.join(ENDINGS)})$", "")


def states(answer: Column, expected: Column) -> Column:
    """Some clause of the answer matches the expression, holds all its words and has the same polarity behind it; never for null or blank ones.

    The core of an expression is what stands before its first negation.  A
    clause without the core, but with all words, counts if nothing negates its
    last word.
    """
    form = match_form(expected)
    tokens = F.transform(F.split(expected, r"[^\p{L}\p{N}]+"), lambda t: _cut(match_form(t)))
    tokens = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.rlike(f"^(?:{_NEGATION})"))
    negated = form.rlike(_NEGATION)
    core = F.when(negated, _cut(F.regexp_extract(form, rf"^(.*?)(?:{_NEGATION})", 1))).otherwise(form)
    last = F.element_at(tokens, -1)

    def agrees(clause: Column) -> Column:
        plain = match_form(clause)
        covered = F.contains(plain, form) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(plain, t)))
        behind = F.substring(plain, F.position(core, plain) + F.length(core), F.length(plain))
        direct = odd_negations(behind) == odd_negations(F.substring(form, F.length(core) + 1, F.length(form)))
        loose = ~negated & (F.size(tokens) > 0) & ~odd_negations(F.call_function("substring_index", plain, last, F.lit(-1)))
        return term_match(clause, expected) & covered & (core != "") & F.when(F.contains(plain, core), direct).otherwise(F.coalesce(loose, F.lit(False)))

    said = F.coalesce(F.trim(answer) != "", F.lit(False)) & F.coalesce(F.trim(expected) != "", F.lit(False))
    return said & F.coalesce(F.exists(clauses(answer), agrees), F.lit(False))


def polarity(text: Column) -> Column:
    """Whether the negations of a sentence are odd in number."""
    return F.regexp_count(match_form(text), F.lit(_NEGATION)) % 2


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2))


def verified_claims(answers: DataFrame, evidence: DataFrame, least: int = 2, share: float = 0.34) -> DataFrame:
    """Each sentence of an answer with its best evidence: SUPPORTED if two terms and a third of them meet, numbers included, and none negates what the other says.

    answers: (key, answer); evidence: (key, evidence).  Sentences meet evidence
    of their own key by shared words, so no pair without a common word is made.
    """
    claims = answers.select("key", F.posexplode(sentences(F.col("answer"))).alias("claim_no", "claim"))
    claims = claims.withColumn("words", _words(F.col("claim"))).withColumn("odd", polarity(F.col("claim"))).withColumn("numbers", F.array_distinct(F.regexp_extract_all("claim", F.lit(r"\d+"), F.lit(0))))
    facts = evidence.distinct().select("key", "evidence", F.posexplode(sentences(F.col("evidence"))).alias("pos", "fact"))
    facts = facts.select("key", F.xxhash64("evidence", "pos").alias("fact_no"), "fact")
    numbers = facts.select("key", "fact_no", F.regexp_extract_all("fact", F.lit(r"\d+"), F.lit(0)).alias("fact_numbers"), polarity(F.col("fact")).alias("fact_odd"))
    words = facts.select("key", "fact_no", F.explode(_words(F.col("fact"))).alias("word"))
    met = claims.select("key", "claim_no", F.explode("words").alias("word")).join(words, ["key", "word"]).groupBy("key", "claim_no", "fact_no").agg(F.count(F.lit(1)).alias("shared"))
    met = met.join(numbers, ["key", "fact_no"]).join(claims.select("key", "claim_no", "numbers", "odd"), ["key", "claim_no"])
    met = met.filter((F.size(F.array_except("numbers", "fact_numbers")) == 0) & (F.col("odd") == F.col("fact_odd")))
    best = met.groupBy("key", "claim_no").agg(F.max("shared").alias("shared"))
    rows = claims.join(best, ["key", "claim_no"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    coverage = F.round(F.try_divide(F.col("shared"), F.size("words")), 6)
    rows = rows.withColumn("coverage", F.coalesce(coverage, F.lit(0.0)))
    return rows.select("key", "claim_no", "shared", "coverage", ((F.col("shared") >= least) & (F.col("coverage") >= share)).alias("supported"))


def repaired_answers(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Answers of their supported sentences only; an answer without one is empty."""
    rows = answers.select("key", F.posexplode(sentences(F.col("answer"))).alias("claim_no", "claim")).join(claims, ["key", "claim_no"])
    kept = F.when(F.col("supported"), F.struct("claim_no", "claim"))
    return rows.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda s: s["claim"]), " ").alias("answer"))
