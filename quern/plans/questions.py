"""Queries that plan searches: rules met, plans and anchors of questions, with their SQL.

The dictionary is made of the titles of all documents: an entity, known by two
words of a title, and a policy, met by one of these and a third as a word, for
each; an intent for each language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import lexical, questions
from quern.plans import retrieval
from quern.sources.scratch import written
from quern.sources.tables import table


def _dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(matches, values) of the rules."""
    words = F.slice(F.regexp_extract_all(F.lower(F.split("text", "\n")[0]), F.lit("[a-z]{4,}"), F.lit(0)), 1, 3)
    titles = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w")).filter(F.size("w") == 3)
    titles = titles.select("doc_id", "lang", *[F.col("w")[i].alias(f"w{i + 1}") for i in range(3)])
    both = F.concat_ws(" ", "w1", "w2")

    def entry(field: str, group_no: int, pos: int, value) -> object:
        return F.struct(F.lit(field).alias("field"), F.lit(group_no).alias("group_no"), F.lit(pos).alias("pos"), value.alias("value"))

    w1, w2, w3 = (F.col(f"w{i}") for i in (1, 2, 3))
    rule = lambda kind, letter: (F.lit(kind).alias("kind"), F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("rule_id"), F.col("doc_id").cast("int").alias("ord"))
    entity = F.array(
        entry("aliases", 0, 0, both), entry("label", 0, 0, w1), entry("focused", 0, 0, w3), entry("targets", 0, 0, F.col("lang")), entry("section_types", 0, 0, F.concat(F.lit("s_"), "lang")),
        entry("direct", 0, 0, w2), entry("direct", 0, 1, w3),
    )
    policy = F.array(entry("match", 0, 0, w1), entry("match", 0, 1, w2), entry("match", 1, 0, F.concat(F.lit(questions.WORD), w3)), entry("focused", 0, 0, w1), entry("concepts", 0, 0, w1), entry("concepts", 0, 1, w2))
    cues = titles.groupBy("lang").agg(F.substring(F.min("w1"), 1, 5).alias("a"), F.substring(F.max("w1"), 1, 5).alias("b"))
    intent = F.array(entry("cues", 0, 0, F.col("a")), entry("cues", 0, 1, F.col("b")), entry("terms", 0, 0, F.col("b")), entry("section_types", 0, 0, F.concat(F.lit("i_"), "lang")))
    rows = titles.select(*rule("entity", "e"), F.explode(entity).alias("e")).unionByName(titles.select(*rule("policy", "p"), F.explode(policy).alias("e")))
    rows = rows.unionByName(cues.select(F.lit("intent").alias("kind"), F.concat(F.lit("i"), "lang").alias("rule_id"), F.ascii("lang").alias("ord"), F.explode(intent).alias("e")))
    rows = written(rows.select("kind", "rule_id", "ord", "e.*"), "dictionary")
    matches = rows.filter("field in ('aliases', 'match', 'cues')").select("kind", "rule_id", "group_no", F.col("value").alias("term"))
    return matches, rows.filter("field <> 'match'")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def matched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.matched_rules(_asked(spark, sf_dir), _dictionary(spark, sf_dir)[0])


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules met, values, plans)."""
    matches, values = _dictionary(spark, sf_dir)
    met = written(questions.matched_rules(_asked(spark, sf_dir), matches), "met")
    return met, values, questions.search_plans(_asked(spark, sf_dir), met, values)


def search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("lexical", "focused", "sections", "targets", "intents")
    return _planned(spark, sf_dir)[2].select("query_id", *[F.array_join(c, "|").alias(c) for c in lists], "embedding_query")


def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that a question is searched by beside itself, in order."""
    return _planned(spark, sf_dir)[2].select("query_id", F.posexplode("expanded").alias("no", "query"))


def question_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    met, values, plans = _planned(spark, sf_dir)
    aliases = values.filter("field = 'aliases'").select("rule_id", "ord", "pos", F.col("value").alias("alias"))
    found = questions.question_anchors(_asked(spark, sf_dir), plans, aliases, met)
    return found.select("query_id", *[F.array_join(c, "|").alias(c) for c in ("title_terms", "provision_terms", "evidence_terms", "targets")], "anchor_type", "status")


def planned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that a question is searched by when its plan's keywords follow its own words."""
    plans = _planned(spark, sf_dir)[2].select("query_id", "lexical")
    return lexical.query_terms(_asked(spark, sf_dir).join(plans, "query_id"), planned="lexical").select("query_id", "term")


QUERIES = {f.__name__: f for f in (matched_rules, search_plans, expanded_queries, question_anchors, planned_terms)}

_FORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_RULES = f"""q as (select item_id as query_id, text as question, {_FORM.format("text")} as form, string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+') as tokens from benchmark),
ti as (select doc_id, lang, w[1] as w1, w[2] as w2, w[3] as w3 from (select doc_id, lang, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z]{{4,}}') as w from documents) where len(w) >= 3),
cu as (select lang, substr(min(w1), 1, 5) as a, substr(max(w1), 1, 5) as b from ti group by 1),
va as (
  select 'entity' as kind, 'e' || doc_id as rule_id, doc_id as ord, 1 as rank, unnest([
    {{'f': 'aliases', 'g': 0, 'p': 0, 'v': w1 || ' ' || w2}}, {{'f': 'label', 'g': 0, 'p': 0, 'v': w1}}, {{'f': 'focused', 'g': 0, 'p': 0, 'v': w3}}, {{'f': 'targets', 'g': 0, 'p': 0, 'v': lang}},
    {{'f': 'section_types', 'g': 0, 'p': 0, 'v': 's_' || lang}}, {{'f': 'direct', 'g': 0, 'p': 0, 'v': w2}}, {{'f': 'direct', 'g': 0, 'p': 1, 'v': w3}}]) as e from ti
  union all select 'policy', 'p' || doc_id, doc_id, 4, unnest([{{'f': 'match', 'g': 0, 'p': 0, 'v': w1}}, {{'f': 'match', 'g': 0, 'p': 1, 'v': w2}}, {{'f': 'match', 'g': 1, 'p': 0, 'v': 'word:' || w3}},
    {{'f': 'focused', 'g': 0, 'p': 0, 'v': w1}}, {{'f': 'concepts', 'g': 0, 'p': 0, 'v': w1}}, {{'f': 'concepts', 'g': 0, 'p': 1, 'v': w2}}]) from ti
  union all select 'intent', 'i' || lang, ascii(lang), 3, unnest([{{'f': 'cues', 'g': 0, 'p': 0, 'v': a}}, {{'f': 'cues', 'g': 0, 'p': 1, 'v': b}}, {{'f': 'terms', 'g': 0, 'p': 0, 'v': b}},
    {{'f': 'section_types', 'g': 0, 'p': 0, 'v': 'i_' || lang}}]) from cu),
ma as (select distinct kind, rule_id, e.g as g, e.v as term, {_FORM.format("e.v")} as form from va where e.f in ('aliases', 'match', 'cues')),
hi as (select distinct query_id, kind, rule_id, g from q, ma where case when starts_with(term, 'word:')
         then list_contains(q.tokens, substr(term, 6)) else contains(q.form, ma.form) end),
nu as (select kind, rule_id, count(distinct g) as groups from ma group by all),
mt as (select query_id, kind, rule_id, count(*) as met from hi group by all),
me as (select query_id, kind, rule_id from mt join nu using (kind, rule_id) where met = groups)"""


def _first(name: str, rows: str, most: int) -> str:
    """A list's values at their first places, ``most`` of them."""
    return f"""{name} as (select query_id, value, row_number() over (partition by query_id order by k) as no
        from (select query_id, value, min(k) as k from ({rows}) where length(value) >= 2 group by 1, 2) qualify no <= {most})"""


def _of(section: int, which: str) -> str:
    return f"select query_id, value, {{'s': {section}, 'r': rank, 'o': ord, 'g': g, 'p': p}} as k from gi where {which}"


def _again(name: str, section: int) -> str:
    return f"select query_id, value, {{'s': {section}, 'r': 0, 'o': 0, 'g': 0, 'p': no}} as k from {name}"


_CONCEPTS = "kind || '.' || f in ('entity.aliases', 'policy.concepts')"
_PLANS = f"""with recursive {_RULES},
gi as (select query_id, kind, rule_id, ord, rank, e.f as f, e.g as g, e.p as p, e.v as value from me join va using (kind, rule_id)),
ow as (select query_id, lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) as value, {{'s': 0, 'r': 0, 'o': 0, 'g': 0, 'p': p}} as k
       from (select query_id, unnest(string_split_regex(question, '\\s+')) as w, generate_subscripts(string_split_regex(question, '\\s+'), 1) as p from q)),
{_first("pr", f"select * from ow union all {_of(1, _CONCEPTS)}", 24)},
{_first("f0", _of(0, "kind in ('entity', 'policy') and f = 'focused'"), 10)},
{_first("se", _of(0, "f = 'section_types'"), 1 << 30)},
{_first("fo", f"{_again('f0', 0)} union all {_of(1, chr(102) + " = 'direct' and p = 0")} union all {_again('se', 2)}", 18)},
{_first("le", f"{_again('pr', 0)} union all {_of(1, _CONCEPTS)} union all {_of(2, chr(102) + " = 'terms'")} union all {_of(3, chr(102) + " = 'direct'")} union all {_again('fo', 4)}", 48)},
{_first("ta", _of(0, "f = 'targets'"), 1 << 30)},
{_first("nt", "select query_id, rule_id as value, {'s': 0, 'r': rank, 'o': ord, 'g': 0, 'p': 0} as k from gi where kind = 'intent'", 1 << 30)},
pl as (
  select query_id, question, {", ".join(f"coalesce((select list(value order by no) from {t} where {t}.query_id = q.query_id), []) as {n}" for t, n in (("le", "lexical"), ("fo", "focused"), ("se", "sections"), ("ta", "targets"), ("nt", "intents")))}
  from q)"""

SQL = {
    "matched_rules": f"with {_RULES} select * from me",
    "search_plans": f"""{_PLANS}
        select query_id, {", ".join(f"array_to_string({c}, '|') as {c}" for c in ("lexical", "focused", "sections", "targets", "intents"))},
               trim(trim(question) || case when len(n) > 0 then chr(10) || '{questions.CONCEPTS}: ' || array_to_string(n, ', ') else '' end
                    || case when len(sections) > 0 then chr(10) || '{questions.SECTIONS}: ' || array_to_string(sections, ', ') else '' end, ' ' || chr(10)) as embedding_query
        from (select *, list_filter(lexical, lambda v: length(v) >= 3)[1:10] as n from pl)""",
    "planned_terms": f"""{_PLANS},
        tk as (select query_id, {retrieval._terms("question || chr(10) || array_to_string(lexical, chr(10))")} as l from pl),
        tn as (select query_id, term, row_number() over (partition by query_id order by min(p)) as n from (select query_id, unnest(l) as term, generate_subscripts(l, 1) as p from tk) group by query_id, term)
        select query_id, term from tn where n <= 24""",
    "question_anchors": f"""{_PLANS},
        al as (select query_id, ord, value as alias, instr(form, {_FORM.format("value")}) - 1 as a, length({_FORM.format("value")}) as n from gi join q using (query_id) where kind = 'entity' and f = 'aliases'),
        ch as (
          select query_id, 0 as step, cast(0 as bigint) as stop, cast(null as varchar) as alias from q
          union all
          select * from (select ch.query_id, step + 1, a + n, al.alias from ch join al on al.query_id = ch.query_id and al.a >= ch.stop
                         qualify row_number() over (partition by ch.query_id order by a, n desc, ord, al.alias) = 1)),
        ti6 as (select query_id, list(alias order by step)[1:6] as t from (select query_id, alias, min(step) as step from ch where alias is not null group by 1, 2) group by 1),
        ev as (select query_id, list_filter(list_concat(focused, lexical), lambda v: regexp_replace(lower(v), '[^a-z0-9]', '', 'g') <> '') as v from pl),
        ef as (select query_id, value, {_FORM.format("value")} as form, i from (select query_id, unnest(v) as value, generate_subscripts(v, 1) as i from ev)),
        e1 as (select query_id, arg_min(value, i) as value, min(i) as i from ef group by query_id, form),
        e2 as (select query_id, list(value order by i)[1:18] as v from e1 group by 1)
        select query_id, coalesce(array_to_string(t, '|'), '') as title_terms, '' as provision_terms, coalesce(array_to_string(e2.v, '|'), '') as evidence_terms, array_to_string(targets, '|') as targets,
               case when t is null then 'NONE' else 'STABLE_ALIAS' end as anchor_type, case when t is null then 'NO_STRONG_ANCHOR' else 'ELIGIBLE' end as status
        from pl left join ti6 using (query_id) left join e2 using (query_id)""",
}
