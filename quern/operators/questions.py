"""What a question asks for: rules of a dictionary that it meets, the documents that it names, and a plan for searching.

A dictionary is tables, so thousands of rules are met by joins: ``matches`` has
the terms of a rule in groups, all of which must be met by one of their terms
at least; ``values`` has what a rule contributes.  Terms are looked up in the
normal form of a question by an automaton, or beyond a bound by a join.

Defined cases: null and blank questions meet nothing and get an empty plan; a
rule without terms is never met; blank terms and values are left out; repeated
rows of a dictionary count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.expansion import plan_terms_of
from quern.functions.terms import match_form, weak
from quern.sources.scratch import written

#: So many distinct terms at most are sent to all tasks as an automaton.
MOST_PATTERNS = 1 << 16
#: The join looks for beginnings of terms of up to so many characters.
HEAD = 6
#: Most values of each list of a plan, and terms of a query made of them.
LIMITS = {"profile": 24, "lexical": 48, "profile_focused": 10, "focused": 18, "embedding": 10, "expanded": 4}
MOST_TITLES, MOST_PROVISIONS, MOST_HEADINGS, MOST_EVIDENCE = 6, 6, 8, 18

# Marks of a dictionary, endings of words, kinds of documents, captions of a query.
WORD = "word:"
WORD_PARTICLES = "은 는 이 가 을 를 의 에 에서 에게 한테 께 도 만 부터 까지 와 과 로 으로".split()
WORD_VERBS = "하다 한다 하는 하여 하고 하면 하며 한 할 함 해 해서 해야 했다 했던 합니다 하세요 하겠다 하지 하므로 하도록".split()
TITLE_KINDS = (r"법\s*시행규칙", r"법\s*시행령", "시행규칙", "시행령", "규정", "지침", "고시", "법")
TITLE_ENDS = "은 는 이 가 을 를 의 에 에서 로 으로".split()
CONCEPTS, SECTIONS = "핵심 개념", "찾을 근거 유형"

_SIGN = r"\p{IsHangul}\p{Alnum}"
_TITLE = rf"(?<![{_SIGN}])([{_SIGN}][{_SIGN}\s]{{0,70}}?(?:{'|'.join(TITLE_KINDS)}))(?=$|[\s\p{{Punct}}」』\"']|{'|'.join(TITLE_ENDS)})"
_PROVISION = r"제\s*\d+\s*조(?:\s*의\s*\d+)?|별표\s*\d+"


def read_dictionary(lines: DataFrame) -> DataFrame:
    """(key, group_no, pos, value) of lines ``key=value|value;value``; comments, blank lines and repeated values of a group are left out."""
    rows = lines.select(F.trim(F.col(lines.columns[0])).alias("line")).filter("line rlike '^[^#!=]+=' ")
    rows = rows.select(F.trim(F.substring_index("line", "=", 1)).alias("key"), F.regexp_extract("line", "^[^=]*=(.*)$", 1).alias("said"))
    groups = rows.select("key", F.posexplode(F.split("said", ";")).alias("group_no", "group"))
    values = F.filter(F.transform(F.split("group", r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return groups.select("key", "group_no", F.posexplode(F.array_distinct(values)).alias("pos", "value"))


def rules_of(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, values) of ``read_dictionary``'s rows.

    matches: (kind, rule_id, group_no, term); values: (kind, rule_id, ord, field,
    group_no, pos, value), ``ord`` the place of the rule among its kind.  A
    synonym without ``match`` is met by its own values, an entity by its
    aliases, an intent by its cues.
    """
    kinds = {"entities": "entity", "synonyms": "synonym", "intents": "intent", "policies": "policy"}
    listed = entries.filter(F.col("key").isin(*kinds)).select(
        F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("key")].alias("kind"), F.col("pos").alias("ord"), F.col("value").alias("rule_id")
    )
    own = entries.select(
        F.substring_index("key", ".", 1).alias("kind"), F.regexp_extract("key", r"^[^.]+\.([^.]+)", 1).alias("rule_id"), F.regexp_extract("key", r"^[^.]+\.[^.]+\.(.+)$", 1).alias("field"),
        "group_no", "pos", "value",
    )
    values = listed.join(own, ["kind", "rule_id"]).withColumn("field", F.when(F.col("field") == "", "values").otherwise(F.col("field")))
    has = values.filter("field = 'match'").select("kind", "rule_id").distinct()
    stated = values.filter("field = 'match' and kind in ('policy', 'synonym')")
    plain = values.filter("(kind = 'synonym' and field = 'values') or (kind = 'entity' and field = 'aliases') or (kind = 'intent' and field = 'cues')")
    plain = plain.withColumn("group_no", F.lit(0)).join(has, ["kind", "rule_id"], "left_anti")
    return stated.unionByName(plain).select("kind", "rule_id", "group_no", F.col("value").alias("term")), values.filter("field <> 'match'")


def _by_automaton(texts: DataFrame, forms: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for form in shared.value:
            found.add_word(form, form)
        if shared.value:
            found.make_automaton()
        for batch in batches:
            keys, terms, starts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for last, form in found.iter(text) if shared.value else ():
                    keys.append(key)
                    terms.append(form)
                    starts.append(last - len(form) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.string()), pa.array(starts, pa.int32())], ["query_id", "form", "start"])

    return texts.mapInArrow(run, "query_id long, form string, start int")


def _by_join(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same by equality of beginnings: a text's substrings of up to ``HEAD`` characters meet the terms that begin so."""
    heads = patterns.select("form", F.least(F.length("form"), F.lit(HEAD)).alias("size")).withColumn("head", F.substring("form", F.lit(1), F.col("size")))
    sizes = F.array(*[F.lit(n) for n in range(1, HEAD + 1)])
    cuts = texts.filter("text <> ''").select("query_id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"), sizes.alias("sizes")).select("query_id", "text", "at", F.explode("sizes").alias("size"))
    cuts = cuts.withColumn("head", F.substring("text", F.col("at"), F.col("size"))).filter(F.length("head") == F.col("size"))
    met = cuts.join(heads, ["size", "head"]).filter(F.substring("text", F.col("at"), F.length("form")) == F.col("form"))
    return met.select("query_id", "form", (F.col("at") - 1).alias("start"))


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, form, start): where the forms of ``patterns`` lie in texts (query_id, text), overlaps included."""
    texts = texts.select(F.col("query_id").cast("long").alias("query_id"), "text").filter("text is not null")
    patterns = patterns.select("form").filter("form <> ''").distinct()
    few = [r["form"] for r in patterns.limit(MOST_PATTERNS + 1).collect()]
    return _by_automaton(texts, sorted(few)) if len(few) <= MOST_PATTERNS else _by_join(texts, patterns)


def _as_word(text: Column, term: Column) -> Column:
    """The term stands in the text as a word, particles and endings of verbs aside."""
    sign, endings = r"[\p{L}\p{Nd}]", "|".join(WORD_PARTICLES + WORD_VERBS)
    pattern = F.concat(F.lit(rf"(?<!{sign})\Q"), F.lower(F.trim(term)), F.lit(rf"\E(?:(?!{sign})|(?:{endings})(?!{sign}))"))
    return F.regexp_like(F.lower(text), pattern)


def matched_rules(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """(query_id, kind, rule_id): all groups of the rule have a term that lies in the question.

    The terms met are joined with the inverted index of rules; a rule is met by as many groups as it has.
    """
    word = F.startswith("term", F.lit(WORD))
    index = matches.distinct().withColumn("plain", F.when(word, F.substring("term", F.lit(len(WORD) + 1), F.length("term"))).otherwise(F.col("term")))
    index = index.select("kind", "rule_id", "group_no", "plain", word.alias("word"), match_form(F.col("plain")).alias("form"))
    asked = questions.select("query_id", "question", match_form(F.col("question")).alias("text"))
    hits = occurrences(asked, index).select("query_id", "form").distinct().join(index.filter("form <> ''"), "form")
    loose, strict = hits.filter("not word"), hits.filter("word").join(asked.select("query_id", "question"), "query_id").filter(_as_word(F.col("question"), F.col("plain"))).drop("question")
    met = loose.unionByName(strict).groupBy("query_id", "kind", "rule_id").agg(F.count_distinct("group_no").alias("met"))
    sizes = index.groupBy("kind", "rule_id").agg(F.count_distinct("group_no").alias("groups"))
    return met.join(sizes, ["kind", "rule_id"]).filter("met = groups").select("query_id", "kind", "rule_id")


def _cleaned(values: Column, most: int) -> Column:
    """Distinct by normal form, the first of each as it is shown, ``most`` at most."""
    shown = F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    pairs = F.filter(F.transform(shown, lambda v: F.struct(match_form(v).alias("form"), v.alias("shown"))), lambda p: p["form"] != "")
    first = F.aggregate(
        pairs, F.struct(F.array().cast("array<string>").alias("forms"), F.array().cast("array<string>").alias("shown")),
        lambda acc, p: F.when(F.array_contains(acc["forms"], p["form"]), acc).otherwise(
            F.struct(F.concat(acc["forms"], F.array(p["form"])).alias("forms"), F.concat(acc["shown"], F.array(p["shown"])).alias("shown"))
        ),
    )
    return F.slice(first["shown"], 1, most)


def explicit_titles(question: Column) -> Column:
    """Words of the titles that a question names by their kind."""
    found = F.regexp_extract_all(question, F.lit(_TITLE), F.lit(1))
    return _cleaned(F.flatten(F.transform(found, lambda t: F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "))), MOST_TITLES)


def named_provisions(question: Column) -> Column:
    """Articles and appendices in the order in which a question names them."""
    found = F.regexp_extract_all(question, F.lit(_PROVISION), F.lit(0))
    bare = F.transform(found, lambda p: F.regexp_replace(p, r"\s+", ""))
    return _cleaned(F.transform(bare, lambda p: F.regexp_replace(p, "^별표", "별표 ")), MOST_PROVISIONS)


def named_headings(question: Column) -> Column:
    """What stands in brackets behind an article or appendix."""
    return _cleaned(F.regexp_extract_all(question, F.lit(rf"(?:{_PROVISION})\s*\(([^)]+)\)"), F.lit(1)), MOST_HEADINGS)


def chosen_aliases(questions: DataFrame, aliases: DataFrame, met: DataFrame) -> DataFrame:
    """(query_id, aliases): of the aliases (rule_id, ord, pos, alias) of rules met, leftmost first, then longest, those that don't overlap a chosen one.

    An alias counts at its first occurrence.
    """
    known = aliases.select("rule_id", "ord", "pos", "alias", match_form(F.col("alias")).alias("form"))
    asked = questions.select("query_id", match_form(F.col("question")).alias("text"))
    first = occurrences(asked, known).groupBy("query_id", "form").agg(F.min("start").alias("start"))
    rows = first.join(known, "form").join(met.select("query_id", "rule_id").distinct(), ["query_id", "rule_id"], "left_semi")
    # A question's aliases: as many as fit into it, repeated by the entities that share them.
    order = F.struct("start", (-F.length("form")).alias("less"), "ord", "pos", "alias")
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_set(order)).alias("found"))
    chosen = F.aggregate(
        "found", F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("kept")),
        lambda acc, a: F.when(a["start"] >= acc["end"], F.struct((a["start"] - a["less"]).alias("end"), F.concat(acc["kept"], F.array(a["alias"])).alias("kept"))).otherwise(acc),
    )
    return listed.select("query_id", _cleaned(chosen["kept"], MOST_TITLES).alias("aliases"))


def question_anchors(questions: DataFrame, plans: DataFrame, aliases: DataFrame, met: DataFrame) -> DataFrame:
    """(query_id, title_terms, provision_terms, heading_terms, evidence_terms, targets, anchor_type, status).

    Titles named outright come before aliases; evidence terms are a plan's
    focused and lexical keywords but weak ones.
    """
    found = chosen_aliases(questions, aliases, met.filter("kind = 'entity'"))
    rows = questions.select("query_id", "question").join(plans.select("query_id", "lexical", "focused", "targets"), "query_id", "left").join(found, "query_id", "left")
    text, none = F.coalesce("question", F.lit("")), F.array().cast("array<string>")
    rows = rows.select(
        "query_id", text.alias("question"), explicit_titles(text).alias("titles"), named_provisions(text).alias("provisions"), named_headings(text).alias("headings"),
        F.coalesce("aliases", none).alias("aliases"), F.concat(F.coalesce("focused", none), F.coalesce("lexical", none)).alias("terms"), F.coalesce("targets", none).alias("targets"),
    )
    blank, named = F.trim("question") == "", F.size("titles") > 0
    kind = F.when(blank, "NONE").when(named & (F.size("provisions") == 0), "EXPLICIT_TITLE").when(named, "TITLE_WITH_PROVISION").when(F.size("aliases") > 0, "STABLE_ALIAS").otherwise("NONE")
    rows = rows.withColumn("anchor_type", kind)
    return rows.select(
        "query_id", F.when(named, F.col("titles")).otherwise(F.col("aliases")).alias("title_terms"), F.col("provisions").alias("provision_terms"), F.col("headings").alias("heading_terms"),
        F.filter(_cleaned(F.col("terms"), MOST_EVIDENCE), lambda t: ~weak(t)).alias("evidence_terms"), "targets", "anchor_type",
        F.when(blank, "INVALID").when(F.col("anchor_type") == "NONE", "NO_STRONG_ANCHOR").otherwise("ELIGIBLE").alias("status"),
    )


def _first_values(rows: DataFrame, keys: list[str], most: int, least: int = 2) -> DataFrame:
    """``rows`` (keys, at, value): each value of a key at its first place, the ``most`` first of them, with their number ``no``."""
    rows = rows.withColumn("value", F.trim("value")).filter(F.length("value") >= least).groupBy(*keys, "value").agg(F.min("at").alias("at"))
    order = Window.partitionBy(*keys).orderBy("at")
    return rows.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= most)


def _listed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]).alias(name))


def search_plans(questions: DataFrame, met: DataFrame, values: DataFrame, expand: bool = True) -> DataFrame:
    """(query_id, lexical, focused, sections, targets, intents, embedding_query, expanded) of each question.

    A question's own terms come first, then what its entities, synonyms,
    intents and policies contribute, in this order and each as the dictionary
    has it; intents that a policy suppresses contribute nothing.
    """
    place = lambda section: F.struct(F.lit(section).alias("section"), F.col("rank").alias("rank"), F.col("ord").alias("ord"), F.col("group_no").alias("group_no"), F.col("pos").alias("pos")).alias("at")
    rank = F.array_position(F.array(*[F.lit(k) for k in ("entity", "synonym", "intent", "policy")]), F.col("kind"))
    given = met.join(values, ["kind", "rule_id"]).withColumn("rank", rank)
    off = given.filter("kind = 'policy' and field = 'suppress_intents'").select("query_id", F.col("value").alias("rule_id"), F.lit("intent").alias("kind")).distinct()
    # A dozen lists are made of these rows, which are few beside the dictionary.
    given = written(given.join(off, ["query_id", "kind", "rule_id"], "left_anti"), "given")

    def of(section: int, *which: str) -> DataFrame:
        pairs = F.concat_ws(".", "kind", "field").isin(*which)
        return given.filter(pairs).select("query_id", place(section), "value")

    def heads(section: int) -> DataFrame:
        return given.filter("field = 'direct' and pos = 0").select("query_id", place(section), "value")

    own = questions.select("query_id", F.posexplode(plan_terms_of(F.col("question"))).alias("pos", "value"), F.lit(0).alias("rank"), F.lit(0).alias("ord"), F.lit(0).alias("group_no"))
    concepts = ("entity.aliases", "synonym.values", "policy.concepts")
    profile = _first_values(own.select("query_id", place(0), "value").unionByName(of(1, *concepts)), ["query_id"], LIMITS["profile"])
    focused = _first_values(of(0, "entity.focused", "policy.focused"), ["query_id"], LIMITS["profile_focused"])
    sections = _first_values(of(0, "entity.section_types", "intent.section_types", "policy.section_types"), ["query_id"], 1 << 30)
    again = lambda rows, section: rows.select("query_id", F.struct(F.lit(section).alias("section"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("ord"), F.lit(0).alias("group_no"), F.col("no").alias("pos")).alias("at"), "value")
    focused = again(focused, 0).unionByName(_shaped(heads(1))).unionByName(again(sections, 2))
    focused = _first_values(focused, ["query_id"], LIMITS["focused"])
    terms = given.filter("kind = 'intent' and field = 'terms'").select("kind", "rule_id").distinct()
    cues = given.filter("kind = 'intent' and field = 'cues'").join(terms, ["kind", "rule_id"], "left_anti").select("query_id", place(2), "value")
    lexical = again(profile, 0)
    for more in (of(1, *concepts), of(2, "intent.terms"), cues, of(3, "entity.direct", "intent.direct", "policy.direct")):
        lexical = lexical.unionByName(_shaped(more))
    lexical = _first_values(lexical.unionByName(again(focused, 4)), ["query_id"], LIMITS["lexical"])
    targets = _first_values(of(0, "entity.targets", "policy.targets"), ["query_id"], 1 << 30)
    stated = given.filter("kind = 'policy' and field = 'intent_types'").select("query_id", place(1), "value")
    intents = _first_values(_shaped(given.filter("kind = 'intent'").select("query_id", F.struct(F.lit(0).alias("section"), F.col("rank"), F.col("ord"), F.lit(0).alias("group_no"), F.lit(0).alias("pos")).alias("at"), F.col("rule_id").alias("value"))).unionByName(_shaped(stated)), ["query_id"], 1 << 30)

    rows, none = questions.select("query_id", "question"), F.array().cast("array<string>")
    for name, found in (("lexical", lexical), ("focused", focused), ("sections", sections), ("targets", targets), ("intents", intents)):
        rows = rows.join(written(_listed(found, ["query_id"], name), name), "query_id", "left")
    rows = rows.select("query_id", F.trim(F.coalesce("question", F.lit(""))).alias("question"), *[F.coalesce(c, none).alias(c) for c in ("lexical", "focused", "sections", "targets", "intents")])
    named = F.slice(F.filter("lexical", lambda v: F.length(v) >= 3), 1, LIMITS["embedding"])
    embedding = F.concat(
        "question", F.when(F.size(named) > 0, F.concat(F.lit(f"\n{CONCEPTS}: "), F.array_join(named, ", "))).otherwise(""),
        F.when(F.size("sections") > 0, F.concat(F.lit(f"\n{SECTIONS}: "), F.array_join("sections", ", "))).otherwise(""),
    )
    rows = rows.withColumn("embedding_query", F.trim(embedding, F.lit(" \n")))
    made = _expanded(rows, given) if expand else rows.select("query_id").limit(0).withColumn("made", none)
    rows = rows.join(made, "query_id", "left")
    queries = F.transform(F.concat(F.array("embedding_query"), F.coalesce("made", none)), lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")))
    return rows.select("query_id", "lexical", "focused", "sections", "targets", "intents", "embedding_query", F.slice(F.array_distinct(F.filter(queries, lambda q: F.length(q) >= 2)), 1, LIMITS["expanded"]).alias("expanded"))


def _shaped(rows: DataFrame) -> DataFrame:
    """Places of one type, so that lists of different origin unite."""
    kind = "struct<section:int,rank:bigint,ord:int,group_no:int,pos:int>"
    return rows.select("query_id", F.col("at").cast(kind).alias("at"), "value")


def _expanded(rows: DataFrame, given: DataFrame) -> DataFrame:
    """(query_id, made): a query for each entity and intent: label, focused words, first direct words of the entity, words of the intent; ten at most."""
    pairs = rows.select("query_id", F.posexplode("intents").alias("intent_no", "intent"))
    entities = given.filter("kind = 'entity'")
    parts = (("label", "field = 'label'", 1), ("focused", "field = 'focused'", 4), ("direct", "field = 'direct' and pos = 0", 3))
    words = None
    for i, (_, which, most) in enumerate(parts):
        own = entities.filter(which).select("query_id", "rule_id", "ord", F.struct("group_no", "pos").alias("at"), "value")
        own = _first_values(own, ["query_id", "rule_id", "ord"], most).select("query_id", "rule_id", "ord", F.lit(i).alias("part"), "no", "value")
        words = own if words is None else words.unionByName(own)
    intent = given.filter("kind = 'intent' and field = 'terms'").select("query_id", F.col("rule_id").alias("intent"), F.struct("group_no", "pos").alias("at"), "value")
    intent = _first_values(intent, ["query_id", "intent"], 4)
    each = words.join(pairs, "query_id").select("query_id", "rule_id", "ord", "intent", "intent_no", "part", "no", "value")
    met = words.select("query_id", "rule_id", "ord").distinct().join(pairs, "query_id").join(intent, ["query_id", "intent"])
    each = each.unionByName(met.select("query_id", "rule_id", "ord", "intent", "intent_no", F.lit(len(parts)).alias("part"), "no", "value"))
    keys = ["query_id", "ord", "rule_id", "intent_no", "intent"]
    best = _first_values(each.withColumn("at", F.struct("part", "no")), keys, 10)
    made = _listed(best, keys, "words").select("query_id", F.struct("ord", "intent_no", F.array_join("words", " ").alias("q")).alias("one"))
    # Entities times intents of one question.
    return made.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["q"]).alias("made"))
