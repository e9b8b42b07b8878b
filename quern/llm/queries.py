"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, chat_format, exact_dedup, jaccard_join, language_id, lexical_search, mixing, neighbours, quality, secret_scan, token_files, toxicity, turn_repair
from quern.llm.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def _held_out(n: int, remainder: int):
    return F.coalesce(_remainder(n) == remainder, F.lit(False)).alias("held_out")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.round_trip(_table(spark, sf_dir, "documents"), *public_tokenizer("byte_bpe_50k.tiktoken")))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = neighbours.build(neighbours.usable(_table(spark, sf_dir, "embeddings")))
    return neighbours.search(index, books, index.filter("vec_id % 20 = 0"), k=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = language_id.learn(docs.filter(_remainder(4) != 2))
    return language_id.identify(docs, filters).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, *public_tokenizer("byte_bpe_50k.json"), end_id=2, with_added=True)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(_remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.filter(_remainder(5) != 0))
    found = quality.judge(docs, model)
    return found.select("doc_id", _held_out(5, 0), "doc_score", "host_posterior", "path_posterior", "score", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("source")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    own = spark.sql(
        "select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from range(2)"
    )
    whole = chat_format.read_back(chat_format.formatted_paths(chat_format.chain_nodes(asked.unionByName(own))))
    joined = F.array_join("learned", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"), F.sha2(joined, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_neighbours": op2_neighbours,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_chat_format": op10_chat_format,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_turn_repair": op13_turn_repair,
}

SQL = {
    "op8_exact_dedup": r"""
        with d as (
          select doc_id, length(coalesce(text, '')) as chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
          from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
               row_number() over w = 1 as kept, text_sha256
        from d window w as (partition by text_sha256 order by chars desc, doc_id nulls last
                            rows between unbounded preceding and unbounded following)""",
    "op10_chat_format": r"""
        with c as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (
          select *, length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1_\2', 'g'))
                  + length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1_\2', 'g'))
                  + 32 as chars
          from c)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
               sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
               cast(sum(chars) as bigint) as formatted_chars
        from e group by conv_id""",
    "op11_lexical_search": r"""
        with d as (
          select row_number() over () as row_no, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
        whole as (select count(*) as docs, cast(sum(len(terms)) as bigint) as terms from d where len(terms) > 0),
        asked as (
          select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        tf as (select row_no, term, count(*) as tf from (select row_no, unnest(terms) as term from d) where term in (select term from asked) group by all),
        w as (
          select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) as w
          from (select term, count(*) as df from tf group by term), whole),
        scores as (
          select item_id, row_no, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.terms) * docs) // whole.terms)))) as bigint) as score
          from asked join tf using (term) join w using (term) join d using (row_no), whole group by all)
        select item_id, rank, doc_id, score
        from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last, row_no) as rank
              from scores join d using (row_no) where score > 0)
        where rank <= 50""",
    "op13_turn_repair": r"""
        with recursive hit as (
          select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 xor(list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(
                     string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
                     lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, x: if(x >= 0, xor(c, cast(x as bigint)), xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 as kind from conversations),
        rows0 as (
          select conv_id, turn, case kind when 4 then 'user' else role end as role,
                 case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
          from (select *, unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as copy from hit)),
        rows1 as (
          select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
                 regexp_replace(text, '[\x20\x09-\x0D]+$', '') as shown, left(role, 1) as initial from rows0),
        rows2 as (
          select *, case when shown = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
                         when right(shown, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
                 n > 1 and lag(initial) over (partition by conv_id order by n) || initial not in ('su', 'ua', 'au') as illegal from rows1),
        counts as (
          select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
                 count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal, max(n) as n
          from rows2 group by conv_id),
        chart as (
          select distinct conv_id, cast(0 as bigint) as n, '000000000' as e, cast(null as varchar) as s, '000000003I' as q, '000000006II' as w from hit
          union all
          select conv_id, n, e, s, q2 as q, least(w, lpad(cast(cast(left(q2, 9) as bigint) + 3 as varchar), 9, '0') || substr(q2, 10) || 'I') as w from (
            select *, least(q, lpad(cast(cast(left(least(e, s, w), 9) as bigint) + 3 as varchar), 9, '0') || substr(least(e, s, w), 10) || 'I') as q2 from (
              select c.conv_id, r.n, lpad(cast(cast(left(e, 9) as bigint) + 4 as varchar), 9, '0') || substr(e, 10) || 'D' as e,
                     least(lpad(cast(cast(left(s, 9) as bigint) + 4 as varchar), 9, '0') || substr(s, 10) || 'D',
                           case when fault not in ('blank', 'duplicate') and initial = 's'
                                then lpad(cast(cast(left(e, 9) as bigint) + if(fault = 'truncated', 3, 0) as varchar), 9, '0') || substr(e, 10) || 'K' end) as s,
                     least(lpad(cast(cast(left(q, 9) as bigint) + 4 as varchar), 9, '0') || substr(q, 10) || 'D',
                           case when fault not in ('blank', 'duplicate')
                                then lpad(cast(cast(left(least(e, s, w), 9) as bigint) + if(fault = 'truncated', 3, 0) + if(initial = 'u', 0, 3) as varchar), 9, '0')
                                     || substr(least(e, s, w), 10) || if(initial = 'u', 'K', 'R') end) as q,
                     least(lpad(cast(cast(left(w, 9) as bigint) + 4 as varchar), 9, '0') || substr(w, 10) || 'D',
                           case when fault not in ('blank', 'duplicate')
                                then lpad(cast(cast(left(q, 9) as bigint) + if(fault = 'truncated', 3, 0) + if(initial = 'a', 0, 3) as varchar), 9, '0')
                                     || substr(q, 10) || if(initial = 'a', 'K', 'R') end) as w
              from chart c join rows2 r on r.conv_id is not distinct from c.conv_id and r.n = c.n + 1))),
        best as (
          select c.conv_id, cast(left(least(e, w), 9) as bigint) as cost, substr(least(e, w), 10) as audit
          from chart c left join counts k on c.conv_id is not distinct from k.conv_id where c.n = coalesce(k.n, 0)),
        best0 as (select conv_id, if(exists (select 1 from counts k where k.conv_id is not distinct from b.conv_id), cost, 0) as cost, audit from best b),
        edits as (
          select conv_id, p, substr(audit, p, 1) as edit, length(replace(audit, 'D', '')) % 2 as odd from (select *, unnest(range(1, length(audit) + 1)) as p from best0)),
        placed as (
          select *, count(*) filter (edit <> 'I') over w as n, count(*) filter (edit <> 'D') over w - odd as k from edits
          window w as (partition by conv_id order by p rows unbounded preceding)),
        said as (
          select p.conv_id, string_agg(if(edit = 'K', role, if(k % 2 = 1, 'user', 'assistant')) || ':' || if(edit = 'I', '', text), chr(10) order by p) as said
          from placed p left join rows2 r on r.conv_id is not distinct from p.conv_id and r.n = p.n where edit <> 'D' group by p.conv_id)
        select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, b.cost, b.audit, sha256(coalesce(said, '')) as repaired_sha256
        from best0 b left join counts k on b.conv_id is not distinct from k.conv_id left join said s on b.conv_id is not distinct from s.conv_id""",
}
