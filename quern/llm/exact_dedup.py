"""Exact duplicates by two passes over a Bloom filter.

Pass one folds a hash of every normalised text into filter cells that saturate
at "seen twice".  Pass two tests every row: a row with a cell seen only once
has no copy and passes straight through; only rows whose cells were all seen
twice are shuffled, by their digest, to find true groups.  A false positive
costs one shuffled row and never changes the result.  Where one filter of
``MAX_CELLS`` would be too crowded to tell rows apart, digests (or whole rows)
are dealt to ranges with a filter each, tested one after the other.

Texts are equal when identical after removing the characters
``[\\x20\\x09-\\x0D]``.  Of equal texts the row with most code points in its
original text stays, then the smallest id (a null id loses to any other), then
any one of rows that repeat both.  Null texts count as empty, and all empty
texts are equal.  An empty table gives an empty result.  Extra columns pass
through ``drop_exact_duplicates`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import checkpointed, scratch, written

HASHES = 3
CELLS_PER_ROW = 16
#: A filter is broadcast as words of 64 cells: at most 2**21 rows of 16 bytes, however large the input.
MAX_CELLS = 1 << 27
#: With fewer cells a row than this, digests are dealt to several filters.
LEAST_CELLS_PER_ROW = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _cell(digest: Column, j: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(j)), F.lit(cells).cast("long"))


def cells_for(rows: int) -> int:
    cells = 1 << 12
    while cells < min(MAX_CELLS, rows * CELLS_PER_ROW):
        cells *= 2
    return cells


def filter_words(digests: DataFrame, digest: str, cells: int, least: int = 2) -> DataFrame:
    """Words of the filter: (word, bits), a bit set where ``least`` rows or more fell on its cell."""
    hit = digests.select(F.explode(F.array(*[_cell(F.col(digest), j, cells) for j in range(HASHES)])).alias("cell"))
    twice = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return twice.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    )


def maybe_in(df: DataFrame, digest: str, words: DataFrame, cells: int, flag: str) -> DataFrame:
    """``df`` with a flag: false only for rows whose digest occurs once."""
    kept, hits = list(df.columns), []
    for j in range(HASHES):
        side = F.broadcast(words.select(F.col("word").alias(f"_word{j}"), F.col("bits").alias(f"_bits{j}")))
        cell = _cell(F.col(digest), j, cells)
        df = df.join(side, F.shiftright(cell, 6) == F.col(f"_word{j}"), "left")
        hits.append(F.expr(f"coalesce(getbit(_bits{j}, cast(pmod(xxhash64({digest}, {j}), {cells}L) & 63 as int)), 0) = 1"))
    both = hits[0]
    for h in hits[1:]:
        both = both & h
    return df.select(*kept, both.alias(flag))


def tested_digests(digests: DataFrame, digest: str) -> DataFrame:
    """``digests`` (a table) with the flag ``again``: false only for rows whose digest occurs once."""
    rows = digests.count()
    ranges = -(-rows * LEAST_CELLS_PER_ROW // MAX_CELLS)
    if ranges <= 1:
        cells = cells_for(rows)
        return maybe_in(digests, digest, written(filter_words(digests, digest, cells), "filter"), cells, "again")
    spark, path = digests.sparkSession, scratch(digests.sparkSession, "ranges")
    digests.withColumn("_range", F.pmod(F.xxhash64(digest, F.lit(-1)), F.lit(ranges))).write.partitionBy("_range").parquet(path)
    dealt, out, cells = spark.read.parquet(path), scratch(spark, "tested"), cells_for(rows // ranges)
    for i in range(ranges):
        own = dealt.filter(F.col("_range") == i).select(*digests.columns)
        words = written(filter_words(own, digest, cells), "filter")
        maybe_in(own, digest, words, cells, "again").write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _first() -> Column:
    """What orders the rows of a group, the one that stays first: columns chars, doc_id."""
    return F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("lost"), "doc_id", "row_no")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    tested = tested_digests(digests, "text_sha256")
    alone = tested.filter("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    some = tested.filter("again").drop("again")
    # Partial aggregation leaves one row per digest and task, so a hot group meets as a few rows; the join back is a
    # plain shuffled join on two exchanges, whose skewed partitions adaptive execution splits.
    best = some.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("top"))
    best = checkpointed(best.select("text_sha256", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row_no").alias("keep_row")))
    grouped = some.join(best, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Groups are decided on (digest, length, id, hash of the row) alone.  Texts
    without a copy are never shuffled; of the others only rows that a filter of
    the chosen ones lets through are, to be compared with the choice itself.
    Rows equal in all columns are one choice, of which any one stays.
    """
    hashed = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.unhex(F.sha2(normalised(docs[text_col]), 256)).alias("digest"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).alias("chars"), docs[id_col].alias("doc_id"), F.xxhash64(*hashed).alias("row_no"),
    )
    digests = written(rows.drop("row"), "digests")
    count = digests.count()
    ranges = -(-count * LEAST_CELLS_PER_ROW // MAX_CELLS)
    if ranges <= 1:
        return _kept(rows, digests, cells_for(count))
    # Too many for one filter: rows are dealt to folders by their digests where they are made, which shuffles nothing, and each folder is decided by itself.
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "dealt")
    rows.withColumn("_range", F.pmod(F.xxhash64("digest", F.lit(-1)), F.lit(ranges))).write.partitionBy("_range").parquet(path)
    dealt, out = spark.read.parquet(path), None
    for i in range(ranges):
        own = dealt.filter(F.col("_range") == i).select(*rows.columns)
        kept = _kept(own, own.drop("row"), cells_for(count // ranges))
        out = kept if out is None else out.unionByName(kept)
    return out


def _kept(rows: DataFrame, digests: DataFrame, cells: int) -> DataFrame:
    """The rows that stay of (row, digest, chars, doc_id, row_no); ``digests`` are the same without ``row``."""
    words = written(filter_words(digests, "digest", cells), "filter")
    some = maybe_in(digests, "digest", words, cells, "again").filter("again")
    equal = some.groupBy("digest", "chars", "doc_id", "row_no").agg(F.count(F.lit(1)).alias("equal"))
    best = equal.groupBy("digest").agg(F.min(F.struct(_first().alias("first"), "equal")).alias("top"))
    best = written(best.select("digest", F.col("top.first.row_no").alias("row_no"), F.col("top.equal").alias("equal")), "chosen")
    chosen = best.select("row_no")
    chosen_cells = cells_for(chosen.count())
    chosen_words = written(filter_words(chosen, "row_no", chosen_cells, least=1), "filter")
    tested = maybe_in(rows, "digest", words, cells, "again")
    near = maybe_in(tested.filter("again"), "row_no", chosen_words, chosen_cells, "near").filter("near")
    found = near.select("row", "digest", "row_no").join(best, ["digest", "row_no"])
    again = found.filter("equal > 1").groupBy("digest").agg(F.any_value("row").alias("row"))
    return tested.filter("not again").select("row.*").unionByName(found.filter("equal = 1").select("row.*")).unionByName(again.select("row.*"))
