"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents, in a shuffled order, form one stream of words, cut
into blocks of equal length.  A golden-ratio sequence is mapped through the
cumulative target shares, so slot n of the mix names a source; the slots of a
source are ranked, and its k-th slot takes block k (mod the number of blocks)
of pass k // blocks.  A source stops exactly at its target; what the sequence's
discrepancy leaves short at its end (a few blocks) is appended as closing
slots.

Targets share 150 % of all words by weight, at most twice a source's own words,
the excess reshared by weight.  Sources take the weights 5, 2, 1 in turn by code
point, null last.  Null and empty texts hold no words and are never taken; a
table without words gives an empty mix.  Rows that repeat an id are separate
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import row_key, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
#: Two neighbouring Fibonacci numbers: n -> n * a mod m is the golden-ratio sequence in exact integers.
FIB_A, FIB_M = 1_134_903_170, 1_836_311_903
CHUNK = 1 << 16
BUCKETS = 4096
GRID = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def block_words(total: int) -> int:
    """Words of a block: about a million blocks, from 16 to 4,096 words."""
    return max(16, min(4096, total >> 20))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, target) from rows of (source, size); the table has one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") - 1) % len(WEIGHTS) + 1))
    cap = F.lit(float(MAX_PASSES)) * F.col("source_size")
    line = Window.orderBy("ratio", "sid")
    whole = Window.partitionBy()
    filled = (
        named.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("level", (SHARE * F.col("all_words") - F.col("caps_before")) / F.col("weights_left"))
        .withColumn("stops", F.col("level") >= F.col("ratio"))
        .withColumn("fill", F.min(F.when(~F.col("stops"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
    )
    return filled.select(
        "sid", "source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * F.col("fill")).alias("target")
    )


def mixed_stream(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, key_of_row: Column | None = None):
    """(sizes, sources, stream): tables in the shared folder and the mix as a DataFrame.

    stream: slot, sid, pass_no, row_no, first_word, words; one row for each
    piece of a document in a slot's block.
    """
    spark = docs.sparkSession
    raw = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("content"), F.monotonically_increasing_id().alias("row_no"), *([] if key_of_row is None else [key_of_row.alias("row_key")]),
        ),
        "sizes",
    )
    sources = written(source_targets(raw), "sources")
    total = sources.agg(F.sum("source_size"), F.sum("target")).first()
    words, wanted = int(total[0] or 0), float(total[1] or 0)
    block = block_words(words)
    # The order of a source's documents is by hashes of id and text; only rows that repeat both are told apart by where they lie.
    key = F.xxhash64("doc_id", "content", F.lit(seed))
    placed = raw.join(sources.select("sid", F.col("source").alias("src"), "source_size"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    placed = placed.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(BUCKETS)))
    per_bucket = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("sid", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "content", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.filter("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(per_bucket, ["sid", "bucket"]).withColumn("a", F.col("base") + F.col("inside"))
    pieces = placed.select(
        "sid", "row_no", "size", "a", F.explode(F.expr(f"sequence(a div {block}, (a + size - 1) div {block})")).alias("block")
    ).select(
        "sid", "block", "row_no", "a",
        F.greatest(F.col("a") - F.col("block") * block, F.lit(0)).alias("lo"),
        F.least(F.col("a") + F.col("size") - F.col("block") * block, F.lit(block)).alias("hi"),
    )
    slots = _slots(spark, sources, block, wanted)
    stream = slots.join(pieces, ["sid", "block"]).withColumn("words", F.least("hi", "take") - F.col("lo")).filter("words > 0")
    stream = stream.select(
        "slot", "sid", "pass_no", "row_no", (F.col("block") * block + F.col("lo") - F.col("a")).alias("first_word"), "words"
    )
    return raw, sources, stream


def _slots(spark, sources: DataFrame, block: int, wanted: float) -> DataFrame:
    """(slot, sid, pass_no, block, take): the schedule, each source cut at its target."""
    n = -(-int(wanted) // block)
    share = sources.filter("target > 0").withColumn("share", F.col("target") / F.lit(max(wanted, 1.0)))
    edge = F.sum("share").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    share = share.withColumn("to", edge)
    # The last edge is 1 whatever the rounding of the sum.
    share = share.withColumn("to", F.when(F.col("sid") == F.max("sid").over(Window.partitionBy()), F.lit(1.0)).otherwise(F.col("to")))
    share = share.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("sid")), F.lit(0.0)))
    share = written(
        share.select(
            "sid", "source_size", F.floor("target").cast("long").alias("goal"), "from", "to",
            F.ceil(F.col("source_size") / F.lit(block)).cast("long").alias("blocks"),
        ),
        "shares",
    )
    # A source lies in few cells of a grid over [0, 1), so points find it by equality of cells.
    cells = share.select(
        "sid", "from", "to", F.explode(F.expr(f"sequence(cast(floor(`from` * {GRID}) as int), cast(least(floor(`to` * {GRID}), {GRID - 1}) as int))")).alias("cell")
    )
    points = spark.range(n).select(F.col("id").alias("slot"), (F.expr(f"((id + 1) % {FIB_M}) * {FIB_A} % {FIB_M}") / F.lit(float(FIB_M))).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * GRID).cast("int"))
    named = points.join(cells, "cell").filter("u >= `from` and u < `to`").select("slot", "sid", F.expr(f"slot div {CHUNK}").alias("chunk"))
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")).cast("long") - 1)
    counts = named.groupBy("sid", "chunk").agg(F.max("k").alias("last"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("sid", "chunk", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base"), "last"), "chunks")
    ranked = named.join(counts.select("sid", "chunk", "base"), ["sid", "chunk"]).select("sid", "slot", (F.col("base") + F.col("k")).alias("k"))
    reached = counts.groupBy("sid").agg(F.max(F.col("base") + F.col("last") + 1).alias("done"))
    needed = F.expr(f"goal div source_size * blocks + (goal % source_size + {block - 1}) div {block}")
    closing = share.join(reached, "sid", "left").withColumn("needed", needed).withColumn("done", F.coalesce("done", F.lit(0)))
    closing = closing.filter("needed > done").select("sid", F.explode(F.expr("sequence(done, needed - 1)")).alias("k"))
    closing = closing.select("sid", (F.lit(n) + F.col("k")).cast("long").alias("slot"), "k")
    taken = ranked.unionByName(closing).join(share.select("sid", "source_size", "goal", "blocks"), "sid")
    taken = taken.withColumn("pass_no", F.expr("k div blocks")).withColumn("block", F.expr("k % blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("goal") - F.col("pass_no") * F.col("source_size") - F.col("block") * block
    return taken.withColumn("take", F.least(length, left)).filter("take > 0").select("slot", "sid", "pass_no", "block", "take")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, and the words the mix takes of it."""
    return _taken(docs, id_col, source_col, text_col).select("doc_id", "source", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, id_col: str, source_col: str, text_col: str, key_of_row: Column | None = None) -> DataFrame:
    raw, sources, stream = mixed_stream(docs, id_col, source_col, text_col, key_of_row=key_of_row)
    got = stream.groupBy("row_no").agg(F.sum("words").alias("taken"))
    named = raw.join(sources.select(F.col("source").alias("src"), "source_size", "target"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    return named.join(got, "row_no", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each pass that takes at least half of a row's words.

    A source's blocks are taken in order, so all its documents are taken whole
    but the one or two in which a pass ends: its words end within the length
    of those of its target.

    Rows are told apart by a digest of id, source and text.  Those that repeat
    all three get the numbers of copies of their group, the largest first.
    """
    key = row_key(docs[id_col], docs[source_col], docs[text_col])
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("row_key"))
    share = _taken(docs, id_col, source_col, text_col, key).filter("size > 0").select("row_key", F.round(F.col("taken") / F.col("size")).alias("copies"))
    passes = F.array(*[F.count_if(F.col("copies") >= p) for p in range(1, MAX_PASSES + 1)])
    copies = share.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows"), passes.alias("passes")).filter("passes[0] > 0")
    # Keys and numbers only; the plan of the mix ends here, and the texts' joins are one of their own.
    each = tagged.join(written(copies, "copies"), "row_key")
    order = Window.partitionBy("row_key").orderBy(F.xxhash64(F.to_json("row")))
    again = each.filter("rows > 1").withColumn("k", F.row_number().over(order))
    each = each.filter("rows = 1").withColumn("k", F.lit(1)).unionByName(again)
    return each.select("row", F.explode(F.filter("passes", lambda n: n >= F.col("k"))).alias("copy")).select("row.*")
