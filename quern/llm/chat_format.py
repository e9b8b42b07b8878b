"""Reply trees formatted as training conversations, in DataFrame functions only.

A node names its tree, its own number and its parent.  Iterative self-joins
with doubling jumps enumerate every root-to-leaf path in log2(depth) rounds;
branches are ranked by mean node score and the chosen ones are written with a
template whose control strings cannot occur inside a text.

Defined cases: a null role or text is empty; a node whose parent is missing is
a root; rows on a cycle have no root and give no path; an empty table gives no
rows; rows that repeat a turn of a conversation are all kept, ordered by turn,
role and text (nulls first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import checkpointed

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First characters and tails of the strings that a text may not hold as they are: ours and those of common templates.
_CONTROL = r"(<|\[)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of a control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def chain_nodes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees of one branch: each row replies to the row before it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.select("tree", F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist): every node of every root-to-leaf path with its distance from the leaf."""
    ids = checkpointed(nodes.select("tree", "node", "parent"))
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    jump = checkpointed(
        ids.filter("parent is not null")
        .join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi")
        .select("tree", "node", F.col("parent").alias("up"))
    )
    parents = jump.select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    paths = checkpointed(
        ids.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select(
            "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")
        )
    )
    step, most = 1, ids.count()
    while step <= most and not jump.isEmpty():
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"))
        on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
        further = paths.join(j, on).select("tree", "leaf", F.col("u").alias("node"), (F.col("dist") + step).alias("dist"))
        paths = checkpointed(paths.unionByName(further))
        on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
        jump = checkpointed(jump.join(j, on).select("tree", "node", F.col("u").alias("up")))
        step *= 2
    if step > most:  # jumps remain after as many steps as there are nodes: cycles
        loops = jump.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
        bad = paths.join(loops, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_semi")
        bad = bad.select(F.col("tree").alias("t"), F.col("leaf").alias("l")).distinct()
        paths = paths.join(bad, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_anti")
    return paths


def formatted_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each tree, one row each.

    Columns: tree, leaf, branch_rank, formatted, and loss_spans, an array of
    (start, chars) in code points of ``formatted`` that covers exactly the
    texts of assistant turns, still escaped.
    """
    content = nodes.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), escaped(F.coalesce("role", F.lit(""))).alias("r"),
        escaped(F.coalesce("text", F.lit(""))).alias("x"), F.col("score").alias("s"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
    )
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    turns = root_to_leaf_paths(nodes).join(content, on).select("tree", "leaf", "dist", "r", "x", "s", "learn")
    if branches is not None:
        by_score = Window.partitionBy("tree").orderBy(F.col("mean").desc_nulls_last(), "leaf")
        ranked = turns.groupBy("tree", "leaf").agg(F.avg("s").alias("mean")).withColumn("branch_rank", F.row_number().over(by_score))
        ranked = ranked.filter(F.col("branch_rank") <= branches).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "branch_rank")
        turns = turns.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).drop("t", "l")
    piece = F.concat(F.lit(START), F.col("r"), F.lit(SEP), F.col("x"), F.lit(END))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("dist").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("piece", piece)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    head = F.length(F.lit(START)) + F.length("r") + F.length(F.lit(SEP))
    turn = F.struct(
        (-F.col("dist")).alias("k"), "piece",
        F.when(F.col("learn"), F.struct((F.col("at") + head).cast("long").alias("start"), F.length("x").cast("long").alias("chars"))).alias("span"),
    )
    whole = turns.groupBy("tree", "leaf", "branch_rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree", "leaf", "branch_rank",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and loss_spans alone: turns (role, text) and the texts under the loss mask, unescaped."""
    pieces = F.expr(r"slice(split(formatted, '<\\|im_end\\|>'), 1, size(split(formatted, '<\\|im_end\\|>')) - 1)")
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, len(START) + 1, 2_000_000_000), SEP, 1)).alias("role"),
            unescaped(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )
    learned = F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr((s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), learned.alias("learned"))
