"""Joining documents by the Jaccard similarity of their word shingles, exactly, with signature trees.

1. A text's set is the hashes of its distinct five-word shingles; equal sets
   are one class, and only classes are compared.
2. Shingles are put in one global order, frequent ones last.  Two sets at or
   above the threshold share a shingle within the first ``n - ceil(0.8 n) + 1``
   of each, so classes meet in the buckets of these shingles.
3. Stars: in each bucket every class is tested against one of them.  The links
   found join most near copies into components, so that large groups of them
   never make all pairs.
4. Signature trees: buckets that still hold different components are searched
   whole.  Leaves hold classes of like size with bitmaps of their shingles,
   nodes the OR of the bitmaps and the range of sizes; a traversal of pairs of
   nodes leaves out those whose maximum possible overlap is too small, or that
   lie in one component.  Classes tied together by possible links form groups.
5. Groups are verified on the sets themselves; only links that join
   two components of a group are kept, so their number never exceeds its
   members.  Components of the verified links are the result.

Buckets and groups of any size are dealt as pairs of blocks, so that no task
holds more than two blocks of one.

Which shingles count as frequent comes from a count of all of them in 2**22
cells; it steers the size of buckets, never the result.  Null texts and texts
without words have an empty set and are alone; with fewer than five words the
whole sequence is the only shingle.  Equal rows are one class.  Shingles are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.exact_dedup import cells_for, filter_words, maybe_in
from quern.llm.shared import bounded_batches, checkpointed, row_key, written

WIDTH = 5
#: Threshold as a fraction: 100 * overlap >= 80 * union.
NUM, DEN = 4, 5
CELLS = 1 << 22
MEMO = 300_000
LEAF = 32
FANOUT = 8
#: A cell is frequent from this count on, summed over the tasks in which it stands out.
FREQUENT = 24
#: Partners of a class that are verified in one call, and the blocks in which buckets and groups are dealt.
PARTNERS = 256
BUCKET_BLOCK, GROUP_BLOCK = 2048, 512

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, WIDTH)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _P + w[i : n - k + 1 + i]
    h ^= h >> np.uint64(32)
    h *= _Q
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def frequent_cells(docs: DataFrame) -> np.ndarray:
    """A mark for each of the cells whose shingles are far more frequent than the mean cell's; docs: (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_cell(shingles(text)))
                size += len(held[-1])
                if size > 1 << 20:
                    seen += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.int32)
                    held, size = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.int32)
        total = int(seen.sum())
        high = np.flatnonzero(seen >= max(4, 3 * total / CELLS))
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(seen[high].astype(np.int64))], ["cell", "n"])

    counts = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    marks = np.zeros(CELLS, bool)  # at most CELLS numbers reach the driver, whatever the input
    marks[[r["cell"] for r in counts.filter(F.col("n") >= FREQUENT).select("cell").toLocalIterator()]] = True
    return marks


def _bitmap(h: np.ndarray, bits_each: int = 1) -> bytes:
    """Bits of the set in the least power of two of bits from ``bits_each`` times its size, 64 at least."""
    width = max(64, 1 << int(bits_each * len(h) - 1).bit_length()) if len(h) else 64
    out = np.zeros(width, bool)
    out[((h >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _sketches(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(row_no, doc_id, row_key, n, key, prefix, bits) of every document, in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                n, key, prefix, bits = [], [], [], []
                for text in rows.column(3).to_pylist():
                    h = shingles(text)
                    last = frequent[_cell(h)]
                    order = np.concatenate([h[~last], h[last]])
                    n.append(len(h))
                    key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    prefix.append(order[: len(h) - -(-len(h) * NUM // DEN) + 1].view(np.int64))
                    bits.append(_bitmap(h))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["row_no", "doc_id", "row_key", "n", "key", "prefix", "bits"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "row_key", "text")
    return written(rows.mapInArrow(run, "row_no long, doc_id long, row_key binary, n long, key binary, prefix array<long>, bits binary"), "sketches")


def _folded(bits: int, width: int, to: int) -> int:
    """A bitmap at a smaller width: halves are ORed until it fits."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class _Node:
    """ORed bitmap, range of sizes and the most by which a member's size exceeds its bits; children or members."""

    def __init__(self, bits: int, width: int, low: int, high: int, slack: int, components: set, children: list, members: list | None):
        self.bits, self.width, self.low, self.high, self.slack = bits, width, low, high, slack
        self.components, self.children, self.members = components, children, members


def _or_of(parts: list[tuple[int, int]]) -> tuple[int, int]:
    width, bits = min(w for _, w in parts), 0
    for b, w in parts:
        bits |= _folded(b, w, width)
    return bits, width


def signature_tree(rows: list[tuple[int, int, int, bytes]]) -> _Node:
    """A tree over classes (node, component, size, bitmap), in order of size and then of the lowest bits."""
    rows = sorted(rows, key=lambda r: (r[2].bit_length(), r[3][:8], r[2], r[0]))
    level = []
    for a in range(0, len(rows), LEAF):
        own = [(node, comp, n, int.from_bytes(b, "little"), 8 * len(b)) for node, comp, n, b in rows[a : a + LEAF]]
        bits, width = _or_of([(r[3], r[4]) for r in own])
        slack = max(n - _folded(b, w, width).bit_count() for _, _, n, b, w in own)
        level.append(_Node(bits, width, min(r[2] for r in own), max(r[2] for r in own), slack, {r[1] for r in own}, [], own))
    while len(level) > 1:
        up = []
        for a in range(0, len(level), FANOUT):
            c = level[a : a + FANOUT]
            bits, width = _or_of([(x.bits, x.width) for x in c])
            slack = max(x.slack if x.width == width else x.high for x in c)  # folding loses bits
            up.append(_Node(bits, width, min(x.low for x in c), max(x.high for x in c), slack, set().union(*(x.components for x in c)), c, None))
        level = up
    return level[0]


def _possible(a: _Node, b: _Node) -> bool:
    """False only if no member of a can reach the threshold with one of b."""
    if a.high * DEN < b.low * NUM or b.high * DEN < a.low * NUM:
        return False
    if len(a.components) == 1 and a.components == b.components:
        return False
    width, most = min(a.width, b.width), min(a.high, b.high)
    common = (_folded(a.bits, a.width, width) & _folded(b.bits, b.width, width)).bit_count()
    most = min([most, *(x.slack + common for x in (a, b) if x.width == width)])
    return most * (NUM + DEN) >= NUM * (a.low + b.low)


def may_reach(n: int, x: int, x_width: int, m: int, y: int, y_width: int) -> bool:
    """Whether sizes and bitmaps of two sets allow the threshold: a bit of one that the other lacks is a member outside the overlap."""
    if n * DEN < m * NUM or m * DEN < n * NUM:
        return False
    width = min(x_width, y_width)
    x, y = _folded(x, x_width, width), _folded(y, y_width, width)
    common = (x & y).bit_count()
    most = min(n - x.bit_count(), m - y.bit_count()) + common
    return most * (NUM + DEN) >= NUM * (n + m)


class Sets:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _leaf_pairs(a: _Node, b: _Node, sets: Sets) -> Iterator[tuple[int, int]]:
    for i, (p, cp, n, x, xw) in enumerate(a.members):
        for q, cq, m, y, yw in a.members[i + 1 :] if a is b else b.members:
            if cp != cq and sets.root(p) != sets.root(q) and may_reach(n, x, xw, m, y, yw):
                yield (p, q) if p < q else (q, p)


def tree_join(tree: _Node, sets: Sets) -> Iterator[tuple[int, int]]:
    """Dual traversal of a tree with itself: pairs of classes of different components that may reach the threshold.

    Pairs that the caller has put into one of ``sets`` meanwhile are left out.
    """
    todo = [(tree, tree)]
    while todo:
        a, b = todo.pop()
        if not _possible(a, b):
            continue
        if a.members is not None and b.members is not None:
            yield from _leaf_pairs(a, b, sets)
        elif a is b:
            todo += [(a.children[i], a.children[j]) for i in range(len(a.children)) for j in range(i, len(a.children))]
        elif b.members is not None or (a.members is None and a.high - a.low >= b.high - b.low):
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]


def _dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows`` with (i, j): members of a key beyond ``block`` are dealt to pairs of blocks, so that every pair of members meets."""
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    large = checkpointed(large.select(F.col(key).alias("large_key"), F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    dealt = rows.join(large, F.col(key) == F.col("large_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows without their first three columns, by runs of equal values in these."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(width)), strict=True):
            if row[:3] != key:
                if held:
                    yield held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield held


def _candidate_links(rows: DataFrame) -> DataFrame:
    """(a, b): links that tie classes of a bucket that may reach the threshold together; rows: (bucket, i, j, node, comp, n, bits), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ((), ()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for held in _runs(batches, 7):
            if len(held) < 2:
                continue
            sets = Sets()
            for p, q in tree_join(signature_tree(held), sets):
                sets.join(p, q)
            out.update((root, node) for node in sets.up if (root := sets.root(node)) != node)
            if len(out) > 100_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _verified_groups(groups: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join components of candidate groups (grp, node, comp); a class is in one group."""
    sets_of = _sets_of(groups.select("node").distinct(), reps, docs)
    rows = _dealt(groups, "grp", GROUP_BLOCK).join(sets_of, "node").select("grp", "i", "j", "node", "comp", "members")
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, 6):
            links, sets = [], Sets()
            own = sorted(held, key=lambda r: len(r[2]))
            arrays = [np.frombuffer(r[2], np.uint64) for r in own]
            bits = [_bitmap(h, 32) for h in arrays]
            bits = [(int.from_bytes(b, "little"), 8 * len(b)) for b in bits]
            for x, (p, cp, _) in enumerate(own):
                for y in range(x + 1, len(own)):
                    q, cq, _ = own[y]
                    if len(arrays[x]) * DEN < len(arrays[y]) * NUM:
                        break
                    # Components are named by nodes, so both fit one numbering: a node's own component is reached through its name.
                    if sets.root(cp) == sets.root(cq) or not may_reach(len(arrays[x]), *bits[x], len(arrays[y]), *bits[y]):
                        continue
                    if _linked(arrays[x], arrays[y]):
                        sets.join(cp, cq)
                        links.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    return written(rows.mapInArrow(run, "a long, b long"), "links")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    overlap = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * overlap >= 80 * (len(x) + len(y) - overlap)


def _only(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` that may have a value of ``wanted`` (one column): the others are left out before any shuffle."""
    name = wanted.columns[0]
    cells = cells_for(wanted.count())
    words = written(filter_words(wanted, name, cells, least=1), "filter")
    return maybe_in(df, column, words, cells, "near").filter("near").select(*df.columns)


def _sets_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, members) of some classes: texts are fetched through a filter of their ids, and sets made anew."""
    wanted = written(nodes.join(reps.select("node", "doc_id", "key"), "node"), "wanted")
    near = _only(docs, "doc_id", wanted.select("doc_id"))
    texts = near.join(wanted.select(F.col("doc_id").alias("d"), "node", "key"), F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                names, out = [], []
                for node, key, text in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                    own = shingles(text).tobytes()
                    if hashlib.blake2b(own, digest_size=16).digest() == key:
                        names.append(node)
                        out.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["node", "members"])

    return written(texts.mapInArrow(sets, "node long, members binary"), "sets").dropDuplicates(["node"])


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs (a, b)."""
    pairs = written(pairs, "pairs")
    found = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), reps, docs)
    # A class with many partners is dealt over several calls, each with its own copy of the class's set.
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    parts = counted.withColumn("parts", F.ceil(F.col("partners") / PARTNERS).cast("long"))
    dealt = pairs.join(parts.select("a", "parts"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    right = dealt.select("a", "part", "b").join(found.select(F.col("node").alias("b"), "members"), "b").select("a", "part", "b", "members")
    left = parts.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = left.join(found.select(F.col("node").alias("a"), "members"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "members")
    # One stream ordered by (a, part) with the class itself first: no group is held in memory.
    both = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            links: tuple[list, list] = ([], [])
            for a, b, members in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                h = np.frombuffer(members, np.uint64)
                if b is None:
                    own = h
                    continue
                if _linked(own, h):
                    links[0].append(a)
                    links[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    return written(both.mapInArrow(test, "a long, b long"), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (null for a null id whose component has no other)."""
    found = _components_of_rows(docs, id_col, text_col, F.lit(None).cast("binary"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _components_of_rows(docs: DataFrame, id_col: str, text_col: str, row_key: Column) -> DataFrame:
    """(doc_id, row_no, row_key, n, component, component_id) of every row; the last two are null for an empty set."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key.alias("row_key"))
    sketches = _sketches(docs, frequent_cells(docs))
    # Sets without an equal are a class of their own as they stand; only the others are shuffled to find their class.
    full = sketches.filter("n > 0")
    cells = cells_for(sketches.count())
    words = written(filter_words(full.select("key"), "key", cells), "filter")
    tested = maybe_in(full, "key", words, cells, "again")
    again = tested.filter("again")
    shared = again.groupBy("key").agg(F.min("row_no").alias("node"), F.min("doc_id").alias("low"))
    shared = written(shared, "shared")
    own = tested.filter("not again").select(F.col("row_no").alias("node"), "doc_id", "key", "n", "prefix", "bits")
    first_of = again.withColumnRenamed("row_no", "node").join(shared.select("node"), "node", "left_semi").select(*own.columns)
    reps = own.unionByName(first_of)
    classes = written(own.select("key", "node", F.col("doc_id").alias("low")).unionByName(shared.select("key", "node", "low")), "classes")
    whole = Window.partitionBy("token")
    hub = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).over(whole)
    buckets = reps.select(F.explode("prefix").alias("token"), "node", F.col("n").cast("int").alias("n"))
    buckets = buckets.withColumn("members", F.count(F.lit(1)).over(whole)).withColumn("hub", hub).filter("members > 1")
    buckets = written(buckets.select("token", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    stars = buckets.filter(f"node <> hub and n * {DEN} >= hub_n * {NUM} and hub_n * {DEN} >= n * {NUM}")
    stars = written(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "stars")
    # Read off the sketches: both are asked by node only, and any row of a class gives its set.  So no later plan tests every row again.
    bits, sets = full.select(F.col("row_no").alias("node"), "n", "bits"), classes.select("node", F.col("low").alias("doc_id"), "key")
    first = _verified(_bounded(stars, bits), sets, docs)
    joined = checkpointed(components(first))
    labelled = buckets.join(joined, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("comp"))
    # Buckets of the same members are searched once.
    mixed = labelled.withColumn("mixed", F.min("comp").over(whole) != F.max("comp").over(whole))
    mixed = mixed.withColumn("members", F.struct(F.count(F.lit(1)).over(whole), F.bit_xor(F.xxhash64("node")).over(whole), F.bit_xor(F.xxhash64("node", F.lit(1))).over(whole)))
    mixed = mixed.filter("mixed").groupBy(F.xxhash64("members").alias("bucket"), "node").agg(F.min("comp").alias("comp"), F.min("n").alias("n"))
    mixed = written(mixed, "mixed")
    near = _only(bits, "node", mixed.select("node").distinct())
    rows = _dealt(mixed, "bucket", BUCKET_BLOCK).join(near.select("node", "bits"), "node").select("bucket", "i", "j", "node", "comp", "n", "bits")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    # Classes that candidate links tie together are verified as one group, so no set is fetched or shipped for each of its buckets.
    tied = components(_candidate_links(rows)).withColumnRenamed("component", "grp")
    tied = tied.join(joined, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("comp"))
    second = _verified_groups(written(tied, "tied"), sets, docs)
    joined = components(first.unionByName(second))
    of_class = classes.join(joined, "node", "left").select("key", "low", F.coalesce("component", "node").alias("component"))
    lowest = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(of_class.select("key", "component").join(lowest, "component").select("key", "component", "component_id"), "named")
    # Empty sets share a key but no component.
    rows = sketches.select("doc_id", "row_no", "row_key", "n", "key").join(named, "key", "left")
    return rows.select("doc_id", "row_no", "row_key", "n", "component", "component_id")


def _bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                keep.append(may_reach(n, int.from_bytes(x, "little"), 8 * len(x), m, int.from_bytes(y, "little"), 8 * len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near = written(_only(bits, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "bits")
    x = near.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x"))
    y = near.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the least id (null ids last); texts that no filter marks as dropped aren't shuffled.

    Rows are told apart by a digest of id and text, so a row that repeats an id
    shares no other row's fate.  Of rows that repeat both, any one stays.
    """
    key = row_key(docs[id_col].cast("long"), docs[text_col])
    rows = written(_components_of_rows(docs, id_col, text_col, key).filter("component is not null").select("component", "doc_id", "row_key", "row_no"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key", "row_no")
    best = rows.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("top")).filter("members > 1")
    best = best.select("component", F.col("top.row_key").alias("top_key"), F.col("top.row_no").alias("top_row"))
    dropped = rows.join(best, "component").filter("row_no <> top_row").groupBy(F.col("row_key").alias("gone")).agg(F.max(F.col("row_key") == F.col("top_key")).alias("one_stays"))
    dropped = written(dropped, "dropped")
    cells = cells_for(dropped.count())
    words = written(filter_words(dropped, "gone", cells, least=1), "filter")
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("gone"))
    tested = maybe_in(tagged, "gone", words, cells, "near")
    some = tested.filter("near").join(dropped, "gone", "left")
    again = some.filter("one_stays").groupBy("gone").agg(F.any_value("row").alias("row"))
    return tested.filter("not near").select("row.*").unionByName(some.filter("one_stays is null").select("row.*")).unionByName(again.select("row.*"))
