"""Secrets in texts: three fixed patterns and a battery of randomness tests, in DataFrame functions only.

Base kinds are found by their patterns, leftmost and without overlaps, each for
itself.  The battery looks at runs of characters as keys and tokens have them.
The encoding of a run is inferred (hex, base32, base36, base62, base64), and
three tests ask whether it could be uniform noise in that alphabet: chi-squared
over bins of symbols, as many as the length can fill; the runs test about the
alphabet's middle; circular serial correlation.  Their p-values are combined by
Cauchy's rule, which holds for dependent tests.

Clearing a run as ordinary text is the discovery whose false rate is controlled:
within each class of length, the Benjamini-Hochberg rule over all runs of the
corpus clears so many that a share of ``FALSE_CLEARED`` of them, at most, is
noise; what it can't clear is a span of kind ``random``.  Classes keep short
runs, which tests can hardly tell, from riding on long ones.  The rule reads
counts by class and bucket of p (``BUCKETS`` to a power of ten), a table whose
size doesn't depend on the corpus; everything else is one pass over the texts
without a shuffle.

Defined cases: a null text is empty and has no spans; positions are code points,
ends exclusive; repeated rows and null ids are rows of their own; an empty table
gives no rows; extra columns are ignored.  Spans of different kinds may overlap,
and a run may be of a base kind too.  Runs of digits alone, or of letters of one
case alone, are in no encoding but hex or base32.  Time grows with a text's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Lengths of group 2 and of matches from which on they count; for the last two a shorter match is a whole run and hides no longer one.
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: Runs begin where none is under way, so that the inside of a word is left at once.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Lengths at which a class of runs begins.
CLASSES = (20, 28, 40, 64, 128)
FALSE_CLEARED = 0.05
BUCKETS = 32
#: A test that fits perfectly counts as this, so that it can't outweigh the others.
MOST_P = 0.99
#: Expected symbols in a bin of the chi-squared test.
BIN = 5
#: Matches that are gathered before they are put to the others, so that a text of n matches takes n * BLOCK steps at most.
BLOCK = 256

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (what a run of the encoding looks like, its alphabet in the order of values)
ENCODINGS = (
    (r"^[0-9]+$", None),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[a-z]+$", None),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"", _UPPER + _LOWER + _DIGITS + "+/"),
)


def matches(text: Column, pattern: str, more: Column | None = None) -> Column:
    """Array of (start, end, own) of the leftmost matches that don't overlap: what lies between them gives their places.

    Places add up in an aggregate over blocks, so the array isn't copied for each match.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda own, gap: F.struct(F.length(gap).alias("gap"), F.length(own).alias("width"), own.alias("own")),
    )
    one = "struct<start:int,end:int,own:string>"
    zero = F.struct(
        F.array().cast(f"array<array<{one}>>").alias("done"), F.array().cast(f"array<{one}>").alias("now"), F.lit(0).alias("at")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        new = F.array(F.struct(start.alias("start"), (start + x["width"]).alias("end"), x["own"].alias("own")))
        full = F.size(acc["now"]) >= BLOCK
        return F.when(
            x["own"].isNotNull(),  # the last gap has no match behind it
            F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, new).otherwise(F.concat(acc["now"], new)).alias("now"),
                (start + x["width"]).alias("at"),
            ),
        ).otherwise(acc)

    placed = F.aggregate(pairs, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{one}>"))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind) + 1).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) in order; kinds count from 1 as in ``KINDS``."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["own"], ASSIGN, 2)) >= ASSIGN_LEAST)
    found = F.concat(_spans(assign, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex"))
    return F.array_sort(found)


def written_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _two_sided(z: Column) -> Column:
    """The share of the normal distribution beyond z on both sides (Abramowitz and Stegun 7.1.26), ``MOST_P`` at most."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(MOST_P), poly * F.exp(-x * x))


def _inferred(run: Column) -> Column:
    alphabet = F.lit(None).cast("string")
    for looks, symbols in reversed(ENCODINGS):
        alphabet = F.when(run.rlike(looks), F.lit(symbols).cast("string")).otherwise(alphabet)
    return alphabet


def _counted(x: Column) -> Column:
    """What the tests need of a run: symbols' counts, signs about the middle, sums for the serial correlation."""
    run, symbols = x["own"], x["alphabet"]
    middle = F.floor(F.length(symbols) / 2).cast("int")
    marks = F.concat(F.repeat(F.lit("0"), middle), F.repeat(F.lit("1"), F.length(symbols) - middle))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("s", "ss", "p")], F.lit(-1.0).alias("first"), F.lit(0.0).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        v = F.position(c, symbols).cast("double")
        return F.struct(
            (acc["s"] + v).alias("s"), (acc["ss"] + v * v).alias("ss"), (acc["p"] + acc["last"] * v).alias("p"),
            F.when(acc["first"] < 0, v).otherwise(acc["first"]).alias("first"), v.alias("last"),
        )

    n, size = F.length(run), F.length(symbols)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), n.cast("double").alias("n"), size.alias("size"),
        F.least(size, F.greatest(F.lit(2), F.floor(n / BIN).cast("int"))).alias("bins"),
        F.transform(F.split(symbols, ""), lambda c: F.length(run) - F.length(F.replace(run, c, F.lit("")))).alias("counts"),
        F.call_function("translate", run, symbols, marks).alias("signs"),
        F.aggregate(F.split(run, ""), zero, step).alias("sums"),
    )


def _measured(x: Column) -> Column:
    """The three statistics."""
    n, size, bins = x["n"], x["size"], x["bins"]
    # Bin b holds the symbols from ceil(b * size / bins) on.
    edge = lambda b: F.ceil(b * size / bins).cast("int")

    def off(b: Column) -> Column:
        got = F.aggregate(F.slice(x["counts"], edge(b) + 1, edge(b + 1) - edge(b)), F.lit(0), lambda a, c: a + c)
        expected = n * (edge(b + 1) - edge(b)) / size
        return F.pow(got - expected, F.lit(2)) / expected

    without = lambda part: F.length(F.replace(x["signs"], F.lit(part), F.lit("")))
    s = x["sums"]
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), bins.alias("bins"),
        F.aggregate(F.transform(F.sequence(F.lit(0), bins - 1), off), F.lit(0.0), lambda a, c: a + c).alias("chi"),
        (n - without("1")).alias("high"), (1 + (n - without("01")) / 2 + (n - without("10")) / 2).alias("turns"),
        (n * (s["p"] + s["last"] * s["first"]) - s["s"] * s["s"]).alias("around"), (n * s["ss"] - s["s"] * s["s"]).alias("below"),
    )


def _standardised(x: Column) -> Column:
    """The statistics as normal deviates; null where all symbols are on one side, or the same: as far from noise as can be."""
    n, spread = x["n"], 2 / (9 * (x["bins"] - 1))
    mean = 2 * x["high"] * (n - x["high"]) / n + 1
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), n.alias("n"),
        ((F.pow(x["chi"] / (x["bins"] - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)).alias("chi"),
        F.when((x["high"] > 0) & (x["high"] < n), (x["turns"] - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))).alias("runs"),
        F.when(x["below"] > 0, (x["around"] / x["below"] + 1 / (n - 1)) / F.sqrt(n * n / ((n - 1) * (n - 1) * (n - 2)))).alias("serial"),
    )


def _combined(x: Column) -> Column:
    mean = sum(F.tan((0.5 - F.coalesce(_two_sided(x[t]), F.lit(0.0))) * math.pi) for t in ("chi", "runs", "serial")) / 3
    length_class = sum(((x["n"] >= least).cast("int") for least in CLASSES[1:]), F.lit(0))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), length_class.alias("class"), F.greatest(F.lit(1e-17), 0.5 - F.atan(mean) / math.pi).alias("p"))


def tested_runs(text: Column) -> Column:
    """Array of (start, end, class, p) of the runs in a text whose encoding can be inferred; p is how likely noise looks like them."""
    runs = F.transform(matches(text, RUN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.call_function("translate", x["own"], F.lit("-_"), F.lit("+/")).alias("own")))
    known = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["own"].alias("own"), _inferred(x["own"]).alias("alphabet")))
    known = F.filter(known, lambda x: x["alphabet"].isNotNull())
    for stage in (_counted, _measured, _standardised, _combined):  # a stage each, so that what it makes is made once
        known = F.transform(known, stage)
    return known


def clearing_bounds(tested: DataFrame, runs: str = "runs") -> DataFrame:
    """One row: ``bounds``, the p up to which runs of each class are cleared (0: none)."""
    each = tested.select(F.explode(runs).alias("r")).select(F.col("r.class").alias("class"), F.floor(-F.log10("r.p") * BUCKETS).alias("bucket"))
    counts = each.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a bucket for each of 17 * BUCKETS values at most
    so_far = Window.partitionBy("class").orderBy(F.desc("bucket"))
    ranked = counts.withColumn("upto", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(Window.partitionBy("class")))
    most = F.pow(F.lit(10.0), -F.col("bucket") / BUCKETS)
    cleared = ranked.withColumn("most", most).filter(F.col("most") <= FALSE_CLEARED * F.col("upto") / F.col("all"))
    return cleared.agg(F.array(*[F.coalesce(F.max(F.when(F.col("class") == c, F.col("most"))), F.lit(0.0)) for c in range(len(CLASSES))]).alias("bounds"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tested = written(rows.select("doc_id", base_spans(F.col("text")).alias("base"), tested_runs(F.col("text")).alias("runs")), "runs")
    rows = tested.crossJoin(F.broadcast(clearing_bounds(tested)))  # one row
    random = F.filter("runs", lambda r: r["p"] > F.element_at("bounds", r["class"] + 1))
    rows = rows.select("doc_id", "base", _spans(random, "random").alias("random"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
