"""Operator 9: quality rules with risk-controlled thresholds, in DataFrame functions only.

Distinct labelled texts are split in two by their digest, so copies of a text are one trial. On the tuning half, each stratum's
(language's) pairs of rule and cutoff that reject more of the bad than of the good documents are put in order, those that
reject the fewest good ones first. On the holdout half the unions of the first, the first two, .. pairs are tested one after
the other: with k of n good documents rejected by the union, the exact binomial tail P(X <= k | n, alpha) must not exceed
delta over the number of strata (Bonferroni). A fixed sequence of tests that ends at the first failure needs no further
correction, so with probability 1 - delta the rules in use *together* reject at most alpha of any stratum's good documents. Only
documents that the base test passes count, as the rules decide only about these. Counts cover all labels; only sums per
stratum and pair leave the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


@dataclass(frozen=True)
class Risk:
    """alpha: share of good documents that all rules together may reject in a stratum; delta: chance that any stratum exceeds it."""

    alpha: float = 0.02
    delta: float = 0.05
    #: cutoffs per rule; a document is rejected where the rule's value is above
    grid: dict[str, tuple[float, ...]] = field(default_factory=lambda: {
        "symbols": (0.02, 0.05, 0.1, 0.2),
        "capitals": (0.2, 0.4, 0.6),
        "word_length": (8.0, 10.0, 15.0, 30.0),
        "repeats": (0.05, 0.1, 0.2),
    })


def _less(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus its MD5 as text_key, the base counts and the rules' values; null text counts as empty.

    Repeated windows: each window of 8 words is hashed to 64 bits. Only where some hash is repeated are (hash, position)
    pairs sorted, so that equal windows are neighbours; the words of all windows with an equal neighbour are counted once.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    d = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    words = F.array_remove(F.split(F.translate("_t", SPACES, " " * len(SPACES)), " "), "")
    d = d.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("_h")
    window = F.when(
        F.size(h) > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(WINDOW)))),
    )
    d = d.withColumn("_w", window)
    w = F.col("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES + " ", "")) > 0)
    d = d.withColumn("_l", lines)
    order = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct(w)) < F.size(w), order))
    s = F.col("_s")
    beside = lambda x, i, j: x["h"] == F.try_element_at(s, i + j)["h"]
    equal = F.filter(s, lambda x, i: F.coalesce(beside(x, i, 2), F.lit(False)) | F.coalesce(F.when(i > 0, beside(x, i, F.when(i > 0, 0).otherwise(1))), F.lit(False)))
    d = d.withColumn("_p", F.array_sort(F.transform(equal, lambda x: x["i"])))
    p = F.col("_p")
    cover = F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).cast("int").alias("n"), x.cast("int").alias("last")),
        lambda a: a["n"],
    )
    long = lambda x: x.cast("long")
    d = d.select(
        *kept, F.md5("_t").alias("text_key"), long(F.size(h)).alias("n_words"), long(_less(F.col("_t"), SPACES + " ")).alias("word_chars"),
        long(F.length("_t") - _less(F.col("_t"), SYMBOLS)).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(F.coalesce(cover, F.lit(0))).alias("n_repeat_words"),
        long(F.length("_t") - _less(F.col("_t"), UPPER)).alias("_upper"),
    )
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return d.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbols": F.col("n_symbols") / at_least_one("word_chars"),
        "capitals": F.col("_upper") / at_least_one("word_chars"),
        "word_length": F.col("word_chars") / at_least_one("n_words"),
        "repeats": F.col("n_repeat_words") / at_least_one("n_words"),
    }).drop("_upper")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly: a sum of the terms in logarithms, each from the one before."""
    state = lambda t, s: F.struct(t.cast("double").alias("t"), s.cast("double").alias("s"))
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(t, a["s"])
        return state(t, top + F.log(F.exp(t - top) + F.exp(a["s"] - top)))

    return F.exp(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), state(first, first), add, lambda a: a["s"]))


def cutoffs(labelled: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, rule, cutoff) in use, from labelled documents (text_key, stratum, quality, base_failed, rules' values).

    Quality is 1 for good and 0 for bad, of a text with several labels the least; rows with a null quality are left out, and so
    are those that fail the base test. Texts whose key begins with an even hex digit tune, the others certify.
    """
    rules = list(risk.grid)
    known = labelled.where("quality IS NOT NULL")
    m = known.select("stratum").distinct().count()
    known = known.where("NOT base_failed").groupBy("stratum", "text_key").agg(F.min("quality").alias("quality"), *(F.max(r).alias(r) for r in rules))
    good, even = F.col("quality") == 1, F.substring("text_key", 1, 1).isin(*"02468ace")
    n = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    pairs = F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), n(even & ~good & (F.col(r) > c)).alias("bad_out"), n(even & good & (F.col(r) > c)).alias("good_out"))
        for r, grid in risk.grid.items() for c in grid
    ))
    sums = known.groupBy("stratum").agg(n(even & ~good).alias("bad"), n(even & good).alias("good"), n(~even & good).alias("n"), pairs.alias("pairs"))
    flat = sums.select("stratum", "n", "bad", "good", F.inline("pairs"))
    lost = F.col("good_out") / F.greatest("good", F.lit(1))
    flat = flat.withColumn("lost", lost).where((F.col("bad_out") / F.greatest("bad", F.lit(1)) > lost) & (F.col("n") > 0))
    order = Window.partitionBy("stratum").orderBy("lost", F.desc("bad_out"), "rule", F.desc("cutoff"))
    tests = materialize(flat.withColumn("place", F.row_number().over(order)).select("stratum", "n", "rule", "cutoff", "place"), "tests")
    # a holdout document is rejected from the first place on whose rule rejects it
    listed = tests.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cutoff", "place")).alias("tests"))
    held = known.where(~even & good).select(F.col("stratum").alias("s"), *rules)
    value = lambda t: F.coalesce(*(F.when(t["rule"] == r, F.col(r)) for r in rules))
    first = F.array_min(F.transform("tests", lambda t: F.when(value(t) > t["cutoff"], t["place"])))
    out = held.join(listed, F.col("s").eqNullSafe(F.col("stratum"))).groupBy("stratum", first.alias("place")).agg(F.count("*").alias("out"))
    t, o = tests.alias("t"), out.where("place IS NOT NULL").alias("o")
    lines = t.join(o, F.col("t.stratum").eqNullSafe(F.col("o.stratum")) & (F.col("t.place") == F.col("o.place")), "left").select("t.*", F.coalesce("out", F.lit(0)).alias("out"))
    k = F.sum("out").over(Window.partitionBy("stratum").orderBy("place"))  # grows with the place, and the tail with it: failures come last
    passed = lines.withColumn("k", k).where(binomial_tail(F.col("k"), F.col("n"), risk.alpha) <= risk.delta / max(1, m))
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, risk: Risk, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of ``docs`` with the base counts, base_failed and kept; see ``judge``. Texts are measured once, and what
    is kept of the rows is written with their measures, so a row's verdict never depends on a number.
    """
    rules = list(risk.grid)
    columns = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(kept)]
    d = materialize(measure(docs.select(*columns, F.col("doc_id").alias("_doc"), F.col("lang").alias("stratum"), F.col("text").alias("text"))), "quality")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("quality"))
    chosen = cutoffs(d.select("_doc", "text_key", "stratum", "base_failed", *rules).join(marks, "_doc"), risk)
    table = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in rules))
    out = d.alias("d").join(materialize(table, "cutoffs").alias("c"), F.col("d.stratum").eqNullSafe(F.col("c.stratum")), "left")
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False))
    back = [F.col(f"in_{k}").alias(c) for k, c in enumerate(kept)]
    return out.select(*back, *(F.col(c).alias(f"_{c}") for c in COUNTS), F.col("base_failed").alias("_base_failed"), (~F.col("base_failed") & ~rejected).alias("_kept"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of documents (doc_id, text, lang).

    ``labels`` (doc_id, quality). A document labelled several times is good only if all its labels are. A null language is
    a stratum of its own; without labels, or with too few, no rule is certified and the base test alone decides. Rows
    with the same doc_id, equal rows and null numbers are judged each by its own text. Empty tables give an empty table.
    """
    out = verdicts(docs, labels, risk or Risk(), ["doc_id"])
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in [*COUNTS, "base_failed", "kept"]))


def keep(docs: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Texts are measured in one scan and never shuffled."""
    columns = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)), "doc_id", "lang", "text")
    out = verdicts(inner, labels, risk or Risk(), [f"c{k}" for k in range(len(columns))]).where("_kept")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
