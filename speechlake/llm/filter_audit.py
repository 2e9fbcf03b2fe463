"""Operator 13, filter interaction audit: what each of five filters removes in every order of applying them, from 32 joint-failure counts.

Failure conditions over whole texts (null: empty), words being maximal runs of anything but space and U+0009..U+000D:
A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals A-Z > 2 * code points; D holds any of ``#$%&*|``;
E identical to the text of any smaller doc_id in the table, removed or not.

Method: for each set S of filters, J(S) counts the documents of a part that fail all of S, as a sum of products of flags; likewise for
those of good quality and the toxic ones. All else is Moebius inversion of these 32 numbers: after the filters P remain
sum over S in P of (-1)^|S| J(S); filter f after P removes sum over S in P of (-1)^|S| J(S + f). Removal is the game whose Harsanyi
dividends are (-1)^(|S|+1) J(S), each shared equally by the members of S, which gives the Shapley value, here times 120, an integer.

Defined cases: a row without a doc_id is no copy and no original of one; a repeated row is as new as its first; parts are the sources,
null and empty text being one; several labels of a document count as good (toxic) if any says 1; an empty table has no parts.
Nothing wider than a digest leaves the scan of the texts: one shuffle adds up equal rows, one finds each text's first number, and
the join back is on (text, number), which no hot text can fill.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The conditions that a text fails by itself: A to D."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(t), "D": t.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, A to E, good, toxic, rows): how many rows of a part share a text, a number and the labels."""
    flags = text_flags(F.col("text"))
    narrow = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *(c.alias(k) for k, c in flags.items()))
    same = materialize(narrow.groupBy("digest", "doc_id", "part", *flags).agg(F.count("*").alias("rows")), "audit-rows")
    first = same.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id", F.lit(True).alias("first"))
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # a number may have many texts: its key is written anew, so that the other side of the join isn't bound to the aggregate's partitioning
    judged = judged.select((F.col("doc_id") + F.lit(0).cast("long")).alias("doc_id"), "good", "toxic")
    out = same.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    return out.join(judged, "doc_id", "left").select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "rows")


def joint_failures(rows: DataFrame) -> DataFrame:
    """For each part the arrays n, good and toxic: at place S (the filters as bits, A the lowest) how many fail all filters of S."""

    def product(names: list[str]) -> Column:
        out = F.lit(1)
        for name in names:
            out = out * F.col(name)
        return out

    members = [[f for k, f in enumerate(FILTERS) if s >> k & 1] for s in SETS]
    bits = rows.select("part", "rows", *(F.col(c).cast("int").alias(c) for c in (*FILTERS, "good", "toxic")))
    sums = [F.sum(product([*m, *also]) * F.col("rows")).alias(f"{c}{s}") for c, also in zip(COUNTS, ([], ["good"], ["toxic"]), strict=True) for s, m in enumerate(members)]
    out = bits.groupBy("part").agg(*sums)
    return out.select("part", *(F.array(*(F.col(f"{c}{s}") for s in SETS)).alias(c) for c in COUNTS))


def _signed(counts: Column, within: Column, also: Column) -> Column:
    """Sum over the subsets S of ``within`` of (-1)^|S| counts[S + also]."""
    zero = F.lit(0).cast("long")
    sign = lambda s: 1 - 2 * (F.bit_count(s) % 2)
    term = lambda s: F.when(s.bitwiseAND(within) == s, sign(s) * F.get(counts, s.bitwiseOR(also))).otherwise(zero)
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), zero, lambda a, s: a + term(s))


def audit(joint: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    every = F.lit(len(SETS) - 1)
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]).cast("array<string>")).alias("filter_order")
    steps = joint.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    weight = F.lit([1 << k for k in range(len(FILTERS))])
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.substr(F.col("filter_order"), i, F.lit(1)))
    bits = F.transform(letters, lambda c: F.element_at(weight, F.instr(F.lit(FILTERS), c)))
    mine = F.get(F.col("bits"), F.col("step") - 1)
    earlier = F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    d = steps.withColumn("bits", bits).select("*", mine.alias("own"), earlier.alias("past"))
    own, past, none = F.col("own"), F.col("past"), F.lit(0)
    removed = _signed(F.col("n"), past, own)
    dividend = lambda s: F.when(s.bitwiseAND(own) != 0, (2 * (F.bit_count(s) % 2) - 1) * F.get(F.col("n"), s) * (120 / F.bit_count(s)).cast("long")).otherwise(F.lit(0).cast("long"))
    return d.select(
        "part", "filter_order", "step", _signed(F.col("n"), past.bitwiseOR(own), none).alias("kept"), removed.alias("removed"),
        (F.get(F.col("n"), own) - removed).alias("redundant"), _signed(F.col("n"), every.bitwiseXOR(own), own).alias("unique_fails"),
        _signed(F.col("good"), past, own).alias("good_lost"), _signed(F.col("toxic"), past, own).alias("toxic_lost"),
        F.aggregate(F.sequence(F.lit(1), every), F.lit(0).cast("long"), lambda a, s: a + dividend(s)).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(joint_failures(failures(docs, labels)))
