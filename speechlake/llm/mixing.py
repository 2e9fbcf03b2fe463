"""Operator 1: mixing sources to target weights, as fixed-length blocks of tokens.

Each source's documents form one stream of words in a pseudorandom order, cut into blocks of a fixed number of words.
Targets are shared by weight and stop at ``most`` times a source's size. Output shards have a fixed number of slots; each
shard's source counts are drawn from the multinomial law conditioned on the sources' totals (without replacement), so that
the totals hit the targets: a plain draw would miss a small source by several percent. The slots of a source are numbered
over all shards, and slot i of a source with n blocks takes block P(i mod n) of pass i div n, where P is a pseudorandom
permutation of the indices, another one for each source and pass. Blocks and slots then meet in an equi-join on
(source, block). All randomness comes from hashes of positions, so reruns agree.

A hot source is spread over all tasks in every step: its stream offsets come from bucket totals, its slots from ranges.
The number of sources, buckets and shards is small next to the blocks; only tables of these are windowed per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count
from .sharding import bucket_count, prefix_sums

CHUNK = 1 << 14
WALK = 64
TASK_SLOTS = 1 << 18
STRETCH = 4096  # shards whose counts are added up together


@dataclass(frozen=True)
class Mix:
    """share: of all words, that the targets sum to. most: passes over a source at most. Slots and words: of a shard and block."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 64
    shard_slots: int = 4096
    seed: int = 20240611


def permute(x: Column, n: Column, *key: Column | int) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 (n >= 1) for each key: Feistel rounds over ceil(sqrt n) x ceil(n / that) cells.

    Fewer than sqrt(n) + 1 cells lie beyond n; a walk from such a cell goes on until it is back inside. It is given 64
    steps, while a share of under a tenth of the cells lies outside for any n over 121 and no walk is over 11 below.
    """
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(v: Column) -> Column:
        def shift(to: Column, of: Column, k: int, m: Column) -> Column:
            return F.pmod(to + F.pmod(F.xxhash64(of, F.lit(k), *keys), m), m)

        high, low = F.call_function("div", v, b), F.pmod(v, b)
        for k in (0, 2):
            high = shift(high, low, k, a)
            low = shift(low, high, k + 1, b)
        return high * b + low

    first = once(x.cast("long"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v >= n, once(v)).otherwise(v))
    return F.when(first < n, first).otherwise(walk)


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: source, rank, source_size, target double, blocks, slots.

    Sources by code point, null last, take the weights in turn. Targets are filled like water: in order of what a unit of
    weight can hold, the first source below its limit fixes the level for all that follow.
    """
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    row = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("rank") - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    table = table.withColumn("rank", F.row_number().over(row)).withColumn("weight", weight)
    table = table.withColumn("most", mix.most * F.col("source_size"))
    held = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    table = table.withColumns({
        "level": (F.sum("source_size").over(every) * mix.share - F.coalesce(F.sum("most").over(held), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(held), F.lit(0)))
    })
    table = table.withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    table = table.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("most") / F.col("weight"))).over(every))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    blocks = F.ceil(F.col("source_size") / mix.block_words).cast("long")
    table = table.withColumn("target", target).withColumn("blocks", blocks)
    slots = F.when(F.col("blocks") > 0, F.least(mix.most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0)
    return table.withColumn("slots", slots.cast("long")).select("source", "rank", "source_size", "target", "blocks", "slots")


def _ranges(table: DataFrame, count: str, name: str, tasks: int) -> DataFrame:
    """Rows repeated for name = 0 .. count - 1, in two steps so that a large count is dealt over all tasks."""
    part = table.where(F.col(count) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(CHUNK).cast("long"))))
    part = part.repartition(tasks, "rank", "_from")
    to = F.least(F.col(count), F.col("_from") + CHUNK) - 1
    return part.withColumn(name, F.explode(F.sequence(F.col("_from"), to))).drop("_from")


def draw(sources: DataFrame, mix: Mix) -> DataFrame:
    """The mixture: one row per slot, (rank, shard, pass, block)."""
    # few bytes stand for many slots, so the number of tasks follows the slots; planned by bytes, all would be one task's
    tasks = max(1, -(-int(sources.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.select(
        "rank", "blocks", "slots", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("lo"),
        F.sum("slots").over(Window.partitionBy()).alias("all"),
    )
    place = permute(F.col("lo") + F.col("i"), F.col("all"), mix.seed)
    counts = (
        _ranges(s, "slots", "i", tasks).withColumn("shard", F.call_function("div", place, F.lit(mix.shard_slots).cast("long")))
        .groupBy("rank", "blocks", "shard").count()
    )
    # a source's counts are added up within stretches of shards, and these among themselves: no window holds all shards
    counts = materialize(counts.withColumn("stretch", F.call_function("div", F.col("shard"), F.lit(STRETCH).cast("long"))), "mix-counts")
    sofar = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("rank", "stretch").agg(F.sum("count").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(sofar("rank", "stretch")), F.lit(0))).drop("n")
    counts = counts.join(sums, ["rank", "stretch"]).withColumn("first", F.col("base") + F.coalesce(F.sum("count").over(sofar("rank", "stretch", "shard")), F.lit(0))).drop("base", "stretch")
    slots = counts.repartition(tasks, "rank", "shard").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    i = F.col("first") + F.col("k")
    slots = slots.select("rank", "shard", "blocks", F.call_function("div", i, F.col("blocks")).alias("pass"), F.pmod(i, F.col("blocks")).alias("at"))
    return slots.withColumn("block", permute(F.col("at"), F.col("blocks"), F.lit(mix.seed + 1), F.col("rank"), F.col("pass"))).drop("at", "blocks")


def pieces(sized: DataFrame, sources: DataFrame, mix: Mix, rows: int) -> DataFrame:
    """The blocks' content: one row per document and block, (rank, block, row, the document's columns, word_from, words)."""
    joined = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    joined = joined.where("size > 0").select("d.*", "rank", "source_size", "target")
    placed = prefix_sums(joined, ["rank"], ["doc_id", "size"], "size", bucket_count(rows))
    size, n = F.col("_start") + F.col("size"), F.lit(mix.block_words).cast("long")
    first, last = F.call_function("div", F.col("_start"), n), F.call_function("div", size - 1, n)
    out = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_start"), F.col("block") * n)
    return out.select(
        "rank", "block", F.col("_index").alias("row"), *sized.columns, "source_size", "target",
        (begin - F.col("_start")).alias("word_from"), (F.least(size, (F.col("block") + 1) * n) - begin).alias("words"),
    )


def mixture(sized: DataFrame, mix: Mix, how: str = "inner") -> DataFrame:
    """The placed pieces (rank, row, doc_id, size, .., source_size, target, shard, pass, block, word_from, words) of documents with
    columns doc_id, source, size (words); others are left out. With how="left" also pieces that no slot took, shard null.

    Documents of size 0 are in no block. A null source is a source of its own; rows with the same doc_id, or equal rows, are
    documents of their own. An empty table gives an empty result.
    """
    sources = materialize(targets(sized, mix), "mix-sources")
    # Catalyst takes the slots for as few as the sources that they are exploded from; they grow with the input, so no broadcast
    sized = sized.select("doc_id", "source", "size")
    return pieces(sized, sources, mix, sized.count()).join(draw(sources, mix).hint("merge"), ["rank", "block"], how)


def taken_words(sized: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken long: words the mix takes of each document, repeats counted; 0 for empty ones."""
    columns = ["doc_id", "size", "source_size", "target"]
    taken = F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("words"))), F.lit(0)).cast("long").alias("taken")
    out = mixture(sized, mix, "left").groupBy("rank", "row", *columns).agg(taken).select(*columns, "taken")
    sources = targets(sized, mix).alias("s")
    none = sized.where("size = 0").alias("d").join(sources, F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.unionByName(none.select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mixture as rows of ``docs`` (doc_id, text, source, n_chars and others): one row per document, pass and run of blocks taken.

    A run is a stretch of neighbouring blocks, so a pass that takes all of a document gives its text unchanged; a shorter
    run gives the words it spans with the space between them. n_chars is the new text's. Documents that aren't taken, empty
    ones among them, are in no row. Numbers stay those of the documents, once for each pass or run.
    """
    # written with the texts: a second evaluation could split the files otherwise, and give other keys
    numbered = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("in"), F.monotonically_increasing_id().alias("key")), "keyed")
    sized = materialize(numbered.select(F.col("key").alias("doc_id"), F.col("in.source").alias("source"), word_count(F.col("in.text")).alias("size")), "sized")
    taken = mixture(sized, mix)
    order = Window.partitionBy("doc_id", "pass").orderBy("word_from")
    fresh = F.col("word_from") != F.coalesce(F.lag(F.col("word_from") + F.col("words")).over(order), F.lit(-1))
    runs = taken.withColumn("new", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("doc_id", "size", "pass", "run").agg(F.min("word_from").alias("first"), F.sum("words").alias("n"))
    runs = materialize(runs.select(F.col("doc_id").alias("key"), "first", "n", (F.col("n") == F.col("size")).alias("all")), "mix-runs")
    joined = numbered.join(runs, "key")
    tokens = F.regexp_extract_all("in.text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(tokens, (F.col("first") + 1).cast("int"), F.col("n").cast("int")), "")
    text = F.when(F.col("all"), F.col("in.text")).otherwise(part)
    new = joined.select("in", text.alias("text"))
    fresh_columns = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return new.select(*(fresh_columns.get(c, F.col(f"in.`{c}`")).alias(c) for c in docs.columns))
