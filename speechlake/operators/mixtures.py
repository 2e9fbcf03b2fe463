"""Synthetic overlaps: seeded plans of utterance pairs, drawn in parallel, and their mixing over chunk rows (EV-07, MA-07, MA-08).

The plan's random numbers are one xorshift sequence. A step of it is a 32 x 32 bit matrix, so the state after any number of steps comes from
powers of that matrix, and each task draws its own range of the sequence. A plan is what drawing one pair after the other gives: four
draws an attempt, the first attempt of a pair counts, and the first ``count`` different pairs, in order of attempts, are the plan.

Mixing never holds a whole sound: means and energies are sums over chunks, chunks are cut to the mixture's grid and added where they meet, and
the peak is a maximum over the mixed chunks, which are written once before they are scaled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

LANES = 1024


def _step(x):
    """One step of the sequence (shifts 13, 17, 5), for a number or an array of uint64 below 2^32."""
    x = x ^ (x << 13) & 0xFFFFFFFF
    x = x ^ (x >> 17)
    return x ^ (x << 5) & 0xFFFFFFFF


def _times(matrix: list[int], x: int) -> int:
    out = 0
    for bit, image in enumerate(matrix):
        if x >> bit & 1:
            out ^= image
    return out


def jump(state: int, steps: int) -> int:
    """The state after so many steps: the step as a matrix over bits, raised to the power by squaring."""
    power = [_step(1 << i) for i in range(32)]
    while steps:
        if steps & 1:
            state = _times(power, state)
        power = [_times(power, image) for image in power]
        steps >>= 1
    return state


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """MA-08: the numbers first, first + 1, .. of the sequence, in 0 .. 1; seed 0 counts as 1. Many stretches advance together."""
    start = jump((seed or 1) & 0xFFFFFFFF, first)
    lanes = max(1, min(LANES, count // 64))
    each = -(-count // lanes)
    stride = [jump(1 << i, each) for i in range(32)]
    states = [start]
    for _ in range(lanes - 1):
        states.append(_times(stride, states[-1]))
    x, out = np.array(states, np.uint64), np.empty((each, lanes), np.uint64)
    for k in range(each):
        x = _step(x)
        out[k] = x
    return out.T.ravel()[:count] / 4294967296


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """A column ``name``: 0, 1, .. in the order of the given columns, without a task that sees all rows. Written once, so ties keep their number."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    d = written(d, "numbered").withColumn("_part", F.shiftright("_id", 33))
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_id", "_before")  # one row a partition


def _attempts(spark, seed: int, count: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = f["id"].to_numpy()
            for a in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                if len(a):
                    x = draws(seed, 4 * int(a[0]), 4 * len(a)).reshape(-1, 4)
                    yield pd.DataFrame({"attempt": a, "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "x3": x[:, 3]})

    return spark.range(count).mapInPandas(run, "attempt long, x0 double, x1 double, x2 double, x3 double")


def mix_plan(utts: DataFrame, count: int, seed: int, snr: tuple[float, ...] = (-6.0, 0.0, 6.0), ratios: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """EV-07: (idx, source_a, source_b, snr_db, overlap_ratio, lead) of ``count`` different pairs of utterances of two speakers.

    ``utts``: id, speaker, ord (their order; speakers stand in that of their first one). A pair counts once whichever comes first; loudness
    cycles fastest, then the overlap ratio, the lead alternates between a and b. It is an error if fewer than two speakers are there, or if a
    hundred attempts for each pair don't give enough.
    """
    spark = utts.sparkSession
    named = utts.groupBy("speaker").agg(F.min("ord").alias("_first"), F.count("*").alias("size"))
    speakers = numbered(named, "who", "_first", "speaker").select("speaker", "who", "size")
    n = speakers.count()
    if n < 2:
        raise ValueError("a mix needs utterances of two speakers")
    placed = numbered(utts.select("id", "speaker", "ord").join(speakers.select(F.col("speaker").alias("_name"), "who"), F.expr("speaker <=> _name")).select("id", "who", "ord"), "place", "who", "ord", "id")
    begin = placed.groupBy("who").agg(F.min("place").alias("begin"), F.count("*").alias("size"))
    ratios = tuple(min(1.0, max(0.1, x)) for x in ratios)
    for many in (2, 10, 100):
        d = _attempts(spark, seed, many * count)
        second = F.floor(F.col("x1") * (n - 1))
        d = d.withColumn("a", F.floor(F.col("x0") * n)).withColumn("b", second + (second >= F.col("a")).cast("long"))
        for side, x in (("a", "x2"), ("b", "x3")):
            of = begin.select(F.col("who").alias(side), F.col("begin").alias("_begin"), F.col("size").alias("_size"))
            d = d.join(of, side).withColumn("place", F.col("_begin") + F.floor(F.col(x) * F.col("_size"))).drop("_begin", "_size")
            d = d.join(placed.select("place", F.col("id").alias(f"source_{side}")), "place").drop("place")
        pair = F.struct("source_a", "source_b")
        first = d.groupBy(F.least("source_a", "source_b").alias("_low"), F.greatest("source_a", "source_b").alias("_high")).agg(F.min("attempt").alias("attempt"), F.min_by(pair, "attempt").alias("p"))
        plan = numbered(first.select("attempt", "p.*"), "idx", "attempt").where(F.col("idx") < count)
        if many == 100 or plan.count() == count:
            break
    if many == 100 and plan.count() < count:
        raise ValueError("too few different pairs")
    cycle = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    i = F.col("idx")
    return plan.select("idx", "source_a", "source_b", cycle(snr, i).alias("snr_db"), cycle(ratios, F.floor(i / len(snr))).alias("overlap_ratio"), F.when(i % 2 == 0, "a").otherwise("b").alias("lead"))


def _moments(chunks: DataFrame) -> DataFrame:
    """(id, n, mean, rms) of whole sounds, the loudness around the mean."""
    add = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v.cast("double")))
    mean = chunks.groupBy("id").agg(F.sum(F.size("samples")).alias("n"), (F.sum(add(F.col("samples"), lambda v: v)) / F.sum(F.size("samples"))).alias("mean"))
    apart = chunks.join(mean, "id").groupBy("id", "n", "mean").agg(F.sum(add(F.col("samples"), lambda v: (v - F.col("mean")) * (v - F.col("mean")))).alias("e"))
    return apart.select("id", "n", "mean", F.sqrt(F.col("e") / F.col("n")).alias("rms"))


def mix_layout(plans: DataFrame, chunks: DataFrame, rate: int = 16000, target_rms: float = 0.1) -> DataFrame:
    """MA-07's numbers for each plan: gains, starts and lengths in samples, the true overlap, and a reason where a source is short or silent."""
    m = written(_moments(chunks), "moments")
    d = plans
    for side in ("a", "b"):
        d = d.join(m.select(F.col("id").alias(f"source_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "mean", "rms"))), f"source_{side}", "left")
    bad = lambda s: F.coalesce((F.col(f"n_{s}") < rate // 4) | (F.col(f"rms_{s}") < 1e-6), F.lit(True))
    target = max(0.01, min(0.3, target_rms or 0.1))
    first, second = F.col("lead") != "b", F.col("lead") == "b"
    shortest = F.least("n_a", "n_b")
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.when(F.coalesce("overlap_ratio", F.lit(0.0)) != 0, F.col("overlap_ratio")).otherwise(0.5)))
    d = d.withColumn("overlap", F.greatest(F.lit(1), F.floor(shortest * ratio + 0.5)))
    offset = F.greatest(F.lit(0), F.when(first, F.col("n_a")).otherwise(F.col("n_b")) - F.col("overlap"))
    d = d.withColumns({
        "reason": F.when(bad("a") | bad("b"), "short-or-silent"), "gain_a": target / F.col("rms_a"), "gain_b": target * F.pow(F.lit(10.0), -F.coalesce("snr_db", F.lit(0.0)) / 20) / F.col("rms_b"),
        "start_a": F.when(first, 0).otherwise(offset).cast("long"), "start_b": F.when(second, 0).otherwise(offset).cast("long"),
    })
    return d.withColumn("length", F.greatest(F.col("start_a") + F.col("n_a"), F.col("start_b") + F.col("n_b"))).drop("rms_a", "rms_b")


def mixed(layout: DataFrame, chunks: DataFrame, size: int = 480_000, peak: float = 0.98) -> DataFrame:
    """MA-07: (idx, chunk, mixture, stem_a, stem_b) of ``size`` samples a chunk. ``chunks`` (id, chunk, samples) may be of any lengths.

    Both stems are scaled alike where the mixture's peak is above ``peak``. Plans with a reason have no chunks.
    """
    before = Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.select("id", "chunk", F.size("samples").alias("m")).withColumn("at", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    placed = chunks.join(sizes, ["id", "chunk"]).where(F.size("samples") > 0)
    good = layout.where("reason IS NULL")
    parts = None
    for side in ("a", "b"):
        d = good.select("idx", "length", F.col(f"source_{side}").alias("id"), F.col(f"start_{side}").alias("start"), F.col(f"gain_{side}").alias("gain"), F.col(f"mean_{side}").alias("mean")).join(placed, "id")
        lo, n = F.col("start") + F.col("at"), F.size("samples")
        d = d.withColumn("chunk", F.explode(F.sequence(F.floor(lo / size), F.floor((lo + n - 1) / size))))
        skip = F.greatest(F.lit(0), F.col("chunk") * size - lo)
        take = F.least(n - skip, (F.col("chunk") + 1) * size - lo - skip)
        cut = F.transform(F.slice("samples", (skip + 1).cast("int"), take.cast("int")), lambda v: (v.cast("double") - F.col("mean")) * F.col("gain"))
        d = d.select("idx", "chunk", "length", F.lit(side).alias("side"), (lo + skip - F.col("chunk") * size).alias("place"), cut.alias("samples"))
        parts = d if parts is None else parts.unionByName(d)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        stems = {s: np.zeros(min(size, int(pdf["length"].iloc[0]) - chunk * size)) for s in "ab"}
        for side, place, x in zip(pdf["side"], pdf["place"], pdf["samples"], strict=True):
            stems[side][place : place + len(x)] = x
        mix = stems["a"] + stems["b"]
        return pd.DataFrame({"idx": [pdf["idx"].iloc[0]], "chunk": [chunk], "mixture": [mix], "stem_a": [stems["a"]], "stem_b": [stems["b"]], "_top": [np.abs(mix).max()]})

    kind = "idx long, chunk long, mixture array<double>, stem_a array<double>, stem_b array<double>, _top double"
    added = written(parts.groupBy("idx", "chunk").applyInPandas(run, kind), "mixed")
    top = added.groupBy("idx").agg(F.max("_top").alias("_peak"))
    scale = F.when(F.col("_peak") > peak, peak / F.col("_peak")).otherwise(1.0)
    scaled = lambda c: F.transform(c, lambda v: v * F.col("_scale")).alias(c)
    return added.join(top.select("idx", scale.alias("_scale")), "idx").select("idx", "chunk", *(scaled(c) for c in ("mixture", "stem_a", "stem_b")))


def mix_times(layout: DataFrame, rate: int = 16000) -> DataFrame:
    """MA-07's times in seconds: where each source lies, where they overlap, and how long the mixture is."""
    end = lambda s: F.col(f"start_{s}") + F.col(f"n_{s}")
    sec = lambda c: c / F.lit(float(rate))
    named: dict[str, Column] = {
        "start_a_s": sec(F.col("start_a")), "start_b_s": sec(F.col("start_b")), "end_a_s": sec(end("a")), "end_b_s": sec(end("b")),
        "overlap_start_s": sec(F.greatest("start_a", "start_b")), "overlap_end_s": sec(F.least(end("a"), end("b"))), "duration_s": sec(F.col("length")),
        "true_ratio": F.col("overlap") / F.least("n_a", "n_b"),
    }
    return layout.select("idx", "reason", *(c.alias(n) for n, c in named.items()))
