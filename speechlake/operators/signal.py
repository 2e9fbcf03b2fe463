"""Sample-array operators (MA-03/04, WN-12/13, SNK-02/03, ST-01)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let, mean, rms, round6


def normalize_stem(v: Column, target: Column) -> Column:
    """MA-03: without its mean, scaled towards the target loudness but below the peak limit."""

    def scaled(c: Column) -> Column:
        peak = F.aggregate(c, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        scale = F.least(1.15 * F.greatest(F.lit(0.015), target) / F.greatest(F.lit(1e-12), rms(c)), 0.95 / F.greatest(F.lit(1e-12), peak))
        return let(scale, lambda k: F.transform(c, lambda x: x * k))

    return let(let(mean(v), lambda m: F.transform(v, lambda x: x - m)), scaled)


def waveform_peaks(samples: DataFrame, key: str, vec: str, buckets: int = 1200) -> DataFrame:
    """WN-12: (key, bucket, peak): the largest magnitude in each of about ``buckets`` stretches, found within the row."""
    n = F.size(vec)
    size = F.greatest(F.lit(1), F.floor(n / buckets)).cast("int")
    loud = lambda b: F.array_max(F.transform(F.slice(vec, b * size + 1, size), F.abs))
    peaks = F.when(n > 0, F.transform(F.sequence(F.lit(0), (F.ceil(n / size) - 1).cast("int")), loud))
    return samples.select(key, F.posexplode(peaks).alias("bucket", "_x")).select(key, "bucket", round6(F.col("_x").cast("double")).alias("peak"))


def peak_hold(peaks: DataFrame, key: str, order: str, peak: str, decay: float = 0.7) -> DataFrame:
    """WN-13: peak with decay, in closed form: the largest of the peaks so far, each times decay to the power of its age.

    The largest of log(peak) plus age does not depend on where the ages are counted from, so one running maximum over all earlier
    rows does it, however far back the peak lies.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    level = F.when(F.col(peak) > 0, F.log(F.col(peak)) - F.col("_n") * F.log(F.lit(decay)))
    d = peaks.withColumn("_n", n).withColumn("_top", F.max_by(F.struct(F.col(peak).alias("x"), F.col("_n").alias("i")), level).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.coalesce(F.col("_top.x") * F.pow(F.lit(decay), F.col("_n") - F.col("_top.i")), F.lit(0.0))
    return d.withColumn("held", round6(held)).drop("_n", "_top")


def pcm16_wav(samples: np.ndarray, rate: int = 16000) -> bytes:
    """SNK-02/03: a mono 16-bit WAV of float samples, clipped to the unit range and rounded half up."""
    data = np.floor(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def pcm16(v: Column) -> Column:
    """The sample conversion of SNK-03 as an expression."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767 + 0.5).cast("int"))


def source_shares(stems: Column) -> Column:
    """MA-04: each stem's share of the stems' loudness; zero for silence."""
    return let(F.transform(stems, rms), lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(r, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def reframe(chunks: DataFrame, key: str, order: str, samples: str, size: int = 1600) -> DataFrame:
    """ST-01: (key, frame long, samples) of exactly ``size`` samples from chunks of any length in order; the rest of a stream waits for more.

    A chunk's place comes from a window over sizes alone, joined back to the samples; ``order`` is a chunk's own within its key.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = chunks.select(key, order, F.col(samples).alias("x"), F.size(samples).alias("m")).where("m > 0")
    at = d.select(F.col(key).alias("_k"), F.col(order).alias("_o"), "m").withColumn("at", F.coalesce(F.sum("m").over(w.partitionBy("_k").orderBy("_o")), F.lit(0))).drop("m")
    d = d.join(at, F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_o"))).drop("_k", "_o")
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("m") - 1) / size)
    d = d.withColumn("frame", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("frame") * size - F.col("at"))
    cut = F.slice("x", (begin + 1).cast("int"), F.least(F.col("m") - begin, (F.col("frame") + 1) * size - F.col("at") - begin).cast("int"))
    g = d.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct(F.col("at"), cut.alias("x")))).alias("p"))
    return g.select(key, "frame", F.flatten(F.transform("p", lambda p: p["x"])).alias("samples")).where(F.size("samples") == size)
