"""Embeddings: centroids, assignment by references, stem pairs, agglomerative clustering (VE-xx)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, l2_normalize, let, round6
from ..sources.shared import written


def centroids(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """VE-03/07: (key, centroid): the normalised mean of normalised vectors, by dimension, so nothing is gathered per key."""
    d = vectors.where(F.size(vec) > 0).select(key, F.posexplode(l2_normalize(F.col(vec))).alias("i", "x"))
    m = d.groupBy(key, "i").agg(F.avg("x").alias("x")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    return m.select(key, l2_normalize(F.transform("c", lambda s: s["x"])).alias("centroid"))


MOST = 1024  # centroids that travel to all tasks in one array


def _tables(cents: DataFrame, key: str) -> list[DataFrame]:
    """The centroids as one-row arrays of at most MOST, by their key's hash; one where there are few."""
    parts = max(1, -(-cents.count() // (MOST // 2)))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    pack = lambda df: df.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("c")))).alias("cs")).withColumn("_j", F.lit(1))
    return [pack(cents if parts == 1 else cents.where(part == i)) for i in range(parts)]


def assign(vectors: DataFrame, cents: DataFrame, key: str, threshold: float | None = None, vec: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """VE-02/04: the nearest centroid by cosine distance, the smaller key at a tie, -1 beyond the threshold.

    With ``by`` (such as the recording) a vector meets the centroids of its own group, in a join on it. Without, all centroids go to
    all tasks in arrays of at most MOST, one after the other if there are more, and each vector is compared within its row.
    """
    v = vectors.withColumn("_v", l2_normalize(F.col(vec))).withColumn("_b", F.lit(None).cast("struct<d:double,k:" + dict(cents.dtypes)[key] + ">"))
    nearest = F.array_min(F.transform("cs", lambda x: F.struct(F.round(1 - dot(F.col("_v"), x["c"]), 9).alias("d"), x["k"].alias("k"))))
    if by:
        table = cents.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("c")))).alias("cs"))
        v = v.join(table, by, "left").withColumn("_b", nearest).drop("cs")
    else:
        for table in _tables(cents, key):
            v = v.withColumn("_j", F.lit(1)).join(F.broadcast(table), "_j", "left").drop("_j")
            v = v.withColumn("_b", F.array_min(F.filter(F.array("_b", nearest), lambda x: x.isNotNull()))).drop("cs")
    found = F.coalesce(F.col("_b.k"), F.lit(-1))
    if threshold is not None:
        found = F.when(F.col("_b.d") > threshold, -1).otherwise(found)
    return v.withColumn("assigned", found.cast("int")).withColumn("distance", round6(F.col("_b.d"))).drop("_v", "_b")


def fill_cache(wanted: DataFrame, cache: DataFrame, key: list[str], compute) -> DataFrame:
    """VE-10, CN-18: what the cache has, and what it lacks computed: only rows of ``wanted`` without a cached one go through ``compute``."""
    have = cache.join(wanted.select(*key).distinct(), key, "left_semi")
    return have.unionByName(compute(wanted.join(cache.select(*key).distinct(), key, "left_anti")).select(*cache.columns))


def reassign(assigned: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """VE-05: references keep their own speaker. ``pins`` (key, pin)."""
    return assigned.join(pins, key, "left").withColumn("assigned", F.coalesce("pin", "assigned")).drop("pin")


def stem_pairs(pairs: DataFrame, cents: DataFrame, key: str, limit: float = 0.75, by: str | None = None) -> DataFrame:
    """VE-08: for two stems (id, e0, e1) the best ordered pair of distinct speakers, with a confidence for each.

    A pair needs all speakers of one conversation side by side, so these are one array, and more than MOST of them an error. ``by`` names the
    conversation in both tables; without it all rows are of one.
    """
    cents = written(cents.select(F.col(key).alias("k"), F.col("centroid").alias("c"), (F.lit(1) if by is None else F.col(by)).alias("_j")), "centroids")  # counted, then used
    groups = cents.groupBy("_j")
    if (groups.count().agg(F.max("count")).first()[0] or 0) > MOST:
        raise ValueError(f"more than {MOST} speakers in one conversation; name the conversations with by")
    table = groups.agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("cs"))
    table = F.broadcast(table) if by is None else table  # one row, or one for each conversation
    p = pairs.withColumn("_j", F.lit(1) if by is None else F.col(by)).join(table, "_j").drop("_j")

    # The two best pairs are among the three nearest speakers of each stem: whoever is farther has two nearer ones other than the pair's second
    # speaker. What is used more than once is bound by let, so each distance is computed once for a row.
    def near(e: str) -> Column:
        far = lambda v: F.transform("cs", lambda x: F.struct(F.round(1 - dot(v, x["c"]), 9).alias("d"), x["k"].alias("k")))
        return let(l2_normalize(F.col(e)), lambda v: F.slice(F.sort_array(far(v)), 1, 3))

    pair = lambda a, b: F.struct(F.round(a["d"] + b["d"], 9).alias("s"), a["k"].alias("k0"), b["k"].alias("k1"), a["d"].alias("d0"), b["d"].alias("d1"))
    both = lambda t0, t1: F.flatten(F.transform(t0, lambda a: F.transform(F.filter(t1, lambda b: b["k"] != a["k"]), lambda b: pair(a, b))))
    best = let(near("e0"), lambda t0: let(near("e1"), lambda t1: F.slice(F.sort_array(both(t0, t1)), 1, 2)))

    def told(two: Column) -> Column:
        b = F.get(two, F.lit(0))
        margin = F.coalesce(F.try_element_at(two, F.lit(2))["s"] - b["s"], F.lit(0.0))
        sure = lambda d: round6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d)) * F.least(F.lit(1.0), 0.5 + margin * 4))
        row = F.struct(b["k0"].alias("speaker0"), b["k1"].alias("speaker1"), sure(b["d0"]).alias("confidence0"), sure(b["d1"]).alias("confidence1"))
        return F.when((b["d0"] <= limit) & (b["d1"] <= limit), F.array(row))

    return p.select("id", F.explode(let(best, told)).alias("r")).select("id", "r.*")  # a filter would have all of it computed twice


BLOCK = 1 << 22  # distances held at once


def average_linkage(vectors: np.ndarray, speakers: int = 0, threshold: float = 0.55) -> np.ndarray:
    """VE-06: labels of agglomerative clustering with size-weighted mean distances, numbered by their first member.

    Distances to a cluster are means over its members, so they follow from sums of vectors: no matrix of pairs is held, only the sums and, for
    each cluster, its nearest among those after it. A merge looks for the nearest pair in one row of numbers, and only clusters whose nearest
    was one of the two look again: about n steps of n. Distances are taken to 1e-12, so that equal ones are equal however they are added up.
    """
    n = len(vectors)
    if n == 0:
        return np.empty(0, np.int64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    sums = (vectors / np.where(norm == 0, 1, norm)).astype(np.float32).astype(np.float64)
    size, label, left, goal = np.ones(n), np.arange(n), n, min(speakers, n) if speakers > 0 else 1
    gone = np.zeros(n, bool)
    near, far = np.full(n, n - 1), np.full(n, np.inf)

    def row(k: int, first: int) -> np.ndarray:
        """Distances of cluster k to those from ``first`` on."""
        d = np.round(1 - sums[first:] @ sums[k] / (size[first:] * size[k]), 12)
        d[gone[first:]] = np.inf
        return d

    def look(k: int) -> None:
        if k + 1 < n:
            d = row(k, k + 1)
            at = int(np.argmin(d))
            near[k], far[k] = k + 1 + at, d[at]

    step = max(1, BLOCK // n)
    for a in range(0, n, step):
        d = np.round(1 - sums[a : a + step] @ sums[a:].T, 12)
        d[np.tril_indices(len(d), 0, d.shape[1])] = np.inf
        at = np.argmin(d, axis=1)
        least = d[np.arange(len(d)), at]
        found = np.isfinite(least)
        near[a : a + step][found], far[a : a + step][found] = a + at[found], least[found]
    while left > goal:
        i = int(np.argmin(far))
        j = int(near[i])
        if not np.isfinite(far[i]) or (speakers <= 0 and far[i] > threshold):
            break
        sums[i] += sums[j]
        size[i] += size[j]
        label[label == j] = i
        left -= 1
        gone[j], far[j] = True, np.inf
        again = np.flatnonzero(((near == i) | (near == j)) & np.isfinite(far))
        for k in {i, *again.tolist()}:
            look(k)
        d = np.round(1 - sums[:i] @ sums[i] / (size[:i] * size[i]), 12)
        closer = np.flatnonzero(~gone[:i] & ((d < far[:i]) | ((d == far[:i]) & (near[:i] > i))))
        near[closer], far[closer] = i, d[closer]
    return np.searchsorted(np.unique(label), label)


def cluster(vectors: DataFrame, key: str, order: str, speakers: int = 0, threshold: float = 0.55) -> DataFrame:
    """VE-06 per recording: (key, order, cluster)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        return pd.DataFrame({"k": pdf["k"], "o": pdf["o"], "cluster": average_linkage(np.stack(pdf["v"].to_list()), speakers, threshold)})

    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.col("embedding").alias("v"))
    return rows.groupBy("k").applyInPandas(run, "k long, o long, cluster int").select(F.col("k").alias(key), F.col("o").alias(order), "cluster")


def speaker_seeds(rows: DataFrame) -> DataFrame:
    """VE-09: numbers for correction speakers by first appearance (recording_id, correction_speaker_key, ord)."""
    first = rows.groupBy("recording_id", "correction_speaker_key").agg(F.min("ord").alias("first"))
    return first.withColumn("speaker", F.row_number().over(Window.partitionBy("recording_id").orderBy("first")) - 1)
