"""Operator 11, periodic run detection: maximal stretches of words that repeat with a smallest period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length >= max(least, 2 q), which
no neighbouring word extends keeping period q. Words are maximal runs of anything but space and U+0009..U+000D; null and empty
texts have none, and no runs. Texts are whole, and every row is judged by itself, so copies and rows without a doc_id make no difference.

Method (Karp-Miller-Rosenberg): names of all windows of 1, 2, 4, .. words, equal where the windows are equal, each level from pairs of the
one below. The longest common extension of two places then takes one comparison a level, in descending levels. For a period p, a
stretch of 2 p words holds two neighbouring multiples of p that match over p words around them; of these about n ln n places a text, those
where neither side's half matches by name go at once, and the others are extended to both sides exactly. Neither hashes nor suffix
arrays are used: names come from a dictionary of the words themselves. Many short texts share the NumPy steps, a word of its own between
any two of them. Memory is 4 n log2(n) bytes for the names of the longest text, and fixed otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let
from .shingles import slices

LEAST = 12
_CHUNK = 1 << 19  # places compared at a time
_PIECE = 4 << 20  # bytes of text named at a time, one text at least

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _classes(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of n windows: of those that begin at ``at`` and have equal values there, one below n; a name of its own for any other."""
    out = np.arange(n, 2 * n, dtype=np.int32)
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    again = count[which] > 1
    out[at[again]] = which[again]
    return out


def name_levels(ids: np.ndarray, levels: int) -> np.ndarray:
    """names[k, i] == names[k, j] exactly where the 2^k words from i equal those from j. Only windows whose halves both recur are compared."""
    n = len(ids)
    out = np.empty((levels, n), np.int32)
    out[0] = _classes(ids, np.arange(n), n)
    for k in range(1, levels):
        half, below = 1 << (k - 1), out[k - 1]
        at = np.flatnonzero((below[: max(0, n - half)] < n) & (below[half:] < n))
        out[k] = _classes(below[at].astype(np.int64) * (2 * n) + below[at + half], at, n)
    return out


def _extent(names: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on equal those from j on (back: words before i and j), by descending levels."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step = far + (1 << k) if back else far
        a, b = (np.maximum(i - step, 0), np.maximum(j - step, 0)) if back else (i + step, j + step)
        same = (names[k, a] == names[k, b]) & (a != b)
        far[same] += 1 << k
    return far


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run for each stretch, with its smallest period, by start, then period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(ids: np.ndarray, begin: np.ndarray, count: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts of ``count`` words from ``begin`` on; ids has a separator of its own before, between and after them."""
    none = np.empty(0, np.int64)
    long = count >= least
    begin, count = begin[long].astype(np.int64), count[long].astype(np.int64)
    if not len(count):
        return none, none, none
    names = name_levels(ids, int(count.max()).bit_length())
    # every text with every period up to half its length, and how many neighbouring multiples of it the text holds
    most = count // 2
    which = np.repeat(np.arange(len(count)), most)
    period = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (count[which] - 1) // period
    stop = np.cumsum(places)
    # a stretch of at least max(least, 2 p) words matches itself p words on over need words, at least half of them on one side of the place
    need = np.maximum(period, least - period)
    level = np.minimum(np.frexp((need + 1) // 2)[1] - 1, len(names) - 1)
    found = (none, none, none)
    a = 0
    while a < len(which):
        base = int(stop[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(stop, base + _CHUNK, "right")))
        of = np.repeat(np.arange(a, b), places[a:b])
        p, k = period[of], level[of]
        i = begin[which[of]] + (np.arange(len(of)) - (stop[of] - places[of] - base)) * p
        left = np.maximum(i - (1 << k), 0)
        hit = (names[k, i] == names[k, i + p]) | (names[k, left] == names[k, left + p])
        i, p = i[hit], p[hit]
        if len(i):
            ahead, behind = _extent(names, i, i + p, False), _extent(names, i, i + p, True)
            ok = ahead + behind + p >= np.maximum(least, 2 * p)
            new = ((i - behind)[ok], (i + ahead + p)[ok], p[ok])
            found = _distinct(*(np.concatenate(x) for x in zip(found, new, strict=True)))
        a = b
    return found


def _piece(text: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text of an Arrow array."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.string()))
    flat, edge = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "")
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(real.to_numpy(zero_copy_only=False))])
    first = sums[edge - edge[0]]  # of each text, among the words; and the end
    word = flat.filter(real)
    n, count = len(word), np.diff(first)
    begin = first[:-1] + 1 + np.arange(len(count))  # with separators
    place = np.arange(n) + np.repeat(1 + np.arange(len(count)), count)
    coded = word.dictionary_encode()
    ids = np.arange(len(coded.dictionary), len(coded.dictionary) + n + len(count) + 1, dtype=np.int64)
    ids[place] = coded.indices.to_numpy(zero_copy_only=False)
    start, end, period = runs_of(ids, begin, count, least)
    drop = np.zeros(len(ids) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    keep = np.cumsum(drop)[place] == 0
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[first]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), word.filter(pa.array(keep))), " ")
    doc = np.searchsorted(begin, start, "right") - 1
    found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - begin[doc], end - start, period)], fields=list(_RUN))
    edges = np.searchsorted(doc, np.arange(len(count) + 1))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found), collapsed


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """All columns but the text, its runs by start, then period, and ``collapsed``: the words that stand in no run after its first period."""
    keep = [c for c in docs.columns if c not in (text, "runs", "collapsed")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _PIECE):
            runs, collapsed = _piece(batch.column(text), least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), runs, collapsed], names=[*keep, "runs", "collapsed"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"runs {RUNS}", "collapsed string"])
    return docs.select(*(F.col(f"`{c}`") for c in [*keep, text])).mapInArrow(work, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the numbers (crc32 of the decimal number divisible by 10) one whose words repeat from a place on with a period,
    both from the rest of that value. Rows without a number are left alone."""
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]) + 1).cast("int"))), " ")))

    hit = F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0
    return F.when(hit, F.coalesce(let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), repeat), text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period; nulls without any), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
