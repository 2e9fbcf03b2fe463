"""Interval algebra over tables keyed by recording (IV-xx, PR-xx, JN-xx).

Range joins always carry the recording as an equi key and, inside it, time buckets: each side is exploded over the buckets it
covers, and a pair is kept only in the first bucket that both share, so nothing is repeated and no join is a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round6
from ..functions.sorted_rows import arrow_schema

BUCKET = 120.0
PAIRS = 1 << 18  # pairs of rows and segments that are compared at a time


def overlap_seconds(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """IV-02: length of the intersection, 0 where there is none."""
    return F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))


def range_join(left: DataFrame, right: DataFrame, key: str = "recording_id", bucket: float = BUCKET, points: bool = False) -> DataFrame:
    """JN-01/02: pairs of rows with the same key whose intervals (start_s, end_s) overlap strictly; right columns get ``r_``.

    Intervals without length are left out, or with ``points`` kept: each of a pair ends after the other starts, so such a one meets what
    holds it inside, but never its like.
    """
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))

    def cells(df: DataFrame, p: str) -> DataFrame:
        first, last = (F.floor(F.col(f"{p}{c}") / bucket) for c in ("start_s", "end_s"))
        real = F.lit(True) if points else F.col(f"{p}end_s") > F.col(f"{p}start_s")
        return df.where(real).withColumn(f"{p}_cell", F.explode(F.sequence(F.least(first, last), F.greatest(first, last)) if points else F.sequence(first, last)))

    a, b = cells(left, ""), cells(right, "r_")
    shared = F.floor(F.greatest(F.col("start_s"), F.col("r_start_s")) / bucket)
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_cell") == F.col("r__cell"))
    pairs = a.join(b, on).where((F.col("end_s") > F.col("r_start_s")) & (F.col("start_s") < F.col("r_end_s")) & (F.col("_cell") == shared))
    return pairs.drop("_cell", "r__cell", f"r_{key}")


def islands(df: DataFrame, tolerance: float, key: str = "recording_id") -> DataFrame:
    """Adds ``island``: intervals whose start is within ``tolerance`` of what was covered before belong together."""
    w = Window.partitionBy(key).orderBy("start_s", "end_s")
    covered = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_s") <= covered + tolerance, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def merge(df: DataFrame, tolerance: float = 0.02, key: str | list[str] = "recording_id", span: float = 600.0) -> DataFrame:
    """IV-07: (key, start_s, end_s) of the merged intervals.

    First within stretches of ``span`` seconds, by where intervals start, then what that leaves: a long recording's intervals are sorted in
    many tasks, and the window over all of it sees merged ones only. What is merged early would be merged anyway.
    """
    keys = [key] if isinstance(key, str) else key
    d = df.select(*keys, "start_s", "end_s").withColumn("_part", F.floor(F.col("start_s") / span))
    for by in ([*keys, "_part"], keys):
        w = Window.partitionBy(*by).orderBy("start_s", "end_s")
        covered = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("_fresh", F.when(F.col("start_s") <= covered + tolerance, 0).otherwise(1))
        d = d.withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.groupBy(*by, "_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_run")
    return d


def overlap_pairs(tracks: DataFrame, least: float = 0.08) -> DataFrame:
    """Pairs of tracks of different speakers that share at least ``least`` seconds: (recording_id, a, b, start_s, end_s)."""
    pairs = range_join(tracks, tracks).where((F.col("seg_id") < F.col("r_seg_id")) & (F.col("speaker") != F.col("r_speaker")))
    pairs = pairs.select("recording_id", F.col("seg_id").alias("a"), F.col("r_seg_id").alias("b"), F.greatest("start_s", "r_start_s").alias("start_s"), F.least("end_s", "r_end_s").alias("end_s"))
    return pairs.where(F.col("end_s") - F.col("start_s") >= least)


def detect_overlaps(tracks: DataFrame, least: float = 0.08, tolerance: float = 0.02, span: float = 600.0) -> DataFrame:
    """IV-06: (recording_id, start_s, end_s) where tracks of different speakers overlap for ``least`` seconds or more, merged.

    No pairs are made. Two tracks share ``least`` seconds just when they meet with that much cut off their ends, so a sweep counts the
    speakers of such shortened tracks, and each stretch with two or more is as much longer again. Counts are taken within stretches
    of ``span`` seconds, from what is open at their start; over a whole recording only the edges of overlaps are put in order.
    """
    own = tracks.where("speaker IS NOT NULL").where(F.col("end_s") - F.col("start_s") >= least)
    spoken = merge(own, -least, ["recording_id", "speaker"], span)
    begin = spoken.select("recording_id", F.col("start_s").alias("at"), F.lit(1).alias("step"), F.lit(None).cast("double").alias("end_s"))
    end = spoken.select("recording_id", (F.col("end_s") - least).alias("at"), F.lit(-1).alias("step"), "end_s")
    events = begin.unionByName(end).withColumn("part", F.floor(F.col("at") / span))
    before = Window.partitionBy("recording_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    open_ = events.groupBy("recording_id", "part").agg(F.sum("step").alias("net")).withColumn("open", F.coalesce(F.sum("net").over(before), F.lit(0))).drop("net")
    upto = Window.partitionBy("recording_id", "part").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    d = events.join(open_, ["recording_id", "part"]).withColumn("depth", F.col("open") + F.sum("step").over(upto))
    edges = d.where(((F.col("step") == 1) & (F.col("depth") == 2)) | ((F.col("step") == -1) & (F.col("depth") == 1)))
    following = F.lead("end_s").over(Window.partitionBy("recording_id").orderBy("at", F.desc("step")))
    found = edges.withColumn("end_s", following).where("step = 1").select("recording_id", F.col("at").alias("start_s"), "end_s")
    return merge(found, tolerance, span=span)


def _last_part(start: Column, end: Column, most: float, step: float) -> Column:
    return F.when(end - start <= most + 1e-6, 0).otherwise(F.ceil((end - start - most - 1e-6) / step)).cast("int")


def split_count(start: Column, end: Column, most: float = 6.0, overlap: float = 0.18) -> Column:
    """How many pieces ``strict_split`` makes of a segment."""
    k = _last_part(start, end, most, most - min(overlap, most / 3))
    return F.when((end > start) & ((k > 0) | (end - start >= 0.05)), k.cast("long") + 1).otherwise(F.lit(0).cast("long"))


def strict_split(segs: DataFrame, most: float = 6.0, overlap: float = 0.18) -> DataFrame:
    """IV-03 in closed form: pieces of at most ``most`` seconds that overlap a little, the last at least 0.8 s long.

    Adds part, start_s and end_s replaced; ``most`` under 0.8 s has no solution for some lengths and is refused.
    """
    if most < 0.8:
        raise ValueError("pieces must be 0.8 s or longer")
    ov = min(overlap, most / 3)
    step, tail = most - ov, 0.8
    segs = segs.where("end_s > start_s")
    start, end = F.col("start_s"), F.col("end_s")
    df = segs.withColumn("_k", _last_part(start, end, most, step)).withColumn("_tail", (F.col("_k") > 0) & (end - start - F.col("_k") * step < tail))
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    last, part = F.col("part") == F.col("_k"), F.col("part")
    s = F.when(last & F.col("_tail"), end - tail).otherwise(start + part * step)
    e = F.when(last, end).when(F.col("_tail") & (part == F.col("_k") - 1), end - tail + ov).otherwise(start + part * step + most)
    df = df.withColumn("_s", s).withColumn("_e", e).where(~last | (F.col("_e") - F.col("_s") >= 0.05))
    return df.withColumns({"start_s": round6(F.col("_s")), "end_s": round6(F.col("_e"))}).drop("_k", "_tail", "_s", "_e")


def halo_chunks(durations: DataFrame, chunk: float = 120.0, context: float = 5.0) -> DataFrame:
    """IV-04: (recording_id, idx, start_s, end_s, core_start, core_end) of recordings (recording_id, duration)."""
    chunk = max(10.0, chunk)
    context = max(0.0, min(chunk / 4, context))
    n = F.ceil(F.col("duration") / chunk).cast("int")
    df = durations.where("duration > 0").withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1)))
    a = F.col("idx") * chunk
    b = F.least(F.col("duration"), a + chunk)
    return df.select(
        "recording_id", "idx", round6(F.greatest(F.lit(0.0), a - context)).alias("start_s"), round6(F.least(F.col("duration"), b + context)).alias("end_s"),
        round6(a).alias("core_start"), round6(b).alias("core_end"),
    )


def halo_clip(tracks: DataFrame, chunks: DataFrame, least: float = 0.01) -> DataFrame:
    """IV-05: tracks cut to the cores of the chunks they touch, speakers named per chunk."""
    cores = chunks.select("recording_id", "idx", F.col("core_start").alias("start_s"), F.col("core_end").alias("end_s"))
    j = range_join(tracks, cores)
    out = j.select(
        "recording_id", "seg_id", F.col("r_idx").alias("idx"), F.concat_ws(":", "r_idx", "speaker").alias("speaker"),
        F.greatest("start_s", "r_start_s").alias("start_s"), F.least("end_s", "r_end_s").alias("end_s"),
    )
    return out.where(F.col("end_s") - F.col("start_s") >= least)


def separation_windows(intervals: DataFrame, durations: DataFrame, gap: float = 0.35, core: float = 8.0, context: float = 1.0, least: float = 0.12) -> DataFrame:
    """IV-08/09: windows (recording_id, idx, start_s, end_s, overlap_start, overlap_end, pieces) that tile groups of near intervals."""
    total = F.col("duration")
    iv = intervals.join(durations, "recording_id").select(
        "recording_id", "duration", *(F.greatest(F.lit(0.0), F.least(total, F.col(c))).alias(c) for c in ("start_s", "end_s"))
    ).where(F.col("end_s") - F.col("start_s") >= least)
    iv = islands(iv, gap)
    group = iv.groupBy("recording_id", "island").agg(
        F.min("start_s").alias("g0"), F.max("end_s").alias("g1"), F.max("duration").alias("duration"), F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("all")
    )
    tiles = F.ceil((F.col("g1") - F.col("g0") - 1e-6) / core).cast("int")
    t = group.where("g1 - g0 > 1e-6").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    t = t.withColumn("c0", F.col("g0") + F.col("tile") * core).withColumn("c1", F.least(F.col("g1"), F.col("c0") + core))
    cut = F.transform("all", lambda x: F.struct(F.greatest(x["start_s"], F.col("c0")).alias("start_s"), F.least(x["end_s"], F.col("c1")).alias("end_s")))
    t = t.withColumn("pieces", F.filter(cut, lambda x: x["end_s"] - x["start_s"] >= least)).where(F.size("pieces") > 0)
    return t.select(
        "recording_id", (F.row_number().over(Window.partitionBy("recording_id").orderBy("c0")) - 1).cast("long").alias("idx"),
        round6(F.greatest(F.lit(0.0), F.col("c0") - context)).alias("start_s"), round6(F.least(F.col("duration"), F.col("c1") + context)).alias("end_s"),
        round6(F.col("c0")).alias("overlap_start"), round6(F.col("c1")).alias("overlap_end"),
        F.transform("pieces", lambda x: F.struct(round6(x["start_s"]).alias("start_s"), round6(x["end_s"]).alias("end_s"))).alias("pieces"),
    )


def subtract(tracks: DataFrame, holes: DataFrame, least: float = 0.6) -> DataFrame:
    """Pieces of tracks outside the (disjoint) holes, ``least`` seconds or longer; columns of the tracks are kept, and so are equal rows."""
    names = [c for c in tracks.columns if c not in ("start_s", "end_s")]
    hole = F.struct(F.col("r_start_s").alias("a"), F.col("r_end_s").alias("b"))
    met = range_join(tracks, holes).select(*names, "start_s", "end_s", hole.alias("h"), F.lit(0).alias("n"))
    own = tracks.select(*names, "start_s", "end_s", F.lit(None).cast("struct<a:double,b:double>").alias("h"), F.lit(1).alias("n"))
    # a track's holes are sorted within its own row; between them lie its pieces. Equal rows share them and are repeated after
    cut = met.unionByName(own).groupBy(*names, "start_s", "end_s").agg(F.sort_array(F.collect_set("h")).alias("h"), F.sum("n").alias("n"))
    h = F.col("h")
    edge = lambda i, f, other: F.coalesce(F.get(h, i)[f], other)
    pieces = F.transform(F.sequence(F.lit(0), F.size(h)), lambda i: F.struct(F.when(i == 0, F.col("start_s")).otherwise(edge(i - 1, "b", F.col("start_s"))).alias("s"), edge(i, "a", F.col("end_s")).alias("e")))
    out = cut.where("end_s > start_s OR n > 0").select(*names, "n", F.inline(pieces)).withColumnRenamed("s", "start_s").withColumnRenamed("e", "end_s")
    out = out.where(F.col("end_s") - F.col("start_s") >= least)
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def anchors(windows: DataFrame, tracks: DataFrame, holes: DataFrame, radius: float = 6.0, least: float = 0.6, most: float = 3.0, top: int = 2) -> DataFrame:
    """IV-10 and WN-06: per window and active speaker, the ``top`` clean pieces nearest to the window, longer first, cut to ``most`` s."""
    core = windows.select("recording_id", "idx", F.col("overlap_start").alias("start_s"), F.col("overlap_end").alias("end_s"))
    active = range_join(core, tracks).select("recording_id", "idx", F.col("r_speaker").alias("speaker")).distinct()
    wide = windows.select("recording_id", "idx", F.col("start_s").alias("w0"), F.col("end_s").alias("w1"), (F.col("start_s") - radius - 1e-6).alias("start_s"), (F.col("end_s") + radius + 1e-6).alias("end_s"))
    # a track is near if the whole of it reaches the radius; its pieces count wherever they are
    near = range_join(wide, tracks).where((F.col("r_end_s") >= F.col("w0") - radius) & (F.col("r_start_s") <= F.col("w1") + radius))
    near = near.select("recording_id", "idx", "w0", "w1", F.col("r_seg_id").alias("seg_id"), F.col("r_speaker").alias("speaker")).join(active, ["recording_id", "idx", "speaker"], "left_semi")
    pieces = subtract(tracks, holes, least).select("recording_id", "seg_id", "start_s", "end_s")
    c = near.join(pieces, ["recording_id", "seg_id"])
    away = F.least(F.abs(F.col("end_s") - F.col("w0")), F.abs(F.col("start_s") - F.col("w1")))
    order = Window.partitionBy("recording_id", "idx", "speaker").orderBy(round6(away), round6(F.col("start_s") - F.col("end_s")), "seg_id", "start_s")
    c = c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    length = F.least(F.lit(most), F.col("end_s") - F.col("start_s"))
    return c.select("recording_id", "idx", "speaker", "rank", round6(F.col("start_s")).alias("start_s"), round6(F.col("start_s") + length).alias("end_s"))


def best_overlap(rows: DataFrame, segs: DataFrame, row_key: str, seg_key: str) -> DataFrame:
    """JN-05: for each row its segment with the longest overlap, then the nearest midpoint, then the smallest key: (recording_id, row_key,
    r_seg_key, overlap_s).

    Of equal segments the one with the smallest key counts. Rows and segments of a cell come to a task one after the other, segments by
    key, and a row's pairs are compared there in arrays, so pairs are neither sorted nor shuffled, only a row's best of each cell.
    """
    name = f"r_{seg_key}"
    one = segs.groupBy("recording_id", "start_s", "end_s").agg(F.min(seg_key).alias(name))
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *one.schema]}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    # lengths of zero count, as in range_join: each of a pair ends after the other starts
    first, last = F.floor(F.least("start_s", "end_s") / BUCKET), F.floor(F.greatest("start_s", "end_s") / BUCKET)
    cell = F.explode(F.sequence(first, last)).alias("_cell")
    both = one.select("recording_id", cell, F.lit(0).alias("_side"), none(row_key), name, "start_s", "end_s").unionByName(
        rows.select("recording_id", cell, F.lit(1).alias("_side"), row_key, none(name), "start_s", "end_s")
    )
    both = both.where("recording_id IS NOT NULL").repartition("recording_id", "_cell").sortWithinPartitions("recording_id", "_cell", "_side", name)
    out = f"recording_id {kinds['recording_id']}, {row_key} {kinds[row_key]}, {name} {kinds[name]}, overlap_s double, _far double"
    schema = arrow_schema(out)
    best = both.mapInArrow(lambda batches: _best_in_cells(batches, schema), out)
    w = Window.partitionBy("recording_id", row_key).orderBy(F.desc("overlap_s"), "_far", name)
    return best.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_far")


def _best_in_cells(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a cell's segments (side 0), then its rows (side 1), as the rows' best; a cell's segments are held, and a part of its rows."""
    at, held = None, []  # the cell, and batches of its segments
    for batch in batches:
        n = batch.num_rows
        recording, cell, side = batch.columns[:3]
        change = pc.or_(pc.or_(pc.not_equal(recording[1:], recording[:-1]), pc.not_equal(cell[1:], cell[:-1])), pc.not_equal(side[1:], side[:-1]))
        edges = [0, *(np.flatnonzero(np.asarray(change)) + 1).tolist(), n] if n else [0]
        for a, b in pairwise(edges):
            part = batch.slice(a, b - a)
            here = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
            if here != at:
                at, held = here, []
            if part.column(2)[0].as_py() == 0:
                held.append(part)
            elif held:
                held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if len(held) > 1 else held
                most = max(1, PAIRS // held[0].num_rows)
                for c in range(0, part.num_rows, most):
                    yield _best_of(part.slice(c, most), held[0], schema)


def _best_of(rows: pa.RecordBatch, segs: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    micro = lambda x: np.floor(x * 1e6 + 0.5) / 1e6
    (s, e), (rs, re) = ([np.asarray(d.column(i), float) for i in (5, 6)] for d in (rows, segs))
    s, e = s[:, None], e[:, None]
    meet = (e > rs) & (s < re)
    hit = np.where(meet, micro(np.maximum(0.0, np.minimum(e, re) - np.maximum(s, rs))), -1.0)
    top = hit.max(axis=1)
    far = np.where(meet & (hit == top[:, None]), micro(np.abs(s + e - rs - re) / 2), np.inf)
    pick = far.argmin(axis=1)  # of equal ones the first, which has the smallest key
    some = np.flatnonzero(top >= 0)
    took = pick[some]
    columns = [rows.column(0).take(pa.array(some)), rows.column(3).take(pa.array(some)), segs.column(4).take(pa.array(took)), pa.array(top[some]), pa.array(far[some, took])]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def boundary_iou(rows: DataFrame, segs: DataFrame, row_key: str) -> DataFrame:
    """IV-12: per row the best ratio of the intersection to the hull over all segments, 0 without any."""
    j = range_join(rows, segs)
    hit = F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s")
    hull = F.greatest("end_s", "r_end_s") - F.least("start_s", "r_start_s")
    best = j.groupBy("recording_id", row_key).agg(F.max(hit / hull).alias("iou"))
    return rows.select("recording_id", row_key).join(best, ["recording_id", row_key], "left").withColumn("iou", round6(F.coalesce("iou", F.lit(0.0))))


def clean_utterances(utts: DataFrame, guard: float = 0.12, least: float = 0.8, most: float = 6.0, chars: Column | None = None, least_chars: int = 3) -> DataFrame:
    """PR-07 and JN-04: utterances that overlap no other speaker, trimmed at both ends; ``chars`` counts normalised characters."""
    utts = utts.where("end_s > start_s AND trim(speaker) != ''")
    length = F.col("end_s") - F.col("start_s") - 2 * guard
    fit = utts.where((round6(length) >= least) & (round6(length) <= most) & (chars >= least_chars))
    hit = range_join(fit, utts).where("speaker != r_speaker").select("recording_id", "turn").distinct()
    return fit.join(hit, ["recording_id", "turn"], "left_anti").withColumns({"start_s": round6(F.col("start_s") + guard), "end_s": round6(F.col("end_s") - guard)})


def select_range(segs: DataFrame, start: float, end: float) -> DataFrame:
    """PR-02: segments that overlap the selection; a missing end makes a point, kept only strictly inside."""
    return segs.where((F.coalesce("end_s", "start_s") > start) & (F.col("start_s") < end))


def shift(segs: DataFrame, by: float) -> DataFrame:
    """IV-11."""
    return segs.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + by) for c in ("start_s", "end_s")})


def decode_window(start: Column, duration: Column, context: Column) -> dict[str, Column]:
    """CF-05/06: bounds of a trial range, and the wider window to decode with the selection's place in it."""
    from ..functions.scalars import clamp

    s = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))
    d, c = clamp(duration, 10.0, 180.0, 60.0), clamp(context, 0.0, 3.0, 1.5)
    at = F.greatest(F.lit(0.0), s - c)
    return {"decode_start": at, "decode_duration": s - at + d + c, "selection_start": s - at, "selection_end": s - at + d}


def sample_index(sec: Column, total: Column | None = None, rate: int = 16000) -> Column:
    """IV-13: the sample at a time, rounded half up, within 0 .. total."""
    at = F.greatest(F.lit(0), F.floor(sec * rate + 0.5))
    return at if total is None else F.least(at, total)


def local_parts(windows: DataFrame, speech: DataFrame, most: float = 4.0, around: float = 0.15, least: float = 0.04, alone: float = 0.25) -> DataFrame:
    """IV-14: (recording_id, idx, part_no, start_s, end_s): pieces of a window's speech, in its own seconds, that touch its overlap.

    windows (recording_id, idx, start_s, end_s, overlap_start, overlap_end); speech (recording_id, idx, seg_id, start_s, end_s), local already.
    A window without any gets the overlap itself, if that is ``alone`` seconds long.
    """
    key = ["recording_id", "idx"]
    local = windows.select(*key, F.greatest(F.lit(0.0), F.col("overlap_start") - F.col("start_s") - around).alias("o0"), F.least(F.col("end_s") - F.col("start_s"), F.col("overlap_end") - F.col("start_s") + around).alias("o1"))
    cut = strict_split(speech.select(*key, "seg_id", "start_s", "end_s"), most).join(local, key)
    cut = cut.where(round6(F.least("end_s", "o1") - F.greatest("start_s", "o0")) >= least)
    rest = local.join(cut.select(*key).distinct(), key, "left_anti").where(round6(F.col("o1") - F.col("o0")) >= alone)
    rest = strict_split(rest.select(*key, F.lit(None).cast("long").alias("seg_id"), F.col("o0").alias("start_s"), F.col("o1").alias("end_s")), most)
    both = cut.select(*key, "seg_id", "part", "start_s", "end_s").unionByName(rest.select(*key, "seg_id", "part", "start_s", "end_s"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("start_s", "seg_id", "part"))
    return both.select(*key, place.alias("part_no"), "start_s", "end_s")


#: How a boundary is tried (fixed values): seconds added to start and end.
BOUNDARIES = [(0.0, 0.0), (-0.2, 0.0), (0.0, 0.2), (-0.2, 0.2), (0.1, -0.1)]


def boundary_variants(rows: DataFrame, key: list[str], duration: str = "duration", margin: float = 0.3, least: float = 0.1) -> DataFrame:
    """IV-17: (key, variant, start_s, end_s): a row's range (``least`` seconds at least) widened and narrowed within what is decoded around it;
    too short ones go, and of equal ones (to a millisecond) all but the first."""
    a = F.greatest(F.lit(0.0), F.col("start_s"))
    d = rows.select(*key, F.col(duration).alias("_d"), a.alias("a"), F.greatest(a + 0.1, F.col("end_s")).alias("b"))
    tried = F.array(*(F.struct(F.lit(i).alias("variant"), F.lit(x).alias("da"), F.lit(y).alias("db")) for i, (x, y) in enumerate(BOUNDARIES)))
    d = d.select(*key, "_d", "a", "b", F.inline(tried))
    from_, to = F.greatest(F.lit(0.0), F.col("a") - margin), F.least(F.col("_d"), F.col("b") + margin)
    d = d.select(*key, "variant", F.greatest(from_, F.col("a") + F.col("da")).alias("start_s"), F.least(to, F.col("b") + F.col("db")).alias("end_s"))
    d = d.where(round6(F.col("end_s") - F.col("start_s")) >= least)
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    n = F.row_number().over(Window.partitionBy(*key, ms("start_s"), ms("end_s")).orderBy("variant"))
    return d.withColumn("_n", n).where("_n = 1").select(*key, "variant", round6(F.col("start_s")).alias("start_s"), round6(F.col("end_s")).alias("end_s"))


def guard(start: Column, end: Column, least: float) -> Column:
    """PR-11: whether a range is too short to work on: under 0.05 s a selection, under 0.1 s a separation window."""
    return F.coalesce(round6(end - start) < least, F.lit(True))


def work_totals(segs: DataFrame, key: str = "recording_id") -> DataFrame:
    """AG-08: items and seconds of work per key; reversed ranges count no seconds."""
    return segs.groupBy(key).agg(F.count("*").alias("items"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))), 3).alias("seconds"))


def range_bounds(segs: DataFrame, key: str = "recording_id", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """AG-09: first start and last end per key, or the explicit bounds where given."""
    none = F.lit(None).cast("double")
    g = segs.groupBy(key).agg(F.min("start_s").alias("_a"), F.max("end_s").alias("_b"))
    return g.select(key, F.coalesce(none if start is None else start, F.col("_a")).alias("start_s"), F.coalesce(none if end is None else end, F.col("_b")).alias("end_s"))
