"""Corrections to transcripts: blocks of confirmed rows, and their application to recognised segments (CO-01, CO-03..05).

A block belongs to a recording and replaces its whole range, or row by row the segments that match its rows best. Applying is a
fold per recording over blocks in order, as a block sees what earlier ones have put in; a recording is its unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sorted_rows import arrow, arrow_schema, by_key, groups
from .settings import finite, valid_time
from .transcript import interpolate

#: When a row takes further segments besides the one it matches best (fixed values): least seconds in common with the row, and
#: the shared seconds and share of the shorter one from which two segments count as spoken at the same time.
SHARED, CROSSED, CROSSED_SHARE, EPS = 0.05, 0.05, 0.35, 1e-9


def create_blocks(rows: DataFrame) -> DataFrame:
    """CO-01: rows (recording_id, id, ord, text, speaker, start_s, end_s, source_start, source_end, operation, confirmed, range_start,
    range_end, replace_all) as resolved rows with their block's bounds.

    Blank and unconfirmed rows go, and blocks without rows with them. A block spans its rows' valid times, own and source; it reaches to the
    range's edge where its first or last row is untimed, and is the whole range for ``replace_all`` or if nothing else is valid.
    Untimed rows share the gaps by text weight (WN-03). Added: block_start, block_end, speaker_key; ``source_start``/``source_end`` of
    rows stay their own, the range is the block's source range.
    """
    key = ["recording_id", "id"]
    d = rows.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text != ''").where(F.coalesce("confirmed", F.lit(True)))
    own, source = valid_time(F.col("start_s"), F.col("end_s")), valid_time(F.col("source_start"), F.col("source_end"))
    d = d.withColumns({
        "operation": F.when(F.col("operation") == "insert", "insert").otherwise("replace"), "speaker": F.coalesce(F.col("speaker").cast("string"), F.lit("")),
        **{c: F.when(own | finite(F.col(c)).isNotNull(), F.col(c)) for c in ("start_s", "end_s")}, **{c: F.when(source, F.col(c)) for c in ("source_start", "source_end")},
    })
    least = F.least(F.when(own, F.col("start_s")), F.col("source_start"))
    most = F.greatest(F.when(own, F.col("end_s")), F.col("source_end"))
    g = d.groupBy(*key).agg(
        F.min(least).alias("a"), F.max(most).alias("b"), F.min_by(own, "ord").alias("first"), F.max_by(own, "ord").alias("last"),
        F.first("range_start").alias("r0"), F.first("range_end").alias("r1"), F.first(F.coalesce("replace_all", F.lit(False))).alias("all"),
    )
    a = F.when(F.col("all") | ~F.col("first"), F.col("r0")).otherwise(F.col("a"))
    b = F.when(F.col("all") | ~F.col("last"), F.col("r1")).otherwise(F.col("b"))
    good = valid_time(a, b)
    g = g.select(*key, F.when(good, a).otherwise(F.col("r0")).alias("block_start"), F.when(good, b).otherwise(F.col("r1")).alias("block_end"))
    d = d.join(g, key).withColumn("_block", F.struct(*key))
    out = interpolate(d, F.col("block_start"), F.col("block_end"), "_block").drop("_block")
    return out.withColumn("speaker_key", F.concat_ws(":", "id", F.when(F.col("speaker") == "", "speaker").otherwise(F.col("speaker"))))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The blocks of ``create_blocks``'s rows: recording_id, id, start_s, end_s, source_start, source_end, replace_all, n."""
    return rows.groupBy("recording_id", "id").agg(
        F.first("block_start").alias("start_s"), F.first("block_end").alias("end_s"), F.first("range_start").alias("source_start"), F.first("range_end").alias("source_end"),
        F.first(F.coalesce("replace_all", F.lit(False))).alias("replace_all"), F.count("*").alias("n"),
    )


def _shared(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Seconds that each of the intervals a shares with each of b."""
    return np.maximum(0.0, np.minimum(a1[:, None], b1) - np.maximum(a0[:, None], b0))


def taken(start: np.ndarray, end: np.ndarray, row_start: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """CO-04: which segments the rows of one block take the place of, row by row.

    A row takes the free segment that shares most with it, the nearest by its middle of equal ones. With it go the free segments that
    lie in the row by their middle, unless they cross one that already goes: those are someone else speaking at the same time.
    Only segments that meet the block's rows are looked at, so work and memory are the block's, not the recording's.
    """
    gone = np.zeros(len(start), bool)
    timed = np.isfinite(start) & np.isfinite(end) & (end > start)
    near = np.flatnonzero(timed & (end > row_start.min(initial=np.inf)) & (start < row_end.max(initial=-np.inf)))
    a, b = start[near], end[near]
    hit, middle, out = _shared(a, b, row_start, row_end), (a + b) / 2, np.zeros(len(near), bool)

    def crossing(i: int, chosen: list[int]) -> bool:
        both = _shared(a[[i]], b[[i]], a[chosen], b[chosen])[0]
        shorter = np.maximum(1e-3, np.minimum(b[i] - a[i], b[chosen] - a[chosen]))
        return bool(((both > CROSSED) & (both / shorter >= CROSSED_SHARE)).any())

    for k in range(len(row_start)):
        free = np.flatnonzero(~out)
        if not len(free) or hit[free, k].max() <= EPS:
            continue
        top = free[hit[free, k] >= hit[free, k].max() - EPS]
        best = int(top[np.argmin(np.abs(middle[top] - (row_start[k] + row_end[k]) / 2))])
        chosen = [best]
        for i in free[(hit[free, k] >= SHARED) & (row_start[k] <= middle[free]) & (middle[free] <= row_end[k])].tolist():
            if i != best and not crossing(i, chosen):
                chosen.append(i)
        out[chosen] = True
    gone[near] = out
    return gone


ROW = ["row", "start_s", "end_s", "text", "id", "ord", "operation", "s0", "s1", "block_start", "block_end", "whole", "v0", "v1"]


def _applied(g: dict[str, list[Any]]) -> Iterator[tuple[Any, ...]]:
    """What a recording's segments (rows before those of blocks, in order) become, block after block."""
    many = sum(not x for x in g["row"])
    numbers = lambda values: np.array([np.nan if x is None else x for x in values], float)
    start, end, text = numbers(g["start_s"][:many]), numbers(g["end_s"][:many]), np.array(g["text"][:many], object)
    block, order = np.full(many, -1), np.full(many, -1.0)  # which block a segment is from, and its row's number there
    blocks: dict[Any, list[int]] = {}
    for i in range(many, len(g["row"])):
        if g["id"][i] is not None:
            blocks.setdefault(g["id"][i], []).append(i)
    bound = lambda k, c: (g[c][blocks[k][0]] != g[c][blocks[k][0]], np.nan_to_num(g[c][blocks[k][0]]))
    ids = sorted(blocks, key=lambda k: (bound(k, "block_start"), bound(k, "block_end"), k))
    for n, name in enumerate(ids):
        rows = sorted(blocks[name], key=lambda i: (g["ord"][i] is None, g["ord"][i] or 0))
        of = {c: numbers(g[c][i] for i in rows) for c in ("start_s", "end_s", "s0", "s1", "v0", "v1", "ord")}
        if g["whole"][rows[0]]:
            first = np.where(np.isnan(start), 0.0, start)
            until = np.maximum(first + 0.001, np.where(np.isfinite(end), end, first + 0.001))
            gone = (until > g["block_start"][rows[0]]) & (first < g["block_end"][rows[0]])
        else:
            said = np.array([g["operation"][i] != "insert" for i in rows], bool) & (of["s1"] > of["s0"])
            gone = taken(start, end, of["s0"][said], of["s1"][said])
        new = (of["end_s"] > of["v0"]) & (of["start_s"] < of["v1"])
        put = lambda old, more: np.concatenate([old[~gone], more[new]])  # noqa: E731, B023
        start, end, text = put(start, of["start_s"]), put(end, of["end_s"]), put(text, np.array([g["text"][i] for i in rows], object))
        block, order = put(block, np.full(len(rows), n)), put(order, of["ord"])
    at = np.round(np.where(np.isnan(start), 0.0, start), 9)
    known = lambda x: None if x != x else float(x)
    for n, i in enumerate(np.lexsort((order, block, block < 0, at)).tolist()):
        put_in = bool(block[i] >= 0)
        yield g["of"][0], n, known(start[i]), known(end[i]), text[i], put_in, ids[block[i]] if put_in else None, int(order[i]) if put_in and order[i] == order[i] else None


APPLIED = "start_s double, end_s double, text string, locked boolean, correction_id string, correction_ord int"


def apply_corrections(segs: DataFrame, rows: DataFrame, visible: tuple[Column, Column] | None = None) -> DataFrame:
    """CO-03..05: (recording_id, n, start_s, end_s, text, locked, correction_id, correction_ord) of every recording of ``segs``, in order.

    segs (recording_id, start_s, end_s, text, locked): rows locked by an earlier application go first, so applying again changes nothing.
    rows: those of ``create_blocks``. Blocks outside the visible range (columns of rows; all if none is given) are left out, and so are
    their rows outside; the others apply by start, end and id. Equal starts: rows of a block in their order, locked ones first.
    """
    low, high = visible or (F.lit(float("-inf")), F.lit(float("inf")))
    r = rows.select(
        F.col("recording_id").alias("of"), "id", F.col("ord").cast("int").alias("ord"), "start_s", "end_s", "text", "operation", F.coalesce("source_start", "start_s").alias("s0"), F.coalesce("source_end", "end_s").alias("s1"),
        "block_start", "block_end", F.coalesce("replace_all", F.lit(False)).alias("whole"), low.cast("double").alias("v0"), high.cast("double").alias("v1"),
    ).where("block_end > v0 AND block_start < v1")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    kept = segs.where(~F.coalesce("locked", F.lit(False))).select(F.col("recording_id").alias("of"), number("start_s"), number("end_s"), F.coalesce("text", F.lit("")).alias("text"))
    both = kept.withColumn("row", F.lit(False)).unionByName(r.withColumns({"row": F.lit(True), "start_s": number("start_s"), "end_s": number("end_s")}), allowMissingColumns=True)
    kind = segs.schema["recording_id"].dataType.simpleString()
    schema = arrow_schema(f"recording_id {kind}, n long, {APPLIED}")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
        for columns in groups(batches):
            yield from _applied(dict(zip(["of", *ROW], columns, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow(rows_of(batches), schema)

    last = [F.col(c).asc_nulls_last() for c in ("start_s", "end_s", "text")]
    return by_key(both.select("of", *ROW), "of", "row", *last).mapInArrow(run, f"recording_id {kind}, n long, {APPLIED}")


def rebuild(applied: DataFrame) -> DataFrame:
    """CO-05: per recording the text of its segments, a line each, their number, and the applied corrections' ids, sorted."""
    rows = F.array_sort(F.collect_list(F.struct("n", "text")))
    return applied.groupBy("recording_id").agg(
        F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("segments"), F.array_join(F.array_sort(F.collect_set("correction_id")), ",").alias("applied"),
    )
