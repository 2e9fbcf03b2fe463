"""Transcript rows: same-speaker merge, exports, corrections, interpolation, and the order-dependent folds (WN, SNK-04..08, CO-02/03, CN-08, CN-15)."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.scalars import format_clock, format_time, round6, speaker_label, text_weight
from .intervals import range_join


def _joined(texts: Column, stop: str = "。") -> Column:
    """WN-02: texts in order, with a full stop between unless one is there; empty ones are skipped."""
    return F.aggregate(
        F.filter(texts, lambda t: t != ""), F.lit(""),
        lambda a, t: F.when(a == "", t).when(F.endswith(a, F.lit(stop)), F.concat(a, t)).otherwise(F.concat(a, F.lit(stop), t)),
    )


def merge_same_speaker(segs: DataFrame, order: str = "turn") -> DataFrame:
    """WN-01: runs of one known speaker (0 or more) become one row from the first start to the last end; null and -1 never merge."""
    w = Window.partitionBy("recording_id").orderBy(order)
    same = (F.col("spk") >= 0) & (F.lag("spk").over(w) == F.col("spk"))
    d = segs.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))))
    g = d.groupBy("recording_id", "run").agg(
        F.first("spk", ignorenulls=True).alias("spk"), F.min_by("start_s", order).alias("start_s"), F.max_by("end_s", order).alias("end_s"), rows.alias("r")
    )
    return g.select("recording_id", F.col("run").cast("int").alias("run"), "spk", "start_s", "end_s", _joined(F.transform("r", lambda x: x["t"])).alias("text"))


def _prefix(spk: Column) -> Column:
    name = speaker_label(spk)
    return F.when(name == "", "").otherwise(F.concat(name, F.lit(": ")))


def _lines(segs: DataFrame, line: Column, order: str, between: str, head: str = "", tail: str = "") -> DataFrame:
    g = segs.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["t"]), between)
    return g.select("recording_id", F.concat(F.lit(head), body, F.lit(tail)).alias("content"))


def to_text(segs: DataFrame, order: str = "turn") -> DataFrame:
    """SNK-04: one document per recording."""
    line = F.concat(F.lit("["), format_clock(F.col("start_s")), F.lit(" --> "), format_clock(F.col("end_s")), F.lit("] "), _prefix(F.col("spk")), F.col("text"))
    return _lines(segs, line, order, "\n")


def _cue(sep: str) -> Column:
    return F.concat(format_time(F.col("start_s"), sep), F.lit(" --> "), format_time(F.col("end_s"), sep), F.lit("\n"), _prefix(F.col("spk")), F.col("text"), F.lit("\n"))


def to_srt(segs: DataFrame, order: str = "turn") -> DataFrame:
    """SNK-05: numbered cues."""
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy(order))
    return _lines(segs.withColumn("_n", n), F.concat(F.col("_n").cast("string"), F.lit("\n"), _cue(",")), "_n", "\n")


def to_vtt(segs: DataFrame, order: str = "turn") -> DataFrame:
    """SNK-06."""
    return _lines(segs, _cue("."), order, "\n", "WEBVTT\n\n")


def to_json(segs: DataFrame, order: str = "turn") -> DataFrame:
    """SNK-07: the result of a recording as JSON."""
    row = F.struct(F.col(order).alias("idx"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", F.col("spk").alias("speaker"))
    g = segs.groupBy("recording_id").agg(F.sort_array(F.collect_list(row)).alias("segments"))
    return g.select("recording_id", F.to_json(F.struct("segments")).alias("content"))


EXPORTERS = {"txt": to_text, "srt": to_srt, "vtt": to_vtt, "json": to_json}


def export(segs: DataFrame, form: str, path: str | None = None, merged: bool = False, order: str = "turn") -> DataFrame:
    """SNK-08: one document per recording in the given form; with a path also written, a folder per recording."""
    if form not in EXPORTERS:
        raise ValueError(f"unknown export format: {form}")
    out = EXPORTERS[form](merge_same_speaker(segs, order).withColumnRenamed("run", order) if merged else segs, order)
    if path:
        out.select("recording_id", F.col("content").alias("value")).write.partitionBy("recording_id").text(path)
    return out


def interpolate(rows: DataFrame, start: Column, end: Column, key: str = "recording_id") -> DataFrame:
    """WN-03: runs of untimed rows share the gap between their timed neighbours by text weight, the last one up to the gap's end.

    Rows (key, ord, start_s, end_s, text); ``start`` and ``end`` bound the block. Bounds and floors of a millisecond hold for timed rows; a gap
    that is empty or negative gives each row a millisecond.
    """
    timed = F.coalesce(F.col("end_s") > F.col("start_s"), F.lit(False))
    w = Window.partitionBy(key).orderBy("ord")
    t0 = F.greatest(start, F.least(F.greatest(start, end - 0.001), F.col("start_s")))
    d = rows.withColumn("_timed", timed).withColumn("_s", F.when(timed, t0))
    d = d.withColumn("_e", F.when(timed, F.least(end, F.greatest(F.least(end, F.col("_s") + 0.001), F.col("end_s")))))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumns({
        "_a": F.coalesce(F.last("_e", ignorenulls=True).over(before), start), "_b": F.coalesce(F.first("_s", ignorenulls=True).over(after), end),
        "_run": F.sum(F.when(timed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_w": F.when(~timed, text_weight(F.col("text"))),
    })
    run = Window.partitionBy(key, "_run", "_timed")
    d = d.withColumns({"_all": F.sum("_w").over(run), "_n": F.count("*").over(run), "_upto": F.sum("_w").over(run.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)),
                       "_i": F.row_number().over(run.orderBy("ord"))})
    a = F.when(F.col("_b") > F.col("_a"), F.col("_a")).otherwise(F.greatest(start, F.least(F.greatest(start, end - 0.001), F.col("_a"))))
    d = d.withColumn("_ga", a).withColumn("_gb", F.when(F.col("_b") > F.col("_a"), F.col("_b")).otherwise(F.least(end, F.col("_ga") + 0.001 * F.col("_n"))))
    room = F.greatest(0.001 * F.col("_n"), F.col("_gb") - F.col("_ga"))
    s = F.col("_ga") + room * (F.col("_upto") - F.col("_w")) / F.col("_all")
    e = F.when(F.col("_i") == F.col("_n"), F.col("_gb")).otherwise(F.col("_ga") + room * F.col("_upto") / F.col("_all"))
    out = d.withColumns({"start_s": round6(F.when(F.col("_timed"), F.col("_s")).otherwise(s)), "end_s": round6(F.when(F.col("_timed"), F.col("_e")).otherwise(F.greatest(s + 0.001, e)))})
    return out.select(*rows.columns)


def upsert_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """CO-02, SO-05: the new blocks replace those with their id and those whose source range they overlap, per recording; others of the same id stay."""
    rng = lambda df: df.withColumns({"start_s": F.coalesce("source_start", "block_start"), "end_s": F.coalesce("source_end", "block_end")})
    key = ["recording_id", "id", "start_s", "end_s"]
    old = rng(blocks.join(new.select("recording_id", "id"), ["recording_id", "id"], "left_anti"))
    hit = range_join(old.select(*key), rng(new).select("recording_id", "start_s", "end_s"), points=True).select(*key).distinct()
    return old.join(hit, key, "left_anti").select(*blocks.columns).unionByName(new)


def replace_ranges(segs: DataFrame, blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """CO-03: segments that overlap a block go (a point counts as a millisecond), and the blocks' rows come instead.

    segs (recording_id, seg_id, start_s, end_s, text), blocks (recording_id, id, start_s, end_s), rows (recording_id, id, ord, start_s, end_s, text).
    """
    point = segs.withColumn("end_s", F.greatest(F.col("start_s") + 0.001, F.coalesce("end_s", F.col("start_s") + 0.001)))
    hit = range_join(point, blocks, points=True).select("recording_id", "seg_id").distinct()
    kept = segs.join(hit, ["recording_id", "seg_id"], "left_anti")
    none = lambda t: F.lit(None).cast(t)
    a = kept.select("recording_id", "start_s", "end_s", "text", F.lit(False).alias("locked"), none("string").alias("correction_id"), none("int").alias("correction_ord"))
    b = rows.select("recording_id", "start_s", "end_s", "text", F.lit(True).alias("locked"), F.col("id").alias("correction_id"), F.col("ord").cast("int").alias("correction_ord"))
    return a.unionByName(b)


def trim_repeat(before: str, text: str, most: int = 24) -> str:
    """The text without the longest beginning (2 to 24 characters) that repeats the end of the one before."""
    for n in range(min(len(before), len(text), most), 1, -1):
        if before.endswith(text[:n]):
            return text[n:]
    return text


def trim_repeats(segs: DataFrame) -> DataFrame:
    """CN-08 per recording: overlapping neighbours of one chain and track lose repeated beginnings; emptied ones go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for s in pdf.sort_values(["start_s", "end_s", "idx"]).to_dict("records"):
            last = out[-1] if out else None
            if last and last["chain"] == s["chain"] and last["track"] == s["track"] and s["start_s"] < last["end_s"]:
                s["text"] = trim_repeat(last["text"], s["text"])
            if s["text"]:
                out.append(s)
        return pd.DataFrame(out, columns=list(pdf.columns))

    d = segs.select("recording_id", "idx", "start_s", "end_s", F.col("chain").cast("string"), F.coalesce(F.col("track").cast("string"), F.lit("")).alias("track"), "text")
    return d.groupBy("recording_id").applyInPandas(run, d.schema)


def greedy_map(scores: DataFrame) -> DataFrame:
    """CN-15 per recording: speaker clusters to labels one to one, best score first, ties by number; only positive scores."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for r in pdf[pdf["score"] > 0].sort_values(["score", "cluster", "label"], ascending=[False, True, True]).to_dict("records"):
            a, b = ("c", r["cluster"]), ("l", r["label"])
            if a not in used and b not in used:
                used |= {a, b}
                out.append(r)
        return pd.DataFrame(out, columns=list(pdf.columns))

    return scores.groupBy("recording_id").applyInPandas(run, scores.schema)


def _compared(a: dict, b: dict) -> float:
    if abs(a["score"] - b["score"]) > 0.005:
        return b["score"] - a["score"]
    for c in ("deletion_rate", "seed_distance"):
        if abs(a[c] - b[c]) > 1e-9:
            return a[c] - b[c]
    return a["cost"] - b["cost"]


@F.arrow_udf(IntegerType())
def _first(candidates: pa.Array) -> pa.Array:
    """The place (from 0) of the best of each array's candidates."""
    number = lambda c: {k: float("nan") if v is None else v for k, v in c.items()}
    return pa.array([sorted(range(len(c)), key=cmp_to_key(lambda i, j: _compared(c[i], c[j])))[0] for c in ([*map(number, x)] for x in candidates.to_pylist())], pa.int32())


def best_candidate(cands: DataFrame, key: str) -> DataFrame:
    """WN-08 per group: the tolerant comparison isn't transitive, so a stable sort with it decides, as candidates come by ``ord``.

    A group's few candidates are one array, and many groups go to Python together.
    """
    rest = [c for c in cands.columns if c not in (key, "ord")]
    g = cands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("c"))
    seen = F.transform("c", lambda x: F.struct(*(x[c].cast("double").alias(c) for c in ("score", "deletion_rate", "seed_distance", "cost"))))
    g = g.select(key, F.get("c", _first(seen)).alias("b"))
    return g.select(*(F.col(c) if c == key else F.col(f"b.{c}").alias(c) for c in cands.columns))
