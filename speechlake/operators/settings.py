"""Configuration and reference-row rules (CF-04, CF-07..11, CF-13, CF-14, IV-15/16, PR-04..06, TX-16, SNK-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, normalize_text, round6
from .intervals import overlap_seconds, range_join


def finite(x: Column) -> Column:
    """The number if it is one, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalized_range(start_seconds: Column, start: Column, end_seconds: Column, end: Column, durations: list[Column], fallback: Column) -> tuple[Column, Column]:
    """CF-07: bounds from two spellings of each, else from the first duration given; never empty."""
    a = F.greatest(F.lit(0.0), F.coalesce(finite(start_seconds), finite(start), F.lit(0.0)))
    length = F.greatest(F.lit(0.0), F.coalesce(*(finite(d) for d in durations), finite(fallback), F.lit(0.0)))
    b = F.coalesce(finite(end_seconds), finite(end), a + length)
    return a, F.when(b > a, b).otherwise(a + F.greatest(F.lit(0.1), F.coalesce(finite(fallback), F.lit(0.1))))


def valid_time(start: Column, end: Column) -> Column:
    """PR-04/05: whether both times are finite and in order."""
    return F.coalesce(finite(end) > finite(start), F.lit(False))


def reference_rows(rows: DataFrame, key: str, order: str, compatible: bool = True) -> DataFrame:
    """CF-08: confirmed rows with their fields cleaned. ``ord`` counts confirmed rows before those without text go. The speaker's name
    (speaker_name) and the times in the source (source_start, source_end) are kept where there are such columns."""
    d = rows.where(F.coalesce("confirmed", F.lit(True)))
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    speaker = F.when(F.coalesce("speaker", F.lit("")) == "", "speaker-1").otherwise(F.col("speaker"))
    time = lambda c: F.greatest(F.lit(0.0), finite(F.col(c)))
    at = lambda c: F.when(finite(F.col(c)).isNotNull(), time(c)).alias(c)
    more = [F.substring(F.trim(F.coalesce("speaker_name", F.lit(""))), 1, 40).alias("speaker_name")] if "speaker_name" in rows.columns else []
    more += [at(c) for c in ("source_start", "source_end") if c in rows.columns]
    d = d.select(
        key, "ord", F.substring(speaker, 1, 40).alias("speaker"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), normalize_text(F.col("text"), compatible).alias("normalized_text"),
        at("start_s"), at("end_s"), F.when(F.col("operation") == "insert", "insert").otherwise("replace").alias("operation"), *more,
    )
    return d.where("normalized_text != ''")


def fingerprint(*options: str) -> Column:
    """CF-09: one key for equal options."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in options)), 256)


def summary(*parts: Column) -> Column:
    """CF-10: labels joined by a middle dot, missing ones left out."""
    return F.concat_ws(" ・ ", *parts)


def upsert_presets(presets: DataFrame, new: DataFrame, key: str, most: int = 20) -> DataFrame:
    """CF-04: a new preset takes the place of one with its id, else of one with its name in any case; at most ``most`` per owner.

    Rows (key, ord, id, name, ..); names are trimmed, white space in them is one space, at most 40 characters, and nameless ones go.
    """
    tidy = F.substring(F.regexp_replace(F.trim("name"), "\\s+", " "), 1, 40)
    both = presets.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("name", tidy).where("name != ''")
    by = lambda *c: Window.partitionBy(key, *c).orderBy(F.desc("_new"), F.desc("ord"))
    one = both.withColumn("_i", F.row_number().over(by("id"))).where("_i = 1")
    one = one.withColumn("_i", F.row_number().over(by(F.lower("name")))).where("_i = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", "id"))
    return one.withColumn("_i", place).where(F.col("_i") <= most).drop("_i", "_new")


def close_state(results: Column, recordings: Column, dictionary: Column, drafts: Column, jobs: Column, recording: Column, ask: Column) -> dict[str, Column]:
    """CF-11: what is unsaved or running, and whether closing asks first."""
    n = lambda c: F.greatest(F.lit(0), F.floor(F.coalesce(c, F.lit(0))))
    on = lambda c: F.coalesce(c, F.lit(False))
    unsaved = (n(results) > 0) | (n(recordings) > 0) | on(dictionary) | (n(drafts) > 0)
    active = (n(jobs) > 0) | on(recording)
    return {"unsaved": unsaved, "active": active, "ask": active | (F.coalesce(ask, F.lit(True)) & unsaved)}


def stem_options(threshold: Column, speech: Column, silence: Column, most: Column) -> dict[str, Column]:
    """CF-13: detection options for separated stems; zero or missing gives the bound."""
    low = lambda c, b: F.least(F.lit(b), F.when(F.coalesce(c, F.lit(0.0)) == 0, b).otherwise(c))
    return {"threshold": low(threshold, 0.5), "min_speech": low(speech, 0.12), "min_silence": low(silence, 0.18), "max_speech": low(most, 4.0)}


def recognizer_mode(words: Column, enabled: Column, accurate: Column, score: Column) -> dict[str, Column]:
    """CF-14: words in the dictionary force the beam search; without any the score is 0."""
    use = (words > 0) & F.coalesce(enabled, F.lit(True))
    return {"method": F.when(use | F.coalesce(accurate, F.lit(False)), "modified_beam_search").otherwise("greedy_search"), "hotword_score": F.when(use, F.coalesce(score, F.lit(2.0))).otherwise(0.0)}


def inferred_range(rows: DataFrame, key: str, order: str) -> DataFrame:
    """IV-15: for each row the range that a row inserted before it would get."""
    w = Window.partitionBy(key).orderBy(order)
    pa, pb = F.lag("start_s").over(w), F.lag("end_s").over(w)
    d = rows.withColumns({"_pa": pa, "_pb": pb})
    o0, o1 = F.greatest("_pa", "start_s"), F.least("_pb", "end_s")
    gap = round6(F.col("start_s") - F.col("_pb")) >= 0.05
    known = F.col("_pb").isNotNull()
    cross = known & F.col("start_s").isNotNull() & (round6(o1 - o0) >= 0.1)
    a = F.when(gap, F.col("_pb")).when(cross, o0).when(known, F.col("_pb")).when(F.col("start_s").isNotNull(), F.greatest(F.lit(0.0), F.col("start_s") - 1)).otherwise(0.0)
    b = F.when(gap, F.col("start_s")).when(cross, o1).when(known, F.col("_pb") + 1).when(F.col("start_s").isNotNull(), F.col("start_s")).otherwise(1.0)
    return d.select(key, order, round6(a).alias("start_s"), round6(b).alias("end_s"))


def clamp_row(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """IV-16: a row of at least 0.05 s inside its range, in hundredths."""
    s = F.greatest(low, F.least(high - 0.05, F.coalesce(finite(start), low)))
    e = F.greatest(s + 0.05, F.least(high, F.coalesce(finite(end), F.coalesce(finite(start), low) + 1)))
    cent = lambda x: F.floor(x * 100 + 0.5) / F.lit(100.0)
    return cent(s), cent(e)


def hypothesis_rows(segs: DataFrame, windows: DataFrame, seg_key: str, least: float = 0.05) -> DataFrame:
    """PR-06: segments that share ``least`` seconds with a confirmed window or have their middle in one; all, where a recording has no window."""
    j = range_join(segs, windows, points=True)
    hit = round6(overlap_seconds((F.col("start_s"), F.col("end_s")), (F.col("r_start_s"), F.col("r_end_s")))) >= least
    middle = (F.col("start_s") + F.col("end_s")) / 2
    near = j.where(hit | ((middle >= F.col("r_start_s")) & (middle <= F.col("r_end_s")))).select("recording_id", seg_key).distinct()
    free = segs.join(windows.select("recording_id").distinct(), "recording_id", "left_anti")
    return segs.join(near, ["recording_id", seg_key], "left_semi").unionByName(free)


def percent(x: Column) -> Column:
    """TX-16: one decimal and a percent sign, ``-`` for what isn't finite."""
    return F.when(finite(x).isNotNull(), F.format_string("%.1f%%", x * 100)).otherwise("-")


def markdown_report(summary_rows: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-09: a grouped report as lines of a Markdown table; texts stay out of it. A report has a row per group, so it fits one list."""
    cells = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    line = cells([F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in columns])
    body = summary_rows.select(F.lit(1).alias("part"), F.struct(*columns).alias("o"), line.alias("line"))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns)
    g = body.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("r"))
    return g.select(F.concat(F.lit(head + "\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("content"))


def clamp_recognition(x: Column, low: float, high: float, fallback: float) -> Column:
    """CF-01 as recognition uses it."""
    return clamp(x, low, high, fallback)


#: What a report says of its cases: columns of ``case_summary`` and their names in the report (fixed values).
REPORTED = {
    "cases": "cases", "reference_chars": "referenceChars", "mixture_cer": "mixtureCer", "separated_cer": "separatedPitCer", "cer_delta": "cerDelta", "gate_accepted": "gateAccepted",
    "gate_rate": "gateAcceptanceRate", "audio_s": "audioSeconds", "separation_rtf": "separationRtf",
}


def json_report(overall: DataFrame, by_dataset: DataFrame, by_condition: DataFrame, generated_at: Column) -> DataFrame:
    """SNK-09: one JSON report (column content) from ``case_summary`` over all cases, by dataset, and by snr_db and overlap_ratio. A report has a row
    per data set and condition, so it fits one value; texts stay out of it."""
    said = F.struct(*(F.col(c).alias(n) for c, n in REPORTED.items()))
    one = overall.select(F.lit(1).alias("_k"), said.alias("summary"))
    sets = by_dataset.agg(F.sort_array(F.collect_list(F.struct("dataset", said.alias("summary")))).alias("byDataset")).withColumn("_k", F.lit(1))
    made = by_condition.agg(F.sort_array(F.collect_list(F.struct(F.col("snr_db").alias("snrDb"), F.col("overlap_ratio").alias("overlapRatio"), said.alias("summary")))).alias("bySyntheticCondition")).withColumn("_k", F.lit(1))
    time = F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt")
    return one.join(sets, "_k").join(made, "_k").select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), time, "summary", "byDataset", "bySyntheticCondition")).alias("content"))
