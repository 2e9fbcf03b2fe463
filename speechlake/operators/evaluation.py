"""Evaluation: parsing, cases, manifests, character metrics and reports (SRC-05, EV-xx, TX-08..10, AG-xx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import assign_udf, concatenated_udf, shared_chars_udf
from ..functions.scalars import normalize_text, parse_clock, round6
from .intervals import detect_overlaps, range_join

#: The transcript's line grammar (fixed values).
LINE = "^\\[([^\\]]+?)\\s*-->\\s*([^\\]]+?)\\]\\s*(.+)$"
BODY = "^([^:：]{1,80})[:：]\\s*(.+)$"


def parse_transcript(lines: DataFrame, compatible: bool = True) -> DataFrame:
    """SRC-05: each non-blank line (columns kept) with start_s, end_s, speaker, body text and a warning, null for good lines."""
    v = F.trim("line")
    d = lines.withColumn("_v", v).where("_v != ''")
    m = F.col("_v").rlike(LINE)
    d = d.withColumns({"_m": m, "start_s": F.when(m, parse_clock(F.regexp_extract("_v", LINE, 1))), "end_s": F.when(m, parse_clock(F.regexp_extract("_v", LINE, 2))), "_b": F.trim(F.regexp_extract("_v", LINE, 3))})
    d = d.withColumns({"speaker": F.trim(F.regexp_extract("_b", BODY, 1)), "text": F.trim(F.regexp_extract("_b", BODY, 2)), "_s": F.col("_b").rlike(BODY)})
    warning = (
        F.when(~F.col("_m"), "no-time").when(F.col("start_s").isNull() | F.col("end_s").isNull() | (F.col("end_s") <= F.col("start_s")), "bad-time")
        .when(~F.col("_s"), "no-speaker").when(normalize_text(F.col("text"), compatible) == "", "empty-text")
    )
    return d.withColumn("warning", warning).drop("_v", "_m", "_b", "_s")


def built_cases(segs: DataFrame, most: float = 10.0) -> DataFrame:
    """EV-01/02: (recording_id, o0, o1, start_s, end_s, speakers, rows, reason) of overlaps, unrounded: rows (array of who, s, e, t) are the segments
    that meet them, sorted; reason is null for cases of exactly two speakers. Overlaps with the same segments count once, the first.
    """
    j = range_join(detect_overlaps(segs), segs)
    a = j.groupBy("recording_id", F.col("start_s").alias("o0"), F.col("end_s").alias("o1")).agg(
        F.countDistinct("r_speaker").alias("speakers"), F.array_join(F.array_sort(F.collect_list(F.col("r_seg_id").cast("string"))), "|").alias("ids"),
        F.min("r_start_s").alias("start_s"), F.max("r_end_s").alias("end_s"),
        F.array_sort(F.collect_list(F.struct(F.col("r_speaker").alias("who"), F.col("r_start_s").alias("s"), F.col("r_end_s").alias("e"), F.col("r_text").alias("t")))).alias("rows"),
    )
    n = F.row_number().over(Window.partitionBy("recording_id", "ids").orderBy("o0"))
    a = a.withColumn("_n", n).where((F.col("speakers") != 2) | (F.col("_n") == 1))
    reason = F.when(F.col("speakers") != 2, "not-exactly-two-speakers").when(F.col("end_s") - F.col("start_s") > most + 1e-6, "case-too-long")
    return a.withColumn("reason", reason).drop("_n", "ids")


def overlap_cases(segs: DataFrame, most: float = 10.0) -> DataFrame:
    """EV-01/02: (recording_id, overlap_start, overlap_end, start_s, end_s, speakers, texts, reason): cases of exactly two speakers.

    Overlaps with the same set of segments count once, the first; reason is null for cases. Segments (recording_id, seg_id, speaker, text).
    """
    who = F.array_distinct(F.transform("rows", lambda r: r["who"]))
    said = F.transform(who, lambda w: F.array_join(F.transform(F.filter("rows", lambda r: r["who"] == w), lambda r: r["t"]), ""))
    return built_cases(segs, most).select(
        "recording_id", round6(F.col("o0")).alias("overlap_start"), round6(F.col("o1")).alias("overlap_end"), round6(F.col("start_s")).alias("start_s"),
        round6(F.col("end_s")).alias("end_s"), F.col("speakers").cast("int").alias("speakers"), F.array_join(said, "/").alias("texts"), "reason",
    )


def validate_cases(cases: DataFrame) -> DataFrame:
    """EV-04 over flattened manifests: one row per (recording_id, case_id, fault).

    cases (recording_id, audio, case_id, start_s, end_s, overlap_start, overlap_end, speaker_a, text_a, speaker_b, text_b, n_references).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("recording_id", "start_s"))
    d = cases.withColumn("_n", n)
    ordered = (F.col("end_s") > F.col("start_s")) & (F.col("overlap_end") > F.col("overlap_start")) & (F.col("overlap_start") >= F.col("start_s")) & (F.col("overlap_end") <= F.col("end_s"))
    faults = {
        "no-recording-id": blank("recording_id"), "no-audio": blank("audio"), "no-case-id": blank("case_id"), "duplicate-case-id": ~blank("case_id") & (F.col("_n") > 1),
        "bad-times": ~F.coalesce(ordered, F.lit(False)), "not-two-speakers": (F.col("n_references") != 2) | blank("speaker_a") | blank("speaker_b") | (F.trim("speaker_a") == F.trim("speaker_b")),
        "empty-reference": (normalize_text(F.col("text_a"), False) == "") | (normalize_text(F.col("text_b"), False) == ""),
    }
    found = F.filter(F.array(*(F.when(c, k) for k, c in faults.items())), lambda x: x.isNotNull())
    return d.select("recording_id", "case_id", F.explode(found).alias("fault"))


def pit2(r1: Column, r2: Column, h1: Column, h2: Column) -> tuple[Column, Column]:
    """TX-08 for two speakers: (distance, whether the hypotheses are swapped); a tie keeps their order."""
    p = assign_udf(F.array(r1, r2), F.array(h1, h2))
    return p["distance"], p["assignment"][0] == 1


def cp2(r1: Column, r2: Column, h: Column) -> Column:
    """TX-09 for two speakers."""
    return concatenated_udf(F.array(r1, r2), h)


def pit(refs: Column, hyps: Column) -> Column:
    """TX-08 for any number of speakers: struct (distance, assignment) of arrays of texts; missing hypotheses are empty ones.

    The assignment is found by shortest augmenting paths; of equal ones that which comes first in order. Hypotheses left over cost nothing.
    """
    return assign_udf(refs, hyps)


def cp(refs: Column, hyp: Column) -> Column:
    """TX-09: least distance of one hypothesis to the references in any order, for any number of them (work grows with 2^n, not n!)."""
    return concatenated_udf(refs, hyp)


def reference_text(rows: DataFrame, key: str, order: str, text: str = "normalized_text") -> DataFrame:
    """TX-07: a recording's normalised rows in order, as one text."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("r"))
    return g.select(key, F.array_join(F.transform("r", lambda x: x["t"]), "").alias("reference_text"))


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """EV-05: the metrics of each case, with its columns: references (array of texts), mixture (the text of the mixed sound), stems (array
    of the separated texts), added (text that the gate let in), gate_accepted. Texts are normalised already.

    Rejected cases keep the mixture's text, accepted ones add to it. Rates per case come from ``case_summary``.
    """
    refs, all_refs = F.col("references"), F.array_join("references", "")
    after = F.when(F.col("gate_accepted"), F.concat("mixture", F.coalesce("added", F.lit("")))).otherwise(F.col("mixture"))
    d = cases.withColumn("_p", pit(refs, F.col("stems"))).withColumns({
        "reference_chars": F.length(all_refs).cast("long"), "mixture_distance": cp(refs, F.col("mixture")), "separated_distance": F.col("_p.distance"), "assignment": F.col("_p.assignment"),
        "matched_before": shared_chars(all_refs, F.col("mixture")), "matched_after": shared_chars(all_refs, after),
        "added_chars": (F.length(after) - F.length("mixture")).cast("long"),
    })
    return d.withColumn("recovered_chars", F.col("matched_after") - F.col("matched_before")).drop("_p")


def clean_remap(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """AG-07: one row: the sums of the metrics over cases that have them against clean references (``clean_`` columns), and how many lack them."""
    there = F.lit(True)
    for m in metrics:
        there = there & F.col(f"clean_{m}").isNotNull()
    return cases.agg(F.count_if(there).alias("cases"), F.count_if(~there).alias("skipped"), *(F.coalesce(F.sum(F.when(there, F.col(f"clean_{m}"))), F.lit(0)).alias(m) for m in metrics))


def shared_chars(ref: Column, hyp: Column) -> Column:
    """SO-03: size of the multiset intersection of two texts' characters."""
    return shared_chars_udf(ref, hyp)


def char_coverage(pairs: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """TX-10, SO-03/04: multiset overlap of characters per row (key, ref, hyp), within the row; null texts count as empty."""
    r, h = (F.coalesce(F.col(c), F.lit("")) for c in (ref, hyp))
    return rates(pairs.select(key, F.length(r).cast("long").alias("reference_chars"), F.length(h).cast("long").alias("hypothesis_chars"), shared_chars(r, h).alias("matched")))


def rates(df: DataFrame) -> DataFrame:
    """AG-04: omissions, additions, precision, recall and F1 from the three counts."""
    one = lambda c: F.greatest(F.lit(1), F.col(c)).cast("double")
    p, r = F.col("matched") / one("hypothesis_chars"), F.col("matched") / one("reference_chars")
    return df.withColumns({
        "omissions": F.col("reference_chars") - F.col("matched"), "additions": F.col("hypothesis_chars") - F.col("matched"), "precision": round6(p), "recall": round6(r),
        "f1": round6(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)),
    })


def case_summary(cases: DataFrame, groups: list[list[str]] | None = None) -> DataFrame:
    """AG-05/06: micro-averaged report over all cases, or by grouping sets (a column outside its set is null)."""
    one = lambda c: F.greatest(F.lit(1), c).cast("double")
    n, ref = F.count("*"), F.sum("reference_chars")
    cols = sorted({c for g in groups or [] for c in g})
    aggs = [
        n.alias("cases"), ref.alias("reference_chars"), round6(F.sum("mixture_distance") / one(ref)).alias("mixture_cer"), round6(F.sum("separated_distance") / one(ref)).alias("separated_cer"),
        round6((F.sum("mixture_distance") - F.sum("separated_distance")) / one(ref)).alias("cer_delta"), F.count_if("gate_accepted").alias("gate_accepted"),
        round6(F.count_if("gate_accepted") / one(n)).alias("gate_rate"), round6(F.sum("duration_s")).alias("audio_s"),
        round6(F.sum("separation_ms") / 1000.0 / F.greatest(F.lit(0.001), F.sum("duration_s"))).alias("separation_rtf"),
    ]
    if not groups:
        return cases.agg(*aggs)
    return cases.groupingSets([[F.col(c) for c in g] for g in groups], *cols).agg(*aggs, F.grouping_id().cast("int").alias("level"))


def value_stats(df: DataFrame, key: str, value: str, cells: int = 1024) -> DataFrame:
    """AG-10: (key, n, mean, median, max): the median is the upper one of two. Nothing is gathered per key.

    Equal values are counted first; a table of cells between a key's least and greatest value shows in which the median lies, and only
    the distinct values of that cell are put in order.
    """
    every = df.groupBy(key).agg(F.count("*").alias("_n"), F.count(value).alias("_k"), F.avg(value).alias("_mean"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    place = F.floor((F.col("_v") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) * (cells - 1))
    counted = counted.join(every.select(key, "_low", "_high", "_k"), key).withColumn("_cell", place)
    so_far = lambda *by: Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.floor(F.col("_k") / 2) + 1
    hit = counted.groupBy(key, "_cell", "_k").agg(F.sum("_c").alias("_c")).withColumn("_upto", F.sum("_c").over(so_far("_cell")))
    hit = hit.where((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_c") < middle)).select(key, "_cell", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = counted.join(hit, [key, "_cell"]).withColumn("_rank", F.col("_before") + F.sum("_c").over(so_far("_v")))
    median = inside.where(F.col("_rank") >= middle).groupBy(key).agg(F.min("_v").alias("_median"))
    out = every.join(median, key, "left")
    return out.select(key, F.col("_n").alias("n"), round6(F.col("_mean")).alias("mean"), round6(F.col("_median")).alias("median"), round6(F.col("_high")).alias("max"))
