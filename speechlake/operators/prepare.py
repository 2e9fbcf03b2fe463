"""Evaluation manifests from timed transcripts (EV-03, SNK-10): lines to segments, overlaps to cases, one validated manifest a recording.

A recording's manifest is one JSON object, as ``sources.media.read_manifests`` reads it. What is published is whole: if any manifest breaks a
rule nothing is written, and Spark's commit shows either all files or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_text, round6, safe_id
from ..sources.shared import written
from .evaluation import built_cases, parse_transcript, validate_cases
from .intervals import detect_overlaps

VERSION = 1
PARSER = "timed-speaker-transcript-v1"
#: What a data set says of itself unless told otherwise (fixed values).
DATASET = {"name": "Japanese overlap local evaluation", "language": "ja-JP", "license": "local-evaluation-only", "consent": "unverified", "annotationStatus": "provisional", "purpose": "speech-separation-evaluation"}


def _references(rows: Column) -> Column:
    """The speakers of a case in order of their first segment, each with its whole text and its segments."""
    timed = F.array_sort(F.transform(rows, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["who"].alias("who"), r["t"].alias("t"))))
    one = lambda own, who: F.struct(
        who.alias("speaker"), F.array_join(F.transform(own, lambda r: r["t"]), "").alias("text"),
        F.transform(own, lambda r: F.struct(round6(r["s"]).alias("start"), round6(r["e"]).alias("end"), r["t"].alias("text"))).alias("segments"),
    )
    return F.transform(F.array_distinct(F.transform(timed, lambda r: r["who"])), lambda w: one(F.filter(timed, lambda r: r["who"] == w), w))


def prepare(lines: DataFrame, recordings: DataFrame, dataset: dict[str, str] | None = None, most: float = 10.0, max_cases: int | None = None, at: Column | None = None) -> DataFrame:
    """EV-03: (recording_id, manifest JSON, cases, skipped, warnings, faults) for each of ``recordings`` (recording_id, name, audio, transcript).

    ``lines``: recording_id, line_no, line. Ids are made safe from ``name``. Cases stand in order of their overlaps and are numbered; after the
    ``max_cases``-th of a recording nothing more is taken or counted as skipped. ``at``: time of preparation (default: now). A recording
    without lines has an empty manifest.
    """
    parsed = written(parse_transcript(lines), "lines")
    warned = parsed.where("warning IS NOT NULL").groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("line"), F.col("warning").alias("reason")))).alias("_warned"))
    segs = parsed.where((F.col("warning").isNull()) & (F.trim("speaker") != "") & (normalize_text(F.col("text")) != ""))
    segs = segs.select("recording_id", F.col("line_no").alias("seg_id"), F.trim("speaker").alias("speaker"), "start_s", "end_s", F.trim("text").alias("text"))
    found = built_cases(segs, max(1.0, most)).select(
        "recording_id", "o0", "o1", "start_s", "end_s", "reason", F.col("speakers").cast("int").alias("speakers"), F.when(F.col("reason").isNull(), _references(F.col("rows"))).alias("references")
    )
    every = found.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("o0", "o1", "start_s", "end_s", "reason", "speakers", "references"))).alias("_all"))
    sizes = segs.groupBy("recording_id").agg(F.count("*").alias("_segments"))
    cores = detect_overlaps(segs).groupBy("recording_id").agg(F.count("*").alias("_cores"))
    d = recordings.select("recording_id", safe_id(F.col("name")).alias("_id"), "audio", "transcript")
    for other in (every, warned, sizes, cores):
        d = d.join(other, "recording_id", "left")
    good = F.filter(F.coalesce("_all", F.array()), lambda c: c["reason"].isNull())
    good = good if max_cases is None else F.slice(good, 1, max(1, int(max_cases)))
    d = d.withColumn("_good", good)
    last = F.element_at("_good", -1)["o0"]
    enough = F.lit(False) if max_cases is None else (F.size("_good") >= max(1, int(max_cases)))
    d = d.withColumn("_bad", F.filter(F.coalesce("_all", F.array()), lambda c: c["reason"].isNotNull() & (~enough | (c["o0"] < last))))
    case = lambda c, i: F.struct(
        F.concat("_id", F.lit("-overlap-"), F.lpad((i + 1).cast("string"), F.greatest(F.lit(3), F.length((i + 1).cast("string"))), F.lit("0"))).alias("id"), round6(c["start_s"]).alias("start"), round6(c["end_s"]).alias("end"),
        round6(c["o0"]).alias("overlapStart"), round6(c["o1"]).alias("overlapEnd"), c["references"].alias("references"), F.lit("utterance").alias("annotationGranularity"),
    )
    long = lambda c: c["reason"] == "case-too-long"
    skip = lambda c: F.struct(
        round6(F.when(long(c), c["start_s"]).otherwise(c["o0"])).alias("start"), round6(F.when(long(c), c["end_s"]).otherwise(c["o1"])).alias("end"), c["reason"].alias("reason"),
        F.when(~long(c), c["speakers"]).alias("speakers"), F.when(long(c), round6(c["end_s"] - c["start_s"])).alias("duration"),
    )
    d = d.withColumns({"_cases": F.transform("_good", case), "_skipped": F.transform("_bad", skip)})
    none = F.array().cast("array<struct<line:bigint,reason:string>>")
    manifest = F.struct(
        F.lit(VERSION).alias("schemaVersion"), F.struct(*(F.lit((dataset or {}).get(k, v)).alias(k) for k, v in DATASET.items())).alias("dataset"),
        F.array(F.struct(F.col("_id").alias("id"), "audio", F.col("transcript").alias("sourceTranscript"), F.col("_cases").alias("cases"))).alias("recordings"),
        F.struct(
            F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt"), F.lit(PARSER).alias("parser"), F.coalesce("_segments", F.lit(0)).alias("sourceSegments"),
            F.coalesce("_cores", F.lit(0)).alias("detectedOverlapIntervals"), F.size("_cases").alias("generatedCases"), F.col("_skipped").alias("skipped"), F.coalesce("_warned", none).alias("warnings"),
        ).alias("preparation"),
    )
    out = written(d.select("recording_id", "audio", "_id", "_cases", F.to_json(manifest).alias("manifest"), F.size("_cases").cast("long").alias("cases"), F.size("_skipped").cast("long").alias("skipped"), F.coalesce(F.size("_warned"), F.lit(0)).cast("long").alias("warnings")), "manifests")
    ref = lambda i, f: F.try_element_at("c.references", F.lit(i))[f]
    rows = out.select(F.col("_id").alias("recording_id"), "audio", F.explode("_cases").alias("c")).select(
        "recording_id", "audio", F.col("c.id").alias("case_id"), F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"), F.col("c.overlapStart").alias("overlap_start"), F.col("c.overlapEnd").alias("overlap_end"),
        ref(1, "speaker").alias("speaker_a"), ref(1, "text").alias("text_a"), ref(2, "speaker").alias("speaker_b"), ref(2, "text").alias("text_b"), F.size("c.references").alias("n_references"),
    )
    faults = validate_cases(rows).groupBy(F.col("recording_id").alias("_id")).agg(F.array_sort(F.collect_set(F.concat_ws(": ", "case_id", "fault"))).alias("faults"))
    out = out.join(faults, "_id", "left")
    return out.select("recording_id", "manifest", "cases", "skipped", "warnings", F.coalesce("faults", F.array().cast("array<string>")).alias("faults"))


def publish(prepared: DataFrame, path: str) -> None:
    """SNK-10: each manifest as a file, in a folder for its recording below a new folder. Any fault is an error before anything is written."""
    bad = prepared.where(F.size("faults") > 0).select("recording_id", "faults").head(3)
    if bad:
        raise ValueError("faulty manifests: " + "; ".join(f"{r.recording_id}: {', '.join(r.faults[:3])}" for r in bad))
    prepared.select("recording_id", F.col("manifest").alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", 1).partitionBy("recording_id").text(path)
