"""Separated speech: which windows' stems are let in, and what they add to a transcript (CN-10 to CN-12, CN-14).

The gate is one ordered CASE over each window and the base segments near it, which a range join brings into its row. Texts are compared inside the
row, and only where no cheaper rule has decided. Base segments rule an addition out whatever the order; only among additions that overlap
each other does the order decide, and that fold runs inside a row over few of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contained, normalize_text, normalize_texts, within_edits
from ..sources.shared import written
from .intervals import detect_overlaps, islands, range_join, separation_windows

#: Limits of the gate (fixed values): a silent stem's share, correlated stems, equal transcripts, one speaker's embeddings, the least likeness to
#: the base, and what counts as the same speech: alike, and at once for so many seconds. An addition has this many characters at least.
SILENT, CORRELATED, DUPLICATE, SAME_SPEAKER, ANCHORED, ALIKE, SHARED_S, LEAST_CHARS = 0.008, 0.97, 0.88, 0.08, 0.45, 0.68, 0.03, 2


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _shared(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.least(a[1], b[1]) - F.greatest(a[0], b[0])


def _at_once(o: Column, s: Column) -> Column:
    return _shared((o["start_s"], o["end_s"]), (s["start_s"], s["end_s"])) > SHARED_S


def _same(o: Column, s: Column) -> Column:
    """Whether two segments (structs) are the same speech."""
    said = contained(o["norm"], s["norm"], ALIKE) | within_edits(o["norm"], s["norm"], ALIKE)
    return F.when(_at_once(o, s), said).otherwise(False)


def _novel(segments: Column) -> Column:
    """CN-11 in the row: of segments in order, those that aren't the same speech as one kept before."""
    keep = lambda kept, s: F.when(F.exists(kept, lambda o: _same(o, s)), kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(segments, F.slice(segments, 1, 0), keep)


def _either(first: Column, second: Column) -> Column:
    """Whether one of two conditions holds; the second, dear one is looked at only where the first doesn't."""
    return F.when(first, True).otherwise(F.coalesce(second, F.lit(False)))


def _anchored() -> Column:
    """Whether a heard segment is like a near one."""
    some = lambda rule: F.exists("_heard", lambda s: F.exists("_near", lambda o: rule(s["norm"], o["norm"], ANCHORED)))
    return _either(some(contained), some(within_edits))


def _known(s: Column) -> Column:
    """Whether a near segment is the same speech."""
    some = lambda rule: F.exists("_near", lambda o: _at_once(s, o) & rule(s["norm"], o["norm"], ALIKE))
    return _either(some(contained), some(within_edits))


def _failed() -> Column:
    """CN-10: the first rule that a window fails before it is asked what it adds. Rules are looked at in order, so texts are compared only where
    nothing before them decides."""
    texts = [F.coalesce(F.array_join(F.get("stems", F.lit(i))["text"], ""), F.lit("")) for i in (0, 1)]
    shares, told = F.col("shares"), [F.col("_text0"), F.col("_text1")]
    rules = [
        ("invalid-stem-count", F.coalesce(F.size("stems"), F.lit(-1)) != 2), ("missing-metrics", F.coalesce(F.size(shares), F.lit(-1)) != 2),
        ("silent-stem", F.exists(shares, lambda x: ~_finite(x) | (x < SILENT))), ("correlated-stems", _finite(F.col("corr")) & (F.abs("corr") > CORRELATED)),
        ("missing-stem-transcript", (texts[0] == "") | (texts[1] == "")), ("duplicate-stem-transcript", _either(contained(*told, DUPLICATE, False), within_edits(*told, DUPLICATE))),
        ("missing-speaker-embedding", ~_finite(F.col("emb_dist"))), ("same-speaker-embedding", F.col("emb_dist") < SAME_SPEAKER),
        ("missing-baseline-anchor", F.coalesce((F.size("_heard") <= 0) | (F.size("_near") <= 0), F.lit(True))), ("unanchored-transcript", ~_anchored()),
    ]
    return reduce(lambda case, rule: F.when(F.coalesce(rule[1], F.lit(False)), rule[0]).otherwise(case), reversed(rules), F.lit(None).cast("string"))


def gate(base: DataFrame, windows: DataFrame) -> DataFrame:
    """CN-10, CN-11: the windows with their ``reason`` and ``added`` segments (array of place, stem, start_s, end_s, text, norm), empty unless it is novel-transcript.

    ``base``: recording_id, start_s, end_s, text. ``windows``: recording_id, window (a number of its own in its recording), start_s, end_s, core_start_s,
    core_end_s, shares, corr, emb_dist and stems (array of arrays of start_s, end_s, text). Null texts count as empty.
    """
    key = ["recording_id", "window"]
    b = base.select("recording_id", "start_s", "end_s", normalize_text(F.col("text")).alias("norm"))
    near = range_join(windows.select(*key, "start_s", "end_s"), b)
    near = near.groupBy(*key).agg(F.collect_list(F.struct(*(F.col(f"r_{c}").alias(c) for c in ("start_s", "end_s", "norm")))).alias("_near"))
    numbered = F.transform("stems", lambda x, i: F.transform(x, lambda s: F.struct(i.alias("stem"), s["start_s"].alias("start_s"), s["end_s"].alias("end_s"), F.coalesce(s["text"], F.lit("")).alias("text"))))
    # the texts of all segments, and after them those of the two stems as a whole
    whole = F.array(*(F.coalesce(F.array_join(F.get("stems", F.lit(i))["text"], ""), F.lit("")) for i in (0, 1)))
    d = windows.withColumn("_segments", F.flatten(numbered))
    d = d.withColumn("_norms", normalize_texts(F.concat(F.coalesce(F.col("_segments")["text"], F.array().cast("array<string>")), whole)))
    d = d.withColumns({f"_text{i}": F.element_at("_norms", i - 2) for i in (0, 1)})
    d = d.withColumn("_heard", F.transform("_segments", lambda s, i: F.struct(i.alias("place"), *(s[c].alias(c) for c in ("stem", "start_s", "end_s", "text")), F.get("_norms", i).alias("norm"))))
    d = d.drop("_segments", "_norms").join(near, key, "left").withColumn("_failed", _failed())
    in_core = lambda s: (F.length(s["norm"]) >= LEAST_CHARS) & (_shared((s["start_s"], s["end_s"]), (F.col("core_start_s"), F.col("core_end_s"))) > 0)
    fresh = F.filter("_heard", lambda s: F.when(in_core(s), ~_known(s)).otherwise(False))
    d = d.withColumn("_fresh", F.when(F.size("_heard") > 0, F.when(F.col("_failed").isNull(), fresh).otherwise(F.slice("_heard", 1, 0))))
    d = d.withColumn("added", _novel(F.col("_fresh")))
    new = F.when(F.size("added") > 0, "novel-transcript").otherwise("no-novel-transcript")
    return d.withColumn("reason", F.coalesce("_failed", new)).drop("_text0", "_text1", "_heard", "_near", "_fresh", "_failed")


def separated(base: DataFrame, windows: DataFrame) -> DataFrame:
    """CN-10 to CN-12: (recording_id, window, reason, start_s, end_s, text, separated, from_window, stem, speaker_hint, confidence), in order of time
    within a recording.

    One row per window has its reason; the merged segments have a null window: all of the base, and additions that neither the base nor an
    earlier addition has. An addition says which window and stem it is from and, where windows have the arrays speaker_hints and confidences
    (one value a stem), whose voice it may be and how sure that is. Other columns as in ``gate``.
    """
    judged = written(gate(base, windows), "gate")
    of_stem = lambda c, kind: F.get(F.col(c), F.col("s.stem")) if c in windows.columns else F.lit(None).cast(kind)
    said_by = [of_stem("speaker_hints", "int").alias("speaker_hint"), of_stem("confidences", "double").alias("confidence")]
    new = judged.select("*", F.explode("added").alias("s")).select("recording_id", "window", F.col("start_s").alias("_from"), F.col("end_s").alias("_to"), "s.*", *said_by)
    key = ["recording_id", "window", "place"]
    b = base.select("recording_id", "start_s", "end_s", normalize_text(F.col("text")).alias("norm"))
    # the gate has compared additions with what lies in their window; what is left is base segments outside of it
    outside = ~F.coalesce((F.col("_to") > F.col("_from")) & (F.col("r_end_s") > F.col("_from")) & (F.col("r_start_s") < F.col("_to")), F.lit(False))
    met = range_join(new, b).where(outside).where(_shared((F.col("start_s"), F.col("end_s")), (F.col("r_start_s"), F.col("r_end_s"))) > SHARED_S)
    said = met.where(_either(contained(F.col("norm"), F.col("r_norm"), ALIKE), within_edits(F.col("norm"), F.col("r_norm"), ALIKE)))
    new = new.join(said.select(*key).distinct(), key, "left_anti").drop("_from", "_to")
    # the same speech overlaps, so only additions of one island of time can be each other's
    rows = F.array_sort(F.collect_list(F.struct("window", "place", "stem", "start_s", "end_s", "text", "norm", "speaker_hint", "confidence")))
    kept = islands(new, 0.0).groupBy("recording_id", "island").agg(rows.alias("rows")).select("recording_id", F.explode(_novel(F.col("rows"))).alias("s"))
    kept = written(kept, "kept")  # sorting looks at its rows twice
    row = lambda d, window, reason, s, separated: d.select(
        "recording_id", window.cast("int").alias("window"), reason.cast("string").alias("reason"), *((F.col(s + c) if s is not None else F.lit(None)).cast(t).alias(c) for c, t in (("start_s", "double"), ("end_s", "double"), ("text", "string"))),
        F.lit(separated).cast("boolean").alias("separated"), *((F.col("s." + c) if separated else F.lit(None).cast(t)).alias(n) for c, n, t in told),
    )
    hint = new.schema["speaker_hint"].dataType.simpleString()
    told = [("window", "from_window", "int"), ("stem", "stem", "int"), ("speaker_hint", "speaker_hint", hint), ("confidence", "confidence", "double")]
    none = F.lit(None)
    segments = row(base.withColumn("text", F.coalesce("text", F.lit(""))), none, none, "", False).unionByName(row(kept, none, none, "s.", True))
    every = segments.unionByName(row(judged, F.col("window"), F.col("reason"), None, None))
    return every.orderBy("recording_id", F.col("window").asc_nulls_last(), "start_s", "end_s", "separated")


def separation_pass(tracks: DataFrame, base: DataFrame, durations: DataFrame, separate) -> DataFrame:
    """CN-14: where speakers overlap, windows are separated, and what the gate lets in is merged into the base segments.

    ``separate`` takes windows (recording_id, idx, start_s, end_s, overlap_start, overlap_end) and adds shares, corr, emb_dist and stems, as
    ``gate`` has them.
    """
    windows = separation_windows(detect_overlaps(tracks), durations)
    named = separate(windows).withColumnRenamed("idx", "window").withColumnRenamed("overlap_start", "core_start_s").withColumnRenamed("overlap_end", "core_end_s")
    return separated(base, named.withColumn("window", F.col("window").cast("int")))
