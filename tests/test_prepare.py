"""Manifests from transcripts to files and back."""

import json

import pytest
from pyspark.sql import functions as F

from speechlake.operators import evaluation as E
from speechlake.operators import prepare as R
from speechlake.sources import media as M

LINES = {
    1: ["[00:00:00 --> 00:00:04] B: first words", "[00:00:03 --> 00:00:06] A: over it", "no time", "[00:00:05 --> 00:00:07] B: again", "[00:00:20 --> 00:00:24] A: x", "[00:00:22 --> 00:00:26] B: y", "[00:00:23 --> 00:00:25] C: z",
        "[00:01:00 --> 00:01:20] A: long", "[00:01:10 --> 00:01:12] B: short", "[00:02:00 --> 00:02:03] A: 日本", "[00:02:02 --> 00:02:04] B: 語"],
    2: ["[00:00:00 --> 00:00:04] A: alone", "bad"],
}


def inputs(spark):
    rows = [(r, i, t) for r, ls in LINES.items() for i, t in enumerate(ls)]
    lines = spark.createDataFrame(rows, "recording_id long, line_no long, line string")
    recs = spark.createDataFrame([(1, " My: call 1 ", "a/1.wav", "a/1.txt"), (2, "two", "2.wav", "2.txt"), (3, None, "3.wav", "3.txt")], "recording_id long, name string, audio string, transcript string")
    return lines, recs


def test_manifests(spark, tmp_path):
    d = R.prepare(*inputs(spark), {"name": "mine"}, at=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = {r.recording_id: r for r in d.collect()}
    assert {k: (r.cases, r.skipped, r.warnings, r.faults) for k, r in got.items()} == {1: (3, 2, 1, []), 2: (0, 0, 1, []), 3: (0, 0, 0, [])}
    m = json.loads(got[1].manifest)
    assert m["schemaVersion"] == 1 and m["dataset"]["name"] == "mine" and m["dataset"]["language"] == "ja-JP"
    rec = m["recordings"][0]
    assert (rec["id"], rec["audio"], rec["sourceTranscript"]) == ("My-call-1", "a/1.wav", "a/1.txt")
    one, again, two = rec["cases"]
    assert [tuple(c[k] for k in ("id", "start", "end", "overlapStart", "overlapEnd")) for c in (one, again)] == [("My-call-1-overlap-001", 0, 6, 3, 4), ("My-call-1-overlap-002", 3, 7, 5, 6)]
    assert [r["speaker"] for r in one["references"]] == ["B", "A"] and [r["speaker"] for r in again["references"]] == ["A", "B"]
    assert [(r["speaker"], r["text"], len(r["segments"])) for r in two["references"]] == [("A", "日本", 1), ("B", "語", 1)] and two["annotationGranularity"] == "utterance"
    p = m["preparation"]
    assert p["generatedAt"] == "2024-01-02T03:04:05.000Z" and p["sourceSegments"] == 10 and p["generatedCases"] == 3 and [x["reason"] for x in p["skipped"]] == ["not-exactly-two-speakers", "case-too-long"] and p["warnings"] == [{"line": 2, "reason": "no-time"}]
    R.publish(d, f"file://{tmp_path}/m")
    back = M.read_manifests(spark, f"file://{tmp_path}/m/*")
    assert back.where("case_id IS NOT NULL").count() == 3 and E.validate_cases(back.where("case_id IS NOT NULL")).count() == 0
    with pytest.raises(Exception):
        R.publish(d, f"file://{tmp_path}/m")


def test_most_cases_and_faults(spark, tmp_path):
    d = R.prepare(*inputs(spark), max_cases=1).where("recording_id = 1").first()
    assert (d.cases, d.skipped) == (1, 0)
    lines, recs = inputs(spark)
    bad = R.prepare(lines, recs.withColumn("audio", F.lit(" ")))
    assert [len(r.faults) for r in bad.orderBy("recording_id").collect()] == [3, 0, 0]
    with pytest.raises(ValueError, match="no-audio"):
        R.publish(bad, f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()
