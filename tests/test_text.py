import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.functions import alignment as L
from speechlake.functions import scalars as S
from speechlake.operators import evaluation as E
from speechlake.operators import signal as G
from speechlake.operators import corrections as K
from speechlake.operators import transcript as T
from speechlake.operators import tuning as U
from speechlake.operators import vectors as V
from speechlake.sources import media
from speechlake.streaming import segmenter as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_golden(spark):
    assert one(spark, S.normalize_text(F.lit(" 今日は、ＡＩです。\n"))) == "今日はaiです" and one(spark, S.normalize_text(F.lit(None).cast("string"))) == ""


def test_scores_and_clocks(spark):
    d = spark.createDataFrame([("abcdef", "abc"), ("abc", "abcdef"), ("", "x")], "r string, h string").withColumn("s", L.edit_stats_udf("r", "h"))
    got = d.select(*(c.alias(n) for n, c in S.score(F.col("s"), F.col("r"), F.col("h")).items())).collect()
    assert got[0].weighted_errors == pytest.approx(4.05) and got[1].weighted_errors == 3 and got[2].accuracy == 0
    for text, want in (("01:02:03.5", 3723.5), ("1:60:00", None), ("00:00:60", None), ("x", None), ("100:00:00", 360000)):
        assert one(spark, S.parse_clock(F.lit(text))) == want
    for text, want in (("75", 75), ("2:05", 125), ("1:00:10", 3610), ("2:60", None), ("1:60:00", None), ("", None), ("a", None)):
        assert one(spark, S.parse_trial_start(F.lit(text))) == want
    assert one(spark, S.format_time(F.lit(3661.25))) == "01:01:01,250" and one(spark, S.format_elapsed(F.lit(59.9))) == "00:59" and one(spark, S.format_elapsed(F.lit(3600.0))) == "1:00:00"


def test_transcript_golden(spark):
    lines = ["[00:00:00 --> 00:00:02] A: あいう", "[00:00:01 --> 00:00:03] B：かき", "broken", "[00:00:05 --> 00:00:04] A: x", "[00:00:06 --> 00:00:07] B: ok", ""]
    got = E.parse_transcript(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, line string")).collect()
    assert [r.warning for r in sorted(got)] == [None, None, "no-time", "bad-time", None]
    segs = spark.createDataFrame([(1, r.n, r.speaker, r.start_s, r.end_s, r.text) for r in got if r.warning is None], "recording_id long, seg_id int, speaker string, start_s double, end_s double, text string")
    case = E.overlap_cases(segs).collect()
    assert len(case) == 1 and (case[0].start_s, case[0].end_s, case[0].overlap_start, case[0].overlap_end, case[0].texts) == (0, 3, 1, 2, "あいう/かき")


def test_permutation_metrics_golden(spark):
    texts = lambda *x: F.array(*map(F.lit, x))
    assert tuple(one(spark, E.pit(texts("あいう", "かき"), texts("かき", "あいえ")))) == (1, [1, 0])
    d, swapped = E.pit2(*(F.lit(x) for x in ("あいう", "かき", "かき", "あいえ")))
    assert one(spark, d) == 1 and one(spark, swapped) and one(spark, E.cp2(F.lit("あいう"), F.lit("かき"), F.lit("かきあいう"))) == 0
    c = E.char_coverage(spark.createDataFrame([(1, "あいうかき", "あいうか"), (2, "", ""), (3, None, "x")], "k int, ref string, hyp string"), "k").orderBy("k").collect()
    assert tuple(c[0])[1:6] == (5, 4, 4, 1, 0) and (c[1].matched, c[2].additions) == (0, 1)


def test_merge_and_exports(spark):
    rows = [(1, 0, 0, 0.0, 1.0, "あ。"), (1, 1, 0, 1.0, 2.5, "い"), (1, 2, None, 2.5, 3.0, "う"), (1, 3, None, 3.0, 4.0, "え"), (1, 4, -1, 4.0, 5.0, "お"), (1, 5, -1, 5.0, 6.0, "か"), (1, 6, 0, 6.0, 7.0, ""), (1, 7, 0, 7.0, 6.5, "き")]
    d = spark.createDataFrame(rows, "recording_id long, turn int, spk int, start_s double, end_s double, text string")
    m = T.merge_same_speaker(d).orderBy("run").collect()
    assert [(r.text, r.end_s) for r in m] == [("あ。い", 2.5), ("う", 3.0), ("え", 4.0), ("お", 5.0), ("か", 6.0), ("き", 6.5)]
    srt = T.export(d, "srt").first().content
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,000\n話者1: あ。\n\n2\n") and T.export(d, "vtt").first().content.startswith("WEBVTT\n\n")
    assert "[00:00:04 --> 00:00:05] 話者不明: お" in T.export(d, "txt").first().content and T.export(d, "json", merged=True).count() == 1
    with pytest.raises(ValueError):
        T.export(d, "doc")


def test_interpolation_golden(spark):
    d = spark.createDataFrame([(1, 0, 1.1, 1.7, "ab"), (1, 1, None, None, "cd"), (1, 2, 2.2, 3.0, "ef")], "recording_id long, ord int, start_s double, end_s double, text string")
    got = T.interpolate(d, F.lit(1.1), F.lit(3.0)).orderBy("ord").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(1.1, 1.7), (1.7, 2.2), (2.2, 3.0)]


def test_corrections(spark):
    segs = [{"start_s": 0.0, "end_s": 2.0}, {"start_s": 2.0, "end_s": 4.0}, {"start_s": 3.9, "end_s": 6.0}]
    gone = lambda *rows: set(np.flatnonzero(K.taken(*(np.array([x[c] for x in segs]) for c in ("start_s", "end_s")), *np.array(rows).T)).tolist())
    assert gone((2.1, 3.9)) == {1}
    assert gone((0.0, 4.1)) == {0, 1} and gone((9.0, 9.5)) == set()
    block = "recording_id long, id string, block_start double, block_end double, source_start double, source_end double"
    old = spark.createDataFrame([(1, "a", 0.0, 2.0, None, None), (1, "b", 3.0, 4.0, None, None), (1, "c", 8.0, 9.0, None, None)], block)
    new = spark.createDataFrame([(1, "c", 1.0, 2.5, 1.0, 2.5)], block)
    assert sorted(r.id for r in T.upsert_blocks(old, new).collect()) == ["b", "c"]


def test_folds(spark):
    assert T.trim_repeat("これはどうしよう", "どうしようか") == "か" and T.trim_repeat("ab", "cd") == "cd"
    s = spark.createDataFrame([(1, 0, 0, 9.0), (1, 0, 1, 8.0), (1, 1, 0, 8.5), (1, 1, 1, 0.0)], "recording_id long, cluster int, label int, score double")
    assert [(r.cluster, r.label) for r in T.greedy_map(s).collect()] == [(0, 0)]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"schemaVersion":1,"dataset":{"name":"d"},"recordings":[{"id":"r","audio":"a.wav","cases":[{"id":"c","start":0,"end":3,"overlapStart":1,"overlapEnd":2,'
        '"references":[{"speaker":"A","text":"x"},{"speaker":"B","text":"y"}]},{"id":"c","start":5,"end":3,"overlapStart":1,"overlapEnd":2,"references":[{"speaker":"A","text":"x"}]}]}]}'
    )
    cases = media.read_manifests(spark, f"file://{tmp_path}/m.json")
    assert sorted(r.fault for r in E.validate_cases(cases).collect()) == ["bad-times", "duplicate-case-id", "empty-reference", "not-two-speakers"]


def test_report(spark):
    d = spark.createDataFrame([("d", 0, 1.0, 5, 3, 1, True, 2.0, 500)], "dataset string, snr_db int, overlap_ratio double, reference_chars int, mixture_distance int, separated_distance int, gate_accepted boolean, duration_s double, separation_ms int")
    r = E.case_summary(d).first()
    assert (r.mixture_cer, r.separated_cer, r.cer_delta, r.gate_accepted, r.gate_rate, r.separation_rtf) == (0.6, 0.2, 0.4, 1, 1.0, 0.25)
    assert sorted(x.level for x in E.case_summary(d, [[], ["dataset"], ["snr_db", "overlap_ratio"]]).collect()) == [3, 4, 7]


def test_tuning(spark):
    cur = spark.createDataFrame([(1, 0.0, 6.0, 0.2, 0.15, 0.5, False, 2)], "job_id long, " + ", ".join(f"{c} double" for c in U.FIELDS[:5]) + ", overlap boolean, speakers int")
    for count in (1, 2):
        grid = U.coarse_grid(cur, count).orderBy("candidate").collect()
        assert 8 <= len(grid) <= 12 and grid[0].seed_distance == 0 and len({tuple(r)[3:10] for r in grid}) == len(grid)
    assert 2 <= U.refine_grid(cur, U.coarse_grid(cur, 2)).count() <= 4
    c = spark.createDataFrame([(1, 0, 0.86, 0.86, 0.1, 0.5, 0.0), (1, 1, 0.858, 0.86, 0.1, 0.1, 0.0), (1, 2, 0.5, 0.5, 0.0, 0.0, 0.0)], "job_id long, ord int, score double, accuracy double, deletion_rate double, seed_distance double, cost double")
    assert T.best_candidate(c, "job_id").first().ord == 1 and U.confidence(c, "job_id").first().confidence == "medium"


def test_vectors(spark):
    e = [(i, i // 2, [float(i // 2 == k) + 0.01 * i for k in range(3)]) for i in range(6)]
    d = spark.createDataFrame(e, "vec_id long, label int, embedding array<float>")
    got = V.assign(d, V.centroids(d, "label"), "label", 0.75).collect()
    assert all(r.assigned == r.label for r in got)
    assert {r.assigned for r in V.assign(d, V.centroids(d.limit(0), "label"), "label").collect()} == {-1}
    v = np.array([x[2] for x in e])
    assert V.average_linkage(v, threshold=0.3).tolist() == [0, 0, 1, 1, 2, 2] and V.average_linkage(v, speakers=1).tolist() == [0] * 6 and V.average_linkage(v[:0]).tolist() == []


def test_signals(spark):
    w = G.pcm16_wav(np.array([0.0, 1.5, -1.0, 0.5]))
    assert np.allclose(media.decode_pcm(w), [0, 32767 / 32768, -32767 / 32768, 16384 / 32768]) and len(w) == 52


def test_media_reader(spark, tmp_path):
    x = np.arange(media.CHUNK + 100, dtype="<f4")
    (tmp_path / "a.pcm").write_bytes(x.tobytes())
    (tmp_path / "b.txt").write_text("no")
    d = media.read_media(spark, f"file://{tmp_path}")
    assert sorted((r.chunk, len(r.samples)) for r in d.collect()) == [(0, media.CHUNK), (1, 100)]
    r = media.sample_range(d, media.CHUNK - 2, media.CHUNK + 3).orderBy("chunk").collect()
    assert [s for p in r for s in p.samples] == [float(media.CHUNK + k) for k in range(-2, 3)]
    items = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 1.0001), (2, 0.0, 1.0)], "recording_id long, start_s double, end_s double")
    assert len({x.text for x in media.recognize(items).collect()}) == 2


def test_jobs(spark):
    assert one(spark, F.array_join(S.configured_phases(F.lit(0.5), F.lit(True), F.lit(True)), ",")) == "queued,preparing,decoding,denoising,vad,overlap,recognizing,separating,finalizing"
    for text, code in (("ユーザーが中止しました", "CANCELLED"), ("ENOSPC", "NO_DISK_SPACE"), ("model files are missing", "MODEL_UNAVAILABLE"), ("?", "TRANSCRIBE_FAILED")):
        assert one(spark, S.error_class(F.lit(text))) == code
    for sec, label in ((5.0, "約10秒未満"), (42.0, "約45秒"), (125.0, "約2分10秒"), (301.0, "約6分")):
        assert one(spark, S.eta_label(F.lit(sec))) == label
    jobs = spark.createDataFrame([("q", 1, 0, 0, False), ("q", 2, 1, 1, False), ("q", 3, 2, 2, True), ("q", 1, 3, 3, False)], "queue string, job_id int, submitted int, seq int, cancelled boolean")
    assert sorted((r.job_id, r.position) for r in ST.queue_positions(jobs).collect()) == [(1, 1), (2, 2)]
    status = spark.createDataFrame([(1, 0.0, "recognizing", 0.0, 10.0), (1, 2.0, "recognizing", 2.0, 10.0), (1, 4.0, "recognizing", 5.0, 10.0)], "job_id long, at_s double, phase string, done double, total double")
    assert [r.remaining_s for r in ST.eta(status).orderBy("at_s").collect()][1:] == pytest.approx([8.0, 8 * 0.72 + 4 * 0.28])


def frames(spark):
    r = random.Random(8)
    rows, t = [], 0.0
    for k in range(400):
        rows.append((k % 2, round(t, 3), round(t + 0.1, 3), r.random() < 0.7, k >= 390))
        t += r.choice([0.1, 0.1, 0.4])
    return spark.createDataFrame(rows, "session long, start_s double, end_s double, speech boolean, stop boolean")


def test_stream_equals_batch(spark, tmp_path):
    d = frames(spark)
    want = sorted(tuple(r) for r in ST.segment_batch(d, silence=0.5, least=0.15, most=6.0).collect())
    for k in range(4):  # four files in order of time: four micro-batches
        d.where((F.col("start_s") >= 25.0 * k) & (F.col("start_s") < (25.0 * (k + 1) if k < 3 else 1e9))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ST.segment_stream(stream, silence=0.5, least=0.15, most=6.0).writeStream.format("memory").queryName("segs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("segs").collect()) == want and len(want) > 5
