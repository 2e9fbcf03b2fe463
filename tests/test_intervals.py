import random

import pytest
from pyspark.sql import functions as F

from speechlake.functions import scalars as S
from speechlake.operators import consensus as C
from speechlake.operators import intervals as I

SEG = "recording_id long, seg_id long, speaker string, start_s double, end_s double"


def segs(spark, *rows):
    return spark.createDataFrame([(1, i, str(s), float(a), float(b)) for i, (a, b, s) in enumerate(rows)], SEG)


def spans(df):
    return sorted((round(r.start_s, 6), round(r.end_s, 6)) for r in df.collect())


def test_strict_split_golden(spark):
    out = spans(I.strict_split(segs(spark, (0, 7.2, "a")), 3.0))
    assert len(out) >= 3 and all(b - a <= 3 + 1e-6 for a, b in out) and all(x[1] > y[0] for x, y in zip(out, out[1:], strict=False))
    out = spans(I.strict_split(segs(spark, (0, 6.45, "a")), 6.0))
    assert out[-1][1] - out[-1][0] >= 0.8 - 1e-9
    with pytest.raises(ValueError):
        I.strict_split(segs(spark, (0, 1, "a")), 0.6)


def test_strict_split_covers_its_input(spark):
    r = random.Random(4)
    rows = [(a := r.uniform(0, 50), a + r.uniform(0, 40), "x") for _ in range(300)] + [(5, 5, "x"), (6, 4, "x")]
    d = segs(spark, *rows)
    got = {}
    for x in I.strict_split(d, 6.0).collect():
        got.setdefault(x.seg_id, []).append((x.start_s, x.end_s))
    for i, (a, b, _) in enumerate(rows):
        p = sorted(got.get(i, []))
        if b - a < 0.05:
            assert not p
            continue
        assert p[0][0] == pytest.approx(a, abs=1e-6) and p[-1][1] == pytest.approx(b, abs=1e-6)
        assert all(y - x <= 6 + 2e-6 for x, y in p) and all(n[0] <= q[1] <= n[0] + 0.18 + 2e-6 for q, n in zip(p, p[1:], strict=False))


def test_overlap_golden_and_islands_apart(spark):
    assert spans(I.detect_overlaps(segs(spark, (0.6, 3.37, "s0"), (2.78, 5.21, "s1")))) == [(2.78, 3.37)]
    r = random.Random(5)
    out = spans(I.detect_overlaps(segs(spark, *((a := r.uniform(0, 300), a + r.uniform(0, 9), r.choice("abc")) for _ in range(200)))))
    assert all(n[0] > p[1] + 0.02 - 1e-9 for p, n in zip(out, out[1:], strict=False))
    assert I.detect_overlaps(segs(spark, (0, 5, "a"), (1, 4, "a"))).count() == 0


def test_range_join_meets_each_pair_once(spark):
    r = random.Random(6)
    rows = [(a := r.uniform(0, 1000), a + r.choice([0, 1, 50, 400]), "x") for _ in range(120)]
    got = sorted((x.seg_id, x.r_seg_id) for x in I.range_join(segs(spark, *rows), segs(spark, *rows)).collect())
    want = sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] > a[0] and b[1] > b[0] and a[1] > b[0] and a[0] < b[1])
    assert got == want


def test_halo_chunks_golden(spark):
    out = I.halo_chunks(spark.createDataFrame([(1, 125.0), (2, 0.0)], "recording_id long, duration double"), 60.0, 2.0).orderBy("idx").collect()
    assert [(r.start_s, r.end_s, r.core_start, r.core_end) for r in out] == [(0, 62, 0, 60), (58, 122, 60, 120), (118, 125, 120, 125)]


def test_separation_windows_golden(spark):
    total = spark.createDataFrame([(1, 30.0)], "recording_id long, duration double")
    out = I.separation_windows(segs(spark, (2, 2.8, ""), (3, 3.7, ""), (18, 19, "")).select("recording_id", "start_s", "end_s"), total).orderBy("idx").collect()
    assert len(out) == 2 and (out[0].start_s, out[0].end_s, out[0].overlap_start, out[0].overlap_end) == (1, 4.7, 2, 3.7)
    out = I.separation_windows(segs(spark, (1, 24, "")).select("recording_id", "start_s", "end_s"), total).collect()
    assert len(out) >= 3 and all(r.end_s - r.start_s <= 10 for r in out)


def test_anchors_avoid_overlaps(spark):
    tracks = segs(spark, (0, 2.8, "a"), (2.2, 6, "b"), (6.5, 8, "a"), (7.5, 9.5, "b"))
    holes = I.detect_overlaps(tracks)
    w = I.separation_windows(holes, spark.createDataFrame([(1, 10.0)], "recording_id long, duration double"))
    out = I.anchors(w, tracks, holes).collect()
    hs = spans(holes)
    assert len(out) >= 2 and all(r.end_s - r.start_s <= 3 and r.rank <= 2 and all(r.end_s <= h[0] + 1e-6 or r.start_s >= h[1] - 1e-6 for h in hs) for r in out)


def test_select_and_shift_golden(spark):
    d = spark.createDataFrame([("before", 0.0, 2.0), ("crossing-start", 1.0, 3.0), ("inside", 3.0, 4.0), ("point", 5.0, None), ("after", 5.0, 6.0)], "n string, start_s double, end_s double")
    assert {r.n for r in I.select_range(d, 2.0, 5.0).collect()} == {"crossing-start", "inside"}
    assert spans(I.shift(d.where("n = 'inside'"), 118.5)) == [(121.5, 122.5)] and spans(I.shift(d.where("n = 'inside'"), -10.0)) == [(0, 0)]


def test_decode_window_golden(spark):
    w = I.decode_window(F.col("s"), F.col("d"), F.col("c"))
    d = spark.createDataFrame([(0.0, 60.0, None), (120.0, 60.0, None), (-5.0, 999.0, 9.0)], "s double, d double, c double").select(*(c.alias(n) for n, c in w.items()))
    assert [tuple(r) for r in d.collect()] == [(0, 61.5, 0, 60), (118.5, 63, 1.5, 61.5), (0, 183, 0, 180)]


def test_recognition_plan_golden(spark):
    vad, tracks = segs(spark, (2.47, 5.212, "")), segs(spark, (0.605, 3.372, "0"), (2.782, 5.212, "1"))
    base = C.base_items(vad, 3.0)
    rep = C.repair_spans(base, tracks, I.detect_overlaps(tracks), 3.0)
    v = C.variants(rep).collect()
    assert base.count() == 1 and any(r.speaker == "1" for r in v) and any(r.tier == "extended" for r in v)
    assert sum(r.tier == "primary" for r in v) <= 6
    quiet = segs(spark, (5.286, 6.78, "")), segs(spark, (5.279, 9.278, "0"), (6.325, 6.68, "1"))
    assert C.repair_spans(C.base_items(quiet[0]), quiet[1], I.detect_overlaps(quiet[1])).count() == 0


def test_consensus_and_expansion_golden(spark):
    d = spark.createDataFrame([("r0", 0, "おはよう"), ("r0", 1, "おはよう"), ("r0", 2, "おはよ"), ("r1", 0, "あいう"), ("r1", 1, "かきく"), ("r1", 2, "さしす"), ("r2", 0, " "), ("r2", 1, None)], "g string, ord int, text string")
    won = C.consensus(d, ["g"])
    assert {r.g: (r.text, r.votes) for r in won.collect()}["r0"] == ("おはよう", 2)
    assert {r.g for r in C.needs_expansion(d, won, ["g"]).collect()} == {"r1", "r2"}


def test_finalize_golden(spark):
    won = spark.createDataFrame([("g", 0, "a", 0.9, 0.5, "short"), ("g", 1, "b", 0.8, 3.0, "どうしようどうしよう")], "group_id string, repair_id int, speaker string, consensus double, span_s double, text string")
    base = spark.createDataFrame([("g", "base"), ("h", " only "), ("i", " ")], "group_id string, text string")
    assert sorted((r.group_id, r.text, r.recovered) for r in C.finalize(won, base).collect()) == [("g", "どうしようどうしよう", True), ("h", "only", False)]


def test_gate_reasons(spark):
    cols = [F.lit(x) for x in (0.5, 0.1, 0.3)]
    reason = lambda **k: spark.range(1).select(C.gate_reason(*(k.get(n, c) for n, c in zip(("share", "corr", "emb"), cols, strict=True)), k.get("no_text", F.lit(False)), k.get("no_anchor", F.lit(False)))).first()[0]
    assert reason() == "accepted" and reason(share=F.lit(0.001)) == "silent-stem" and reason(corr=F.lit(-0.99)) == "correlated-stems" and reason(emb=F.lit(0.01)) == "same-speaker-embedding"


def test_thread_budget_golden(spark):
    d = spark.createDataFrame([(16, 4), (4, 3), (16, 1)], "c int, w int").select(S.diarization_threads(F.col("c"), F.col("w")))
    assert [r[0] for r in d.collect()] == [3, 1, 4]


def test_overlaps_by_sweep_equal_merged_pairs(spark):
    r = random.Random(21)
    rows, n = [], 0
    for rec in range(20):
        for _ in range(r.choice([1, 20, 60])):
            start = r.randrange(0, 2000) / 8
            rows.append((rec, r.choice([1, 2, 3, None]), n, start, start + r.choice([0, 1, 2, 8, 40, 90]) / 8))
            n += 1
    d = spark.createDataFrame(rows, "recording_id long, speaker int, seg_id long, start_s double, end_s double")
    for least, span in ((0.125, 600.0), (0.25, 7.0), (1.0, 0.5)):
        got = sorted(map(tuple, I.detect_overlaps(d, least, 0.0625, span).collect()))
        assert got == sorted(map(tuple, I.merge(I.overlap_pairs(d, least), 0.0625).collect())) and len(got) > 10
