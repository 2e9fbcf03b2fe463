import random
import time

from pyspark.sql import functions as F

from speechlake.functions.alignment import edit_distance
from speechlake.functions.scalars import anchor_similarity, contained, text_similarity, within_edits
from speechlake.operators.gate import gate, separated

SEG = "struct<start_s:double,end_s:double,text:string>"


def test_gate_reasons_additions_and_merge(spark):
    base = [("r", 0.0, 4.0, "good morning everyone"), ("r", 10.0, 12.0, "second part"), ("q", 0.0, 1.0, "alone")]
    one, two = [(0.0, 3.0, "good morning everyone")], [(1.0, 2.0, "not so fast"), (1.1, 2.0, "not so fast"), (3.5, 3.9, "outside core")]
    ok = ([0.5, 0.5], 0.1, 0.5)
    cases = [
        (ok, [one, two], "novel-transcript"), (ok, [one], "invalid-stem-count"), ((None, 0.1, 0.5), [one, two], "missing-metrics"),
        (([0.5, 0.001], 0.1, 0.5), [one, two], "silent-stem"), (([0.5, 0.5], -0.98, 0.5), [one, two], "correlated-stems"),
        (ok, [one, []], "missing-stem-transcript"), (ok, [one, one], "duplicate-stem-transcript"), (([0.5, 0.5], None, None), [one, two], "missing-speaker-embedding"),
        (([0.5, 0.5], 0.1, 0.01), [one, two], "same-speaker-embedding"), (ok, [[(0.0, 3.0, "xxxx")], [(0.0, 3.0, "zzzzzzzzz")]], "unanchored-transcript"),
        (ok, [one, [(3.5, 3.9, "outside core")]], "no-novel-transcript"), (ok, [one, two], "novel-transcript"),
    ]
    rows = [("r", i, 0.0, 4.0, 0.5, 3.0, *m, stems) for i, (m, stems, _) in enumerate(cases)] + [("r", 99, 20.0, 24.0, 20.5, 23.0, *ok, [one, two])]
    windows = spark.createDataFrame(rows, f"recording_id string, window int, start_s double, end_s double, core_start_s double, core_end_s double, shares array<double>, corr double, emb_dist double, stems array<array<{SEG}>>")
    out = separated(spark.createDataFrame(base, "recording_id string, start_s double, end_s double, text string"), windows).collect()
    assert {r.window: r.reason for r in out if r.window is not None} == {i: c[2] for i, c in enumerate(cases)} | {99: "missing-baseline-anchor"}
    merged = [(r.start_s, r.text, r.separated) for r in out if r.window is None and r.recording_id == "r"]
    assert merged == [(0.0, "good morning everyone", False), (1.0, "not so fast", True), (10.0, "second part", False)]
    assert [r.text for r in out if r.recording_id == "q"] == ["alone"]


def plain_separated(base, windows):
    """The rules over lists: reasons by window, and the merged segments."""

    def like(a, b, whole=True):
        if not a or not b:
            return 0.0
        short, long = sorted((len(a), len(b)))
        if a in b or b in a:
            return 1.0 if whole and short >= 4 else short / long
        return 1 - edit_distance(a, b) / long

    bare = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    shared = lambda a, b: min(a[1], b[1]) - max(a[0], b[0])
    same = lambda a, b: shared(a, b) > 0.03 and like(bare(a[2]), bare(b[2])) >= 0.68
    reasons, offered = {}, []
    for n, span, core, shares, corr, dist, stems in windows:
        near = [b for b in base if shared(b, span) > 0 and b[1] > b[0]]
        heard = [s for stem in stems or [] for s in stem]
        new = []
        for s in heard:
            if len(bare(s[2])) >= 2 and shared(s, core) > 0 and not any(same(o, s) for o in near + new):
                new.append(s)
        told = [bare("".join(s[2] or "" for s in stem)) for stem in stems or []]
        checks = {
            "invalid-stem-count": lambda: len(stems or []) != 2, "missing-metrics": lambda: len(shares or []) != 2, "silent-stem": lambda: any(x is None or x < 0.008 for x in shares),
            "correlated-stems": lambda: corr is not None and abs(corr) > 0.97, "missing-stem-transcript": lambda: not all(any(s[2] for s in stem) for stem in stems),
            "duplicate-stem-transcript": lambda: like(*told, whole=False) >= 0.88, "missing-speaker-embedding": lambda: dist is None, "same-speaker-embedding": lambda: dist < 0.08,
            "missing-baseline-anchor": lambda: not near, "unanchored-transcript": lambda: max(like(bare(s[2]), bare(b[2])) for s in heard for b in near) < 0.45, "no-novel-transcript": lambda: not new,
        }
        reasons[n] = next((r for r, fails in checks.items() if fails()), "novel-transcript")
        offered += new if reasons[n] == "novel-transcript" else []
    merged = [(*b[:2], b[2] or "", False) for b in base]
    for s in offered:
        if not any(same(o, s) for o in merged):
            merged.append((*s[:2], s[2] or "", True))
    return reasons, sorted(merged)


def test_gate_and_merge_against_plain_rules(spark):
    r = random.Random(11)
    words = ["good morning", "not so fast", "yes", "second part of it", "a", "", "good evening", "über alles", "so fast", None]
    say = lambda: r.choice(words) if r.random() < 0.6 else " ".join(r.choice(words[:5]) for _ in range(3))
    seg = lambda at: (x := round(at + r.uniform(-1, 4), 2), round(x + r.choice([0.02, 0.5, 2.0]), 2), say())
    base, windows = {}, {}
    for rec in range(12):
        base[rec] = [seg(at) for at in range(0, 30, 3) if r.random() < 0.8]
        windows[rec] = [
            (n, (at - 1.0, at + 4.0), (float(at), at + 3.0), r.choice([None] + [[0.5, 0.5]] * 12 + [[0.5, 0.001], [0.5]]), r.choice([None, 0.1, 0.1, 0.1, 0.99]), r.choice([None] + [0.5] * 9 + [0.01]),
             [[seg(at) for _ in range(r.choice([0, 1, 1, 2, 3]))] for _ in range(r.choice([1, 2, 2, 2, 2, 2, 2, 3]))])
            for n, at in enumerate(range(0, 30, 2))
        ]
    rows = [(rec, n, *span, *core, *m) for rec, ws in windows.items() for n, span, core, *m in ws]
    kind = f"recording_id long, window int, start_s double, end_s double, core_start_s double, core_end_s double, shares array<double>, corr double, emb_dist double, stems array<array<{SEG}>>"
    d = spark.createDataFrame([(rec, *b) for rec, bs in base.items() for b in bs], "recording_id long, start_s double, end_s double, text string")
    out = separated(d, spark.createDataFrame(rows, kind)).collect()
    for rec in base:
        reasons, merged = plain_separated(base[rec], windows[rec])
        assert {x.window: x.reason for x in out if x.recording_id == rec and x.window is not None} == reasons
        assert sorted((x.start_s, x.end_s, x.text, x.separated) for x in out if x.recording_id == rec and x.window is None) == merged
    assert len({x.reason for x in out}) > 9 and sum(bool(x.separated) for x in out) > 10


def test_additions_say_where_they_are_from(spark):
    base = spark.createDataFrame([(1, 0.0, 4.0, "good morning everyone")], "recording_id long, start_s double, end_s double, text string")
    stems = [[(0.0, 3.0, "good morning everyone")], [(1.0, 2.0, "not so fast")]]
    rows = [(1, 7, 0.0, 4.0, 0.5, 3.0, [0.5, 0.5], 0.1, 0.5, stems, ["ann", "bob"], [0.9, 0.4])]
    kind = f"recording_id long, window int, start_s double, end_s double, core_start_s double, core_end_s double, shares array<double>, corr double, emb_dist double, stems array<array<{SEG}>>, speaker_hints array<string>, confidences array<double>"
    out = separated(base, spark.createDataFrame(rows, kind)).collect()
    assert [(r.text, r.from_window, r.stem, r.speaker_hint, r.confidence) for r in out if r.window is None] == [("good morning everyone", None, None, None, None), ("not so fast", 7, 1, "bob", 0.4)]


def test_texts_are_compared_only_where_no_earlier_rule_decides(spark):
    r = random.Random(5)
    long = ["".join(r.choices("abcdefgh", k=60_000)) for _ in range(3)]
    base = spark.createDataFrame([("r", 0.0, 4.0, long[0])], "recording_id string, start_s double, end_s double, text string")
    rows = [("r", i, 0.0, 4.0, 0.5, 3.0, shares, 0.1, dist, [[(0.0, 3.0, long[1])], [(0.5, 3.0, other)]]) for i, (shares, dist, other) in enumerate([(None, 0.5, long[2]), ([0.5, 0.001], 0.5, long[2]), ([0.5, 0.5], 0.01, long[1])])]
    windows = spark.createDataFrame(rows, f"recording_id string, window int, start_s double, end_s double, core_start_s double, core_end_s double, shares array<double>, corr double, emb_dist double, stems array<array<{SEG}>>")
    began = time.time()
    assert [(x.window, x.reason, x.added) for x in gate(base, windows).orderBy("window").collect()] == [(0, "missing-metrics", []), (1, "silent-stem", []), (2, "duplicate-stem-transcript", [])]
    assert time.time() - began < 15  # with all pairs aligned the test was not done in 90 s


def test_deciding_a_similarity_equals_comparing_it(spark):
    r = random.Random(8)
    text = lambda: "".join(r.choices("abé", k=r.choice([0, 1, 2, 3, 4, 5, 8, 20])))
    pairs = [(text(), text()) for _ in range(3000)]
    pairs += [(a, a[: r.randrange(len(a) + 1)] + r.choice(["", "a", "xyz"])) for a, _ in pairs]
    d, a, b = spark.createDataFrame(pairs, "a string, b string"), F.col("a"), F.col("b")
    for least in (0.45, 0.68, 0.88, 0.5, 1.0):
        found = d.select((contained(a, b, least) | within_edits(a, b, least)).alias("x"), (anchor_similarity(a, b) >= least).alias("y"), (contained(a, b, least, False) | within_edits(a, b, least)).alias("z"), (text_similarity(a, b) >= least).alias("w"))
        assert found.where("not (x <=> y) or not (z <=> w)").count() == 0 and 0 < found.where("x").count() < len(pairs)
