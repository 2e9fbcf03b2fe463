"""Seeded plans and mixing over chunks against the plain sequential forms."""

import random

import numpy as np
import pytest

from speechlake.operators import mixtures as X


def sequence(seed):
    state = (seed or 1) & 0xFFFFFFFF
    while True:
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state ^= (state << 5) & 0xFFFFFFFF
        yield state / 2**32


def test_a_million_draws_equal_the_sequence():
    plain = sequence(42)
    want = np.fromiter((next(plain) for _ in range(1_000_000)), float)
    assert np.array_equal(X.draws(42, 0, 1_000_000), want)
    for first, n in ((1, 1), (999, 7), (123_456, 70_001), (999_999, 1)):
        assert np.array_equal(X.draws(42, first, n), want[first : first + n])
    assert X.draws(0, 0, 3).tolist() == X.draws(1, 0, 3).tolist() and X.jump(7, 0) == 7


def plain_plan(utts, count, seed, snr=(-6.0, 0.0, 6.0), ratios=(0.25, 0.5, 0.75, 1.0)):
    by = {}
    for i, who, _ in utts:
        by.setdefault(who, []).append(i)
    names, draw, seen, out = list(by), sequence(seed), set(), []
    for _ in range(100 * count):
        x = [next(draw) for _ in range(4)]
        a = names[int(x[0] * len(names))]
        b = [n for n in names if n != a][int(x[1] * (len(names) - 1))]
        u, v = by[a][int(x[2] * len(by[a]))], by[b][int(x[3] * len(by[b]))]
        if frozenset((u, v)) not in seen and len(out) < count:
            seen.add(frozenset((u, v)))
            i = len(out)
            out.append((i, u, v, snr[i % len(snr)], ratios[i // len(snr) % len(ratios)], "ab"[i % 2]))
    return out


def test_plans_equal_one_draw_after_the_other(spark):
    r = random.Random(1)
    for n, speakers, count, seed in ((9, 3, 12, 42), (60, 7, 200, 0), (12, 2, 30, 5)):
        utts = [(f"u{i}", f"s{min(r.randrange(speakers), r.randrange(speakers))}" if i >= speakers else f"s{i}", i) for i in range(n)]
        d = spark.createDataFrame(utts, "id string, speaker string, ord long").repartition(5)
        want = plain_plan(utts, count, seed)
        if len(want) < count:
            with pytest.raises(ValueError):
                X.mix_plan(d, count, seed)
            continue
        assert sorted(map(tuple, X.mix_plan(d, count, seed).collect())) == want
    with pytest.raises(ValueError, match="two speakers"):
        X.mix_plan(spark.createDataFrame([("a", "s", 0)], "id string, speaker string, ord long"), 1, 1)
    with pytest.raises(ValueError, match="too few"):
        X.mix_plan(spark.createDataFrame([("a", "s", 0), ("b", "t", 1)], "id string, speaker string, ord long"), 2, 1)


def plain_mix(a, b, snr, ratio, lead, target=0.1, most=0.98):
    a, b = (np.asarray(x, float) - np.mean(x) for x in (a, b))
    loud = lambda x: np.sqrt(np.mean(x * x))
    a, b = a * target / loud(a), b * target * 10 ** (-snr / 20) / loud(b)
    shared = max(1, int(np.floor(min(len(a), len(b)) * ratio + 0.5)))
    at = max(0, len(a if lead == "a" else b) - shared)
    sa, sb = (0, at) if lead == "a" else (at, 0)
    x, y = np.zeros(max(sa + len(a), sb + len(b))), np.zeros(max(sa + len(a), sb + len(b)))
    x[sa : sa + len(a)], y[sb : sb + len(b)] = a, b
    peak = np.abs(x + y).max()
    scale = most / peak if peak > most else 1.0
    return (x + y) * scale, x * scale, y * scale, sa, sb, shared


def test_mixing_chunks_equals_mixing_whole_sounds(spark):
    r, g = random.Random(2), np.random.default_rng(3)
    sounds = {f"u{i}": (g.normal(0.1, 1, r.randint(250, 1400)) * (g.random() + 0.01)).astype(np.float32) for i in range(6)}
    sounds["short"], sounds["silent"] = g.normal(0, 1, 100).astype(np.float32), np.full(600, 0.25, np.float32)
    spiky = np.zeros(3000, np.float32)
    spiky[::900] = 40.0
    sounds["spiky"] = spiky
    rows = []
    for name, x in sounds.items():
        at = k = 0
        while at < len(x):
            n = r.randint(1, 400)
            rows.append((name, k, x[at : at + n].tolist()))
            at, k = at + n, k + 1
        rows.append((name, k, []))
    chunks = spark.createDataFrame(rows, "id string, chunk long, samples array<float>").repartition(4)
    names = list(sounds)
    plans = [(i, *r.sample(names, 2), r.choice([-6.0, 0.0, 6.0]), r.choice([0.25, 0.5, 1.0]), "ab"[i % 2]) for i in range(25)] + [(25, "u0", "nobody", 0.0, 0.5, "a"), (26, "spiky", "u1", -6.0, 0.25, "b")]
    d = spark.createDataFrame(plans, "idx long, source_a string, source_b string, snr_db double, overlap_ratio double, lead string")
    layout = X.mix_layout(d, chunks, rate=1000)
    got = {}
    for x in X.mixed(layout, chunks, size=300).orderBy("idx", "chunk").collect():
        for c in ("mixture", "stem_a", "stem_b"):
            got.setdefault((x.idx, c), []).extend(x[c])
    times = {x.idx: x for x in X.mix_times(layout, 1000).collect()}
    bad = {"short", "silent", "nobody"}
    loud = 0
    for i, a, b, snr, ratio, lead in plans:
        if {a, b} & bad:
            assert times[i].reason == "short-or-silent" and (i, "mixture") not in got
            continue
        *want, sa, sb, shared = plain_mix(sounds[a], sounds[b], snr, ratio, lead)
        for c, w in zip(("mixture", "stem_a", "stem_b"), want, strict=True):
            assert np.allclose(got[i, c], w, atol=1e-9)
        loud += np.isclose(np.abs(want[0]).max(), 0.98)
        assert (times[i].start_a_s, times[i].start_b_s, times[i].duration_s) == (sa / 1000, sb / 1000, len(want[0]) / 1000) and times[i].overlap_end_s - times[i].overlap_start_s == pytest.approx(shared / 1000)
    assert loud >= 1 and len(got) > 30
