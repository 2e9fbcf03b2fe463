"""Alignment and assignment against definitions written out."""

import itertools
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from speechlake.functions import alignment as A
from speechlake.functions import scalars as S
from speechlake.operators import evaluation as E
from speechlake.operators import tuning as U


def plain_counts(ref, hyp):
    """By recursion over beginnings: distance first, then the preferred last step (match, substitution, deletion, insertion)."""

    @cache
    def d(i, j):
        return i + j if not i or not j else min(d(i - 1, j - 1) + (ref[i - 1] != hyp[j - 1]), d(i - 1, j) + 1, d(i, j - 1) + 1)

    def step(i, j):
        if not i and not j:
            return (0, 0, 0, 0)
        ways = [(i and j and ref[i - 1] == hyp[j - 1], 0, i - 1, j - 1), (i and j and d(i, j) == d(i - 1, j - 1) + 1, 1, i - 1, j - 1), (i and d(i, j) == d(i - 1, j) + 1, 2, i - 1, j), (True, 3, i, j - 1)]
        _, kind, a, b = next(w for w in ways if w[0])
        return tuple(n + (k == kind) for k, n in enumerate(step(a, b)))

    return (*step(len(ref), len(hyp)), d(len(ref), len(hyp)))


@pytest.mark.parametrize("held", [1 << 25, 300, 64])
def test_counts_equal_the_plain_matrix(monkeypatch, held):
    monkeypatch.setattr(A, "HELD", held)
    r = random.Random(held)
    for _ in range(400):
        abc = r.choice(["ab", "abc", "abcdefé日𝄞"])
        a, b = ("".join(r.choice(abc) for _ in range(r.randint(0, 30))) for _ in range(2))
        b = a[: r.randint(0, 30)] + b if r.random() < 0.3 else b
        want = plain_counts(a, b)
        assert A.edit_counts(a, b) == want and A.edit_distance(a, b) == want[4]


def test_long_texts_in_bounded_memory():
    import tracemalloc

    r = random.Random(5)
    a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz 日本") for _ in range(100_000))
    b = "".join(c for c in a if r.random() > 0.1)
    tracemalloc.start()
    m, s, d, i, n = A.edit_counts("x" + a + "y", "z" + b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 << 20 and n == s + d + i and m + s + d == len(a) + 2 and m + s + i == len(b) + 1 and n <= len(a) - len(b) + 2


def test_assignments_are_least_and_first():
    r = random.Random(6)
    for _ in range(300):
        n = r.randint(0, 5)
        m = r.randint(n, 6)
        cost = [[r.randint(0, r.choice([1, 3, 9])) for _ in range(m)] for _ in range(n)]
        want = min((sum(cost[i][c] for i, c in enumerate(p)), list(p)) for p in itertools.permutations(range(m), n))[1]
        assert A.assignment(cost) == want


def test_twelve_speakers_and_more():
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.randint(20, 40))) for _ in range(12)]
    mixed = r.sample(range(12), 12)
    assert A.assignment([[A.edit_distance(t, texts[k]) for k in mixed] for t in texts]) == [mixed.index(i) for i in range(12)]
    assert A.concatenated_distance(texts, "".join(texts[k] for k in mixed)) == 0
    big = [[r.randint(0, 50) for _ in range(40)] for _ in range(40)]
    assert sorted(A.assignment(big)) == list(range(40))


def test_orders_of_joined_references():
    r = random.Random(8)
    for n in [0, 1, 2, 3, 4, 5, 5, 6, 7]:
        for _ in range(12 if n < 6 else 2):
            refs = ["".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(n)]
            hyp = "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
            assert A.concatenated_distance(refs, hyp) == min(A.edit_distance("".join(p), hyp) for p in itertools.permutations(refs))


def test_columns_of_many_speakers(spark):
    rows = [(["a", "bc", None], ["bc"], "bca"), ([], ["x"], "xy"), (None, None, None), ([str(i) * 5 for i in range(9)], [str(i) * 5 for i in range(8, -1, -1)], "".join(str(i) * 5 for i in (3, 1, 4, 0, 5, 2, 6, 8, 7)))]
    d = spark.createDataFrame(rows, "refs array<string>, hyps array<string>, mix string")
    got = d.select(E.pit(F.col("refs"), F.col("hyps")).alias("p"), E.cp(F.col("refs"), F.col("mix")).alias("c")).collect()
    assert [(g.p.distance, g.p.assignment, g.c) for g in got] == [(1, [1, 0, 2], 0), (0, [], 2), (0, [], 0), (0, list(range(8, -1, -1)), 0)]


def test_alike_is_the_similarity_compared(spark):
    r = random.Random(9)
    rows = []
    for _ in range(600):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
        rows.append((a, r.choice([a[r.randint(0, 3) : r.randint(3, 12)], "".join(c if r.random() > 0.2 else "x" for c in a), "".join(r.choice("abé") for _ in range(9))])))
    d = spark.createDataFrame(rows, "a string, b string")
    same = S.round6(S.anchor_similarity(F.col("a"), F.col("b"))) >= 0.68
    got = d.select(S.alike(F.col("a"), F.col("b"), 0.68).alias("x"), same.alias("y")).collect()
    assert [g.x for g in got] == [g.y for g in got] and 50 < sum(g.x for g in got) < 550


def test_speaker_accuracy_of_long_turns(spark):
    r = random.Random(10)
    say = lambda n: "".join(r.choice("abcdefg") for _ in range(n))
    ref = [(1, who, k, say(r.choice([3, 400]))) for who in "xy" for k in range(4)] + [(2, "x", 0, "abc"), (3, "x", 0, "abc"), (3, "y", 0, "d")]
    hyp = [(g, who, k, t.replace("ab", "b") + "g" * (k % 2)) for g, who, k, t in ref if g == 1] + [(2, "x", 0, "abc"), (3, None, 0, "abc")]
    kind = "g long, speaker string, ord long, text string"
    got = {x.g: x.speaker_accuracy for x in U.speaker_accuracy(spark.createDataFrame(ref, kind), spark.createDataFrame(hyp, kind), ["g"]).collect()}
    weighted, length = 0.0, 0
    for who in "xy":
        a, b = ("".join(t for g, w, _, t in rows if (g, w) == (1, who)) for rows in (ref, hyp))
        _, s, d, i, _ = A.edit_counts(a, b)
        weighted, length = weighted + s + 1.35 * d + i, length + len(a)
    assert got[1] == pytest.approx(1 - weighted / length, abs=1e-6) and got[2] is None and got[3] is None
