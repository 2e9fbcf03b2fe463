"""Batches of texts against the same one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechlake.functions import alignment as A
from speechlake.functions import batches as B


def said(r, n, long, abc):
    a = ["".join(r.choice(abc) for _ in range(r.randint(0, long))) for _ in range(n)]
    b = ["".join(c for c in x if r.random() > 0.2) if r.random() < 0.6 else "".join(r.choice(abc) for _ in range(r.randint(0, long))) for x in a]
    return a, b


@pytest.mark.parametrize("abc", ["ab", "abcdefé日𝄞"])
@pytest.mark.parametrize("table, most", [(1 << 18, 1024), (64, 1024), (1 << 18, 50)])
def test_batches_equal_single_texts(monkeypatch, abc, table, most):
    monkeypatch.setattr(B, "TABLE", table)
    monkeypatch.setattr(B, "LONG", most)
    r = random.Random(len(abc) + most)
    for long in (3, 64, 65, 150):
        a, b = said(r, 24, long, abc)
        x, y, n = B.Texts(pa.array(a)), B.Texts(pa.array(b)), np.arange(24)
        assert B.distances(x, n, y, n).tolist() == [A.edit_distance(*p) for p in zip(a, b, strict=True)]
        assert B.counts(x, y).tolist() == [list(A.edit_counts(*p)) for p in zip(a, b, strict=True)]
        assert B.shared(x, y).tolist() == [sum(min(p.count(c), q.count(c)) for c in set(p)) for p, q in zip(a, b, strict=True)]
        for k in range(5):
            at = np.arange(24 // max(k, 1) + (k > 0)) * k
            assert B.concatenated(x, at, B.Texts(pa.array(b[: len(at) - 1]))).tolist() == [A.concatenated_distance(a[i : i + k], h) for i, h in zip(at[:-1], b, strict=False)]


def test_assignments_are_those_of_single_costs():
    r = random.Random(3)
    for k, m in ((1, 1), (2, 2), (2, 4), (3, 3), (5, 5), (6, 7), (2, 11)):
        cost = np.array([[[r.randint(0, 3) for _ in range(m)] for _ in range(k)] for _ in range(30)])
        least, chosen = B.assignments(cost)
        assert chosen.tolist() == [A.assignment(c.tolist()) for c in cost] and least.tolist() == [sum(c[i][j] for i, j in enumerate(p)) for c, p in zip(cost, chosen, strict=True)]


def test_column_functions_take_nulls_slices_and_missing_texts(spark):
    rows = [("abc", "axc", ["abc", None], ["x"], "cab"), (None, "x", [], ["x"], None), ("é日", "é", None, None, "x"), ("same", "same", ["a", "b", "a"], ["b", "a", "", "q"], "aab")] * 5
    d = spark.createDataFrame(rows, "a string, b string, r array<string>, h array<string>, t string").where("a is null or a != 'zz'")
    got = d.select(A.distance_udf("a", "b"), A.shared_chars_udf("a", "b"), A.assign_udf("r", "h"), A.concatenated_udf("r", "t"), A.edit_stats_udf("a", "b"), A.likeness_udf(F.coalesce("h", F.array()))).collect()
    want = [
        (1, 2, (4 - 1, [0, 1]), 2, (2, 1, 0, 0, 1), [1.0]), (None, 0, (0, []), 0, (0, 0, 0, 1, 1), [1.0]), (1, 1, (0, []), 1, (1, 0, 1, 0, 1), []),
        (0, 4, (1, [1, 0, 2]), 0, (4, 0, 0, 0, 0), [1.0, 1.0, 1.0, 1.0]),
    ]
    assert [tuple(tuple(x) if hasattr(x, "asDict") else x for x in row) for row in got] == want * 5


def test_many_utterances_in_a_fraction_of_the_time():
    import time

    r = random.Random(9)
    a, b = said(r, 20_000, 60, "abcdefghijklmnopqrstuvwxyz")
    x, y, n = B.Texts(pa.array(a)), B.Texts(pa.array(b)), np.arange(20_000)
    t0 = time.process_time()
    B.distances(x, n, y, n)
    t1 = time.process_time()
    for p in zip(a[:5000], b, strict=False):
        A.edit_distance(*p)
    assert (t1 - t0) < (time.process_time() - t1) * 4 / 2
