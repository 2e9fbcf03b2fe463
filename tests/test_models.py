"""Table functions over partitions."""

import os
import random

import numpy as np

from speechlake.sources import models as M
from speechlake.streaming.segmenter import Segmenter


def test_speech_of_chunks_equals_speech_of_whole_sounds(spark):
    r, g = random.Random(1), np.random.default_rng(2)
    rows, want = [], []
    for name in ("a", "b", "none", None):
        x = np.concatenate([g.normal(0, r.choice([0.001, 0.3]), r.randint(200, 3000)) for _ in range(30)]).astype(np.float32) if name != "none" else np.empty(0)
        s, found = Segmenter(silence=0.05, least=0.02, most=1.0), []
        for k in range(len(x) // 100):
            found += s.feed(round(k * 0.01, 6), round((k + 1) * 0.01, 6), bool(np.sqrt((x[k * 100 : k * 100 + 100].astype(float) ** 2).mean()) >= 0.05))
        want += [(name, *f) for f in found + s.flush()]
        at = k = 0
        while at < len(x) or not k:
            n = r.randint(1, 900)
            rows.append((name, k, x[at : at + n].tolist()))
            at, k = at + n, k + 1
    rows.append(("a", 10_000, None))
    d = spark.createDataFrame(rows, "path string, chunk long, samples array<float>").repartition(6)
    got = M.speech(d, rate=10_000, frame=100, threshold=0.05, silence=0.05, least=0.02, most=1.0).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 10
    assert M.speech(d.limit(0)).collect() == []


def test_a_model_is_loaded_once_in_a_worker(spark):
    def load():
        token = os.urandom(8).hex()

        class Count:
            def __init__(self, row):
                self.key, self.n, self.last = row["k"], 0, -1

            def feed(self, row):
                assert row["o"] > self.last and row["k"] == self.key
                self.n, self.last = self.n + 1, row["o"]
                return []

            def finish(self):
                yield self.key, self.n, token, os.getpid()

        return Count

    d = spark.createDataFrame([(k, o) for k in range(40) for o in range(5)], "k long, o long").repartition(7)
    got = M.over_partitions(d, "k", "o", load, "k long, n long, token string, pid long", "count").collect()
    assert sorted((x.k, x.n) for x in got) == [(k, 5) for k in range(40)]
    assert len({x.token for x in got}) == len({x.pid for x in got}) < 40
