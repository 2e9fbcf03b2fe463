"""Sessions, ordered results and progress: rules by hand, and streams against batches."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from speechlake.streaming import lifecycle as L

SIGNAL = "session long, seq long, kind string, start_s double, end_s double, speech boolean"


def run(spark, tmp_path, name, parts, schema, stream):
    """The rows of a stream over micro-batches, one for each part; a new query for each, from the same checkpoint."""
    source = tmp_path / f"{name}-in"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep such a query running
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        frames = spark.readStream.schema(schema).parquet(f"file://{source}")
        q = stream(frames).writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}-out").option("checkpointLocation", f"file://{tmp_path}/{name}-cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        if i + 1 < len(parts):
            time.sleep(0.3)
    return sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/{name}-out").collect()), key=repr)


def signals(r, session):
    rows, at, seq = [], 0.0, 0
    for _ in range(60):
        kind = r.choice(["start", "stop", "cancel"]) if r.random() < 0.15 else "frame"
        rows.append((session, seq, kind, at, at + 0.1, r.random() < 0.7) if kind == "frame" else (session, seq, kind, None, None, None))
        at, seq = round(at + r.choice([0.1, 0.1, 0.5]), 6), seq + 1
    return rows


def test_session_rules_by_hand():
    s = L.Session(silence=0.2, least=0.0, most=6.0)
    assert s.feed(0, "frame", 0.0, 0.1, True) == [] and s.feed(1, "stop", None, None, None)[0][-1] == "not-running"
    assert s.feed(2, "start", None, None, None) == [] and s.feed(3, "start", None, None, None)[0][-1] == "already-running"
    assert s.feed(4, "frame", 1.0, 1.1, True) == [] and s.feed(5, "frame", 1.5, 1.6, True) == [("segment", 5, 1.0, 1.1, 1, None)]
    assert s.feed(6, "stop", None, None, None) == [("segment", 6, 1.5, 1.6, 1, None), ("done", 6, None, 0.2, 2, "stop")] and s.idle
    assert s.feed(7, "frame", 2.0, 2.1, True) == []  # after the stop
    s.feed(8, "start", None, None, None)
    s.feed(9, "frame", 3.0, 3.1, True)
    assert s.feed(10, "cancel", None, None, None) == [] and s.idle and s.expire() == []
    s.feed(11, "start", None, None, None)
    s.feed(12, "frame", 4.0, 4.1, True)
    assert s.expire() == [("segment", 12, 4.0, 4.1, 1, None), ("done", 12, None, 0.1, 1, "timeout")]


def test_sessions_stream_equals_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [x for k in range(4) for x in signals(r, k)]
    rule = {"silence": 0.3, "least": 0.05, "most": 2.0}
    parts = [[x for x in rows if a <= x[1] < a + 20] for a in (0, 20, 40)]
    got = run(spark, tmp_path, "s", parts, SIGNAL, lambda d: L.session_stream(d, **rule))
    want = sorted(map(tuple, L.session_events(spark.createDataFrame(rows, SIGNAL), **rule).collect()), key=repr)
    assert got == want and {x[1] for x in want} == {"segment", "done", "error"}


def test_idle_sessions_time_out(spark, tmp_path):
    a = [(1, 0, "start", None, None, None), (1, 1, "frame", 0.0, 0.5, True)]
    b = [(2, 0, "start", None, None, None)]
    got = run(spark, tmp_path, "t", [a, b], SIGNAL, lambda d: L.session_stream(d, wait=50))
    assert [x[:1] + x[1:2] + x[-1:] for x in got if x[0] == 1] == [(1, "done", "timeout"), (1, "segment", None)]


def test_results_leave_by_number(spark, tmp_path):
    rule = L.InOrder()
    assert rule.feed(1, 1.0, 2.0, "b", None) == [] and rule.feed(0, 0.0, 1.0, None, "lost") == [(0, 0.0, 1.0, None, "lost"), (1, 1.0, 2.0, "b", None)]
    assert rule.feed(0, 0.0, 1.0, "late", None) == [] and rule.feed(2, 2.0, 3.0, " ", None) == [] and rule.next == 3
    r = random.Random(2)
    rows = [(k, i, float(i), i + 1.0, r.choice(["x", "", "y z", None]) if i % 5 else None, None if i % 5 else "E: lost") for k in range(3) for i in range(30) if (k, i) != (2, 17)]
    shown = [x for x in rows if (x[4] or "").strip() or x[5]]
    r.shuffle(rows)
    want = sorted((x for x in shown if x[0] != 2 or x[1] < 17), key=repr)
    assert sorted(map(tuple, L.results_in_order(spark.createDataFrame(rows, L.ORDERED)).collect()), key=repr) == want
    assert run(spark, tmp_path, "r", [rows[:30], rows[30:50], rows[50:]], L.ORDERED, L.results_stream) == want


STATUS = "job_id long, seq long, at_s double, phase string, done double, total double, audio_s double"


def test_progress_stream_equals_batch_and_eta(spark, tmp_path):
    from speechlake.streaming import segmenter as ST

    r = random.Random(3)
    rows = [(k, i, i * 7.0 + k, r.choice(["queued", "recognizing", "recognizing", "recognizing", "overlap", "finalizing", "decoding"]), float(r.randint(0, 40)), 30.0, 10.0) for k in range(3) for i in range(40)]
    d = spark.createDataFrame(rows, STATUS)
    key = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in rows), key=repr)
    batch = L.progress(d)
    want = key(batch.collect())
    got = run(spark, tmp_path, "p", [[x for x in rows if a <= x[1] < a + 20] for a in (0, 20)], STATUS, L.progress_stream)
    assert key(x for x in got) == want
    smooth = {(x.job_id, x.at_s): x.remaining_s for x in ST.eta(d.select("job_id", "at_s", "phase", "done", "total")).collect()}
    assert {(x.job_id, x.at_s): x.remaining_s for x in batch.collect()} == pytest.approx(smooth, nan_ok=True) and any(v for v in smooth.values())
    slow = {(x.job_id, x.at_s): (x.in_phase_s, x.slow) for x in ST.phase_state(d.select("job_id", "at_s", "phase", "audio_s")).collect()}
    assert {(x.job_id, x.at_s): (x.in_phase_s, x.slow) for x in batch.collect()} == slow


def test_a_silent_job_is_slow_by_the_clock(spark, tmp_path, monkeypatch):
    p = L.Progress()
    assert p.feed(0, 5.0, "decoding", 0, 0, 200.0)[0][-1] is False and p.wait == 201.0
    assert p.expire() == [(0, 5.2, "decoding", None, 0.2, True)] and p.expire() == [] and p.wait is None
    monkeypatch.setattr(L, "_limits", lambda d: d.withColumn("limit_ms", F.lit(100.0)))
    got = run(spark, tmp_path, "q", [[(1, 0, 5.0, "decoding", 0.0, 0.0, 1.0)], [(2, 0, 5.0, "decoding", 0.0, 0.0, 1.0)]], STATUS, L.progress_stream)
    assert [x for x in got if x[0] == 1 and x[-1]] == [(1, 0, 5.1, "decoding", None, 0.1, True)]


def test_caches_equal_a_replay(spark, tmp_path):
    from collections import OrderedDict

    r = random.Random(4)
    log = [(c, i, f"k{min(r.randrange(30), r.randrange(30))}") for c in range(3) for i in range(300)]
    for capacity, refresh in ((12, True), (10, False), (1, True)):
        want = []
        for c in range(3):
            held = OrderedDict()
            for _, i, k in (x for x in log if x[0] == c):
                hit, gone = k in held, None
                held[k] = 1
                if hit and refresh:
                    held.move_to_end(k)
                if len(held) > capacity:
                    gone = held.popitem(last=False)[0]
                want.append((c, i, k, hit, gone))
        want.sort(key=repr)
        d = spark.createDataFrame(log, "cache long, seq long, entry string")
        assert sorted(map(tuple, L.cache_accesses(d, capacity, refresh).collect()), key=repr) == want
        if capacity == 12:
            assert run(spark, tmp_path, "c", [[x for x in log if a <= x[1] < a + 150] for a in (0, 150)], "cache long, seq long, entry string", L.cache_stream) == want


def test_cache_keys_change_with_what_counts(spark):
    base = ("p", 5, 7.0, None, None, 2, [("m", 1, 2)])
    rows = [base, ("p", 5, 7.9, None, None, 2, [("m", 1, 2)]), *[tuple("q" if i == 0 else v + 1 if i in (1, 5) else 99.0 if i in (2, 3, 4) else [("m", 1, 3)] if i == j == 6 else v for v, i in ((b, k if k == j else -1) for k, b in enumerate(base))) for j in range(7)]]
    d = spark.createDataFrame(rows, "path string, size long, mtime double, a double, b double, n int, models array<struct<path:string,size:long,mtime:long>>")
    keys = [x[0] for x in d.select(L.cache_key(*(F.col(c) for c in ("path", "size", "mtime", "a", "b", "n", "models")))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 8


def test_a_fold_holds_no_table_of_its_rows(spark):
    class Held:
        """A rule that says by how many MB its process has grown since the first row."""

        first = None

        def feed(self, seq, entry):
            now = 0
            if seq % 10_000 == 0:
                now = int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
                self.first = now if self.first is None else self.first
                now -= self.first
            return [(seq, entry, now)]

    log = spark.range(600_000).select(F.lit(1).cast("long").alias("cache"), F.col("id").alias("seq"), F.concat(F.lit("entry-"), F.col("id").cast("string")).alias("entry"))
    d = L._by_key(log, "cache", ["seq", "entry"], "cache long, seq long, entry string, mb long", Held)
    r = d.agg(F.count("*").alias("n"), F.max("mb").alias("mb"), F.sum("seq").alias("s")).first()
    assert (r.n, r.s) == (600_000, 600_000 * 599_999 // 2) and r.mb < 60
