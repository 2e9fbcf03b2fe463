"""The segment that a row shares most with, without a sort of pairs."""

import math

import pytest

from speechlake.operators import intervals as I


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield spark
    spark.conf.set(name, old)


def test_best_overlap_equals_all_pairs(small_batches):
    spark = small_batches
    d = spark.range(240).selectExpr(
        "case when id % 50 = 49 then null else cast(id % 2 as string) end as recording_id", "id as seg_id", "id % 4 < 2 as row",
        "(id div 8) * 21.5D + 1e-6 * (id % 3) as start_s", "(id div 8) * 21.5D + 1e-6 * (id % 3) + case when id % 7 = 0 then 0 when id % 40 = 1 then 400 else (id % 5) * 9 end as end_s",
    )
    d = d.unionByName(d.where("seg_id % 3 = 0").selectExpr("recording_id", "seg_id + 1000 as seg_id", "row", "start_s", "end_s"))
    rows, segs = d.where("row"), d.where("not row")
    got = I.best_overlap(rows, segs, "seg_id", "seg_id")
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p  # pairs of a join were sorted by row before
    micro = lambda x: math.floor(x * 1e6 + 0.5) / 1e6
    want, every = [], segs.collect()
    for a in rows.collect():
        met = [(-micro(min(a.end_s, b.end_s) - max(a.start_s, b.start_s)), micro(abs(a.start_s + a.end_s - b.start_s - b.end_s) / 2), b.seg_id)
               for b in every if a.recording_id is not None and a.recording_id == b.recording_id and a.end_s > b.start_s and a.start_s < b.end_s]
        if met:
            want.append((a.recording_id, a.seg_id, min(met)[2], -min(met)[0]))
    assert len(want) > 50 and sorted((r.recording_id, r.seg_id, r.r_seg_id, r.overlap_s) for r in got.collect()) == sorted(want)
