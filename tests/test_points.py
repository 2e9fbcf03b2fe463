"""Intervals without length, and values of zero, as the SQL has them."""

import duckdb
import pytest

from speechlake.operators import intervals as I
from speechlake.operators import settings as X
from speechlake.operators import transcript as T
from speechlake.plans.oracles import ORACLES
from speechlake.plans.queries import QUERIES

SEG = "recording_id long, seg_id long, start_s double, end_s double"


def test_points_meet_what_holds_them_inside(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 300.0), (1, 1, 150.0, 150.0), (1, 2, 150.0, 150.0), (1, 3, 300.0, 300.0), (1, 4, 150.0, 160.0)], SEG)
    got = sorted((r.seg_id, r.r_seg_id) for r in I.range_join(d, d, points=True).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (0, 4), (1, 0), (2, 0), (4, 0), (4, 4)]
    assert I.best_overlap(d.where("seg_id = 1"), d.where("seg_id = 0"), "seg_id", "seg_id").first().r_seg_id == 0
    assert sorted(r.seg_id for r in X.hypothesis_rows(d, d.where("seg_id = 1"), "seg_id").collect()) == [0]


def test_a_replaced_block_leaves_others_of_its_id(spark):
    kind = "recording_id long, id string, block_start double, block_end double, source_start double, source_end double"
    old = spark.createDataFrame([(1, "a", 0.0, 1.0, None, None), (1, "a", 5.0, 6.0, None, None), (1, "p", 5.5, 5.5, None, None)], kind)
    new = spark.createDataFrame([(1, "n", 5.2, 5.8, None, None)], kind)
    assert sorted((r.id, r.block_start) for r in T.upsert_blocks(old, new).collect()) == [("a", 0.0), ("n", 5.2)]
    point = spark.createDataFrame([(1, "n", 0.5, 0.5, None, None)], kind)
    assert sorted((r.id, r.block_start) for r in T.upsert_blocks(old, point).collect()) == [("a", 5.0), ("n", 0.5), ("p", 5.5)]


@pytest.mark.parametrize("name", ["apply_whole_range", "correction_upsert", "hypothesis_rows", "speaker_argmax_overlap", "stem_options"])
def test_queries_equal_their_sql_on_zero_values(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("""create table events as select i as event_id, timestamp '2024-01-01' + interval (i * 7 % 900) second as ts, i % 8 as user_id,
      case when i % 5 = 0 then 'error' else 'view' end as event_type, case when i % 3 = 0 then 0.0 else i % 11 end::double as value from range(400) t(i)""")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    form = lambda r: tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(str, map(form, got.select(*names).collect()))) == sorted(map(str, map(form, want.fetchall())))
