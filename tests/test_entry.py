import os

import pytest

import __spark_entry__ as entry
from speechlake.plans.oracles import ORACLES
from speechlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["overlap_islands", "strict_split", "char_coverage_micro", "merge_same_speaker", "refine_grid", "stem_pair_assign"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    norm = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    assert sorted(tuple(norm(r[c]) for c in have) for r in df.collect()) == sorted(tuple(map(norm, r)) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
