from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from speechlake.llm import mixing, quality

from . import brute
from .data import DOCS, documents, frame


def write(spark, path, data, items, labels):
    frame(spark, data).drop("quality").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Null, repeated and shared numbers, null, empty and long texts, repeated rows, and columns that operators use inside."""
    plain = documents(1, awkward=False)[0][1]
    data = documents(120) + [(900, None, "en", "a", None), (902, plain, "en", "a", 1), (8, " ".join(f"other{i}" for i in range(40)), "de", None, 3)]
    items = [(1, " ".join(data[8][1].split()[:20])), (None, None), (2, "")]
    return write(spark, tmp_path_factory.mktemp("sf"), data, items, [(i, 1, 0) for i in range(50)] + [(None, 1, 0), (3, None, None)]), data


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_each_stage_against_a_plain_version(spark, sf):
    path, data = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = P.quality_rules(spark, docs, path)
    kept = [d for d in data if not brute.quality(d[1])[5]]
    assert out.columns == P.COLUMNS and plain(out.collect()) == plain(kept)

    # every row is a document: classes are those of the rows
    root = brute.components([(i, d[1]) for i, d in enumerate(data)])
    classes = defaultdict(list)
    for i, d in enumerate(data):
        classes[root[i]].append(((d[0] is None, d[0] or 0), d))
    out = P.near_duplicates(spark, docs, path)
    first = [min(c, key=lambda x: x[0])[0] for c in classes.values()]
    got = out.collect()
    assert out.columns == P.COLUMNS and sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(first)
    assert not plain(got) - plain(data)

    items = [("" if r[0] is None else r[0], r[1]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    bad = [r[5] for r in brute.contamination([(d[0], d[1]) for d in data], items)]
    out = P.decontaminate(spark, docs, path)
    assert any(bad) and out.columns == P.COLUMNS and plain(out.collect()) == plain(d for d, b in zip(data, bad, strict=True) if not b)


def test_mix_stage_against_a_plain_version(spark, sf):
    """Every row is a run of words of one of its number's texts, no text is taken more than twice, and sources come near their targets."""
    path, data = sf
    out = P.mix_sources(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert out.columns == P.COLUMNS
    sizes, texts, taken, by = Counter(), defaultdict(list), Counter(), Counter()
    for d in data:
        sizes[d[3]] += len(brute.words(d[1]))
        texts[d[0], d[2], d[3]].append(d[1] or "")
    for r in out.collect():
        assert any(r.text in t for t in texts[r.doc_id, r.lang, r.source]) and r.n_chars == len(r.text) and r.text
        taken[r.doc_id, r.lang, r.source] += len(brute.words(r.text))
        by[r.source] += len(brute.words(r.text))
    assert all(n <= 2 * sum(len(brute.words(t)) for t in texts[k]) for k, n in taken.items())
    block = mixing.Mix().block_words
    for s, want in brute.water(dict(sizes)).items():
        assert abs(by[s] - want) <= 0.02 * want + 2 * block


def test_shard_stage_against_a_plain_version(spark, sf):
    path, data = sf
    got = P.shard(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()
    assert plain(tuple(r[c] for c in P.COLUMNS) for r in got) == plain(data)
    # in the order of shards and slots, a row lies where the middle of its bytes does
    total = sum(len((d[1] or "").encode()) + 8 for d in data)
    at = 0
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        size = len((r.text or "").encode()) + 8
        assert r.size == size and r.shard == min(P.SHARDS - 1, (2 * at + size) * P.SHARDS // (2 * total))
        at += size
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_tables(spark, tmp_path):
    path = write(spark, tmp_path / "e", [], [], [])
    for _, stage in P.STAGES:
        assert stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == 0
    one = write(spark, tmp_path / "one", [(1, None, None, None, None)], [], [])
    assert P.near_duplicates(spark, spark.read.parquet(f"{one}/documents.parquet"), one).count() == 1
    assert P.run(spark, one).count() == 0  # a text without words fails the base test


def test_run_is_whole(spark, sf):
    path, _ = sf
    out = P.run(spark, path).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert out and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert quality.Risk().alpha < 0.05
