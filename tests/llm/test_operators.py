import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.llm import chat, decontam, licenses, mixing, ngram_join, packing, quality, secret_scan, sharding, warc
from speechlake.llm.common import word_count

from . import brute
from .data import DOCS, documents, frame


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 mixing


def mixed(spark, docs, **k):
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.taken_words(sized, mixing.Mix(**k)).collect()


def test_mixing_targets_limits_and_reruns(spark):
    data = documents(80)
    got = mixed(spark, frame(spark, data), block_words=4, shard_slots=64)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d[0], len(brute.words(d[1]))) for d in data if d[0] is not None)
    assert len(got) == len(data)
    sizes = Counter()
    for d in data:
        sizes[d[3]] += len(brute.words(d[1]))
    want = brute.water(dict(sizes))
    assert sorted({(round(r.target, 6), r.source_size) for r in got}) == sorted({(round(want[s], 6), n) for s, n in sizes.items()})
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[round(r.target, 6), r.source_size] += r.taken
    assert all(abs(k - t) <= 0.05 * t + 8 for (t, _), k in by.items())
    again = mixed(spark, frame(spark, data).repartition(3), block_words=4, shard_slots=64)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_empty_table_and_zero_sizes(spark):
    assert mixed(spark, frame(spark, [])) == []
    assert [(r.size, r.taken) for r in mixed(spark, frame(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)]))] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 997, 5000])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), 7)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or sum(abs(a - b) == 1 for a, b in zip(got, got[1:], strict=False)) < n / 10


def test_mixed_documents_text(spark):
    data = [d for d in documents(40, awkward=False)]
    out = mixing.mixed_documents(frame(spark, data, False), mixing.Mix(block_words=8, shard_slots=64)).collect()
    texts = {d[0]: d[1] for d in data}
    taken = {r.doc_id: r.taken for r in mixed(spark, spark.createDataFrame(data, DOCS), block_words=8, shard_slots=64)}
    got = Counter()
    for r in out:
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        got[r.doc_id] += len(brute.words(r.text))
    sizes = Counter()
    for d in data:
        sizes[d[3]] += len(brute.words(d[1]))
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values()) and sum(got.values()) == pytest.approx(sum(taken.values()), rel=0.05)


def test_mixed_documents_keep_their_texts_when_files_are_split_anew(spark, tmp_path):
    data = documents(80, awkward=False)
    spark.createDataFrame(data, DOCS).repartition(16, "doc_id").write.parquet(f"{tmp_path}/docs")
    docs, mix = spark.read.parquet(f"{tmp_path}/docs"), mixing.Mix(block_words=8, shard_slots=64)
    want, out = rows(mixing.mixed_documents(docs, mix)), mixing.mixed_documents(docs, mix)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # as when the cores change between two jobs
    try:
        got = rows(out)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    texts = {d[0]: d[1] for d in data}
    assert got == want and all(r[1] in texts[r[0]] for r in got)


# 2 web archives

PAGES = "page_id long, url string, html string"


def pages():
    long, hard = "<p>ü " * 300, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    return [(1, "http://a/x y", long), (2, None, long), (5, "http://b\r\n", long), (3, "", "short"), (4, "u", "short"), (6, "u", None), (7, "u", hard * 40), (8, "u", ""), (None, "u", long), (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "v", hard * 40), (11, "v", hard * 40)]


def test_warc_round_trip(spark):
    data = pages()
    got = warc.captures(spark.createDataFrame(data, PAGES)).collect()
    first = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, i), i)
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        again = h in first and first[h] != i and Counter(x[2] for x in data)[h] > 1
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, want))
    assert all(r.n_records == 3 for r in got) and {r.target_uri for r in got if r.page_id in (1, 2, 5)} == {"http://a/x%20y", "", "http://b%20%20"}
    assert warc.captures(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_payloads_and_missing_records(spark, tmp_path):
    warc.write(spark.createDataFrame(pages()[3:9], PAGES), f"file://{tmp_path}/w")
    records = warc.read(spark, f"file://{tmp_path}/w")
    full = warc.assemble(records).collect()
    assert all(r.request is not None and r.metadata is not None for r in full)
    by = {r.metadata.page_id: r.response.payload for r in full}
    assert by[3] == b"short" and by[8] == b"" and by[7] == pages()[6][2].encode()
    part = warc.assemble(records.where("type != 'request'")).collect()
    assert len(part) == len(full) and all(r.request is None for r in part)


def test_warc_large_pages_extra_columns_and_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (1 << 11, 1 << 13, 1 << 17))
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 14)
    data = pages() + [(20 + i, "u", ("é" * n) + str(i)) for i, n in enumerate((10, 1500, 4000, 40000, 300000))]
    d = spark.createDataFrame(data, PAGES).selectExpr("*", "'mine' AS key", "'mine' AS row", "'mine' AS digest", "1 AS n")
    warc.write(d, f"file://{tmp_path}/w")
    got = {r.metadata.page_id: r.response.payload for r in warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).collect()}
    assert all(got[i] == h.encode() for i, _, h in data[-5:]) and len(got) == len({x[0] for x in data})
    sizes = [sum(len(x) for x in warc.inflate(f.read_bytes())) for f in tmp_path.glob("w/*.gz")]
    assert len(sizes) > 4 and sorted(sizes)[-2] < 4 * (1 << 17)
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parse(warc.inflate(gzip.compress(one) + gzip.compress(one), 7))] == [b"a\r\n\r\n"] * 2
    with pytest.raises(ValueError, match="within a record"):
        list(warc.parse(iter([one + b"WARC/1.1\r\n"])))


def test_warc_many_members_are_read_in_linear_time():
    import gzip
    import time

    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 40\r\n\r\n" + b"x" * 40 + b"\r\n\r\n"
    members, began = gzip.compress(one, 1) * 50_000, time.process_time()
    assert sum(len(b) for _, b in warc.parse(warc.inflate(members))) == 40 * 50_000
    assert time.process_time() - began < 10
    with pytest.raises(ValueError, match="cut short"):
        list(warc.inflate(members[:-9]))


def test_warc_foreign_archives(spark, tmp_path):
    """Of another writer: WARC/1.0, headers in any case and order, chunked members, a record that isn't ours, uncompressed parts within members."""
    import gzip

    body = b"<html>\r\n\r\nWARC/1.0</html>"
    http = b"HTTP/1.1 200 OK\r\ncontent-length: %d\r\n\r\n" % len(body) + body
    rec = lambda kind, ident, block, *more: b"WARC/1.0\r\n" + b"\r\n".join([b"content-length:%d" % len(block), b"warc-type: " + kind, b"WARC-Record-ID:  " + ident, *more]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    digest = b"WARC-Payload-Digest: sha1:" + hashlib.sha1(body).hexdigest().encode()
    parts = [rec(b"warcinfo", b"<i>", b"software: x\r\n"), rec(b"response", b"<a>", http, digest, b"WARC-Target-URI: http://a/"), rec(b"request", b"<b>", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <a>")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(parts[0]) + gzip.compress(parts[1].replace(b"<a>", b"<c>") + parts[2].replace(b"<a>", b"<c>")))
    got = warc.assemble(warc.read(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.response.id, r.response.payload, r.request.id, r.metadata) for r in got) == [("<a>", body, "<b>", None), ("<c>", body, "<b>", None)]


def test_warc_names_rows_by_their_place_in_files(spark, tmp_path):
    spark.createDataFrame(pages() * 5, PAGES).repartition(3).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    keys = [r.key for r in warc.identified(p).collect()]
    assert len(set(keys)) == len(keys) == 5 * len(pages()) and all("#" in k for k in keys)
    got = warc.captures(p).collect()
    assert len(got) == 5 * len(pages()) and sum(r.record_type == "revisit" for r in got) == 5 * 4


# 3 sharding


def test_shards_are_contiguous_and_balanced(spark):
    data = documents(150)
    d = frame(spark, data).withColumn("bytes", sharding.text_size(F.col("text"))).withColumn("crc", sharding.text_crc32(F.col("text")))
    got = sharding.shard_by_bytes(d, ["doc_id", "crc"], "bytes", 5).collect()
    assert len(got) == len(data) and set(got[0].asDict()) == {*d.columns, "shard", "slot"}
    assert sorted(r.bytes for r in got) == sorted(len((x[1] or "").encode()) + 8 for x in data)
    assert all(r.crc == zlib.crc32((r.text or "").encode()) for r in got)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.bytes
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(5))
    longest = max(r.bytes for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * longest
    assert sharding.shard_by_bytes(frame(spark, []).withColumn("bytes", F.lit(8)), ["doc_id"], "bytes", 5).count() == 0


# 4 decontamination


def items(data):
    w = data[2][1].split(), data[6][1].split()
    return [(1, " ".join(w[0][:20])), (10, " ".join(w[1][-14:])), (2, None), (3, ""), (4, "..."), (5, data[4][1].split()[0]), (6, " ".join(w[0][3:9])), (6, "zzz yyy"), (None, " ".join(w[1][:3])), (7, data[8][1].upper())]


def test_contamination_against_brute_force(spark):
    data = documents(60)
    it = items(data)
    bench = spark.createDataFrame(it, "item_id long, text string")
    want = sorted(map(repr, brute.contamination([(d[0], d[1]) for d in data], [("" if i is None else i, t) for i, t in it])))
    for block in (decontam.BLOCK_WORDS, 30):  # one block, and several passes
        got = decontam.contamination(frame(spark, data), bench, block_words=block)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    none = decontam.contamination(frame(spark, data), bench.limit(0)).collect()
    assert len(none) == len(data) and not any(r.n_hit or r.contaminated for r in none)
    assert decontam.contamination(frame(spark, []), bench).count() == 0


def test_clean_judges_each_row_by_its_own_text(spark):
    data = documents(60)
    it = items(data)
    data += [(2, "clean words that no benchmark has " * 3, "en", "a", 1), (None, data[2][1], "en", "a", 1)]  # one number, two texts
    bench = spark.createDataFrame(it, "item_id long, text string")
    bad = [r[5] for r in brute.contamination([(d[0], d[1]) for d in data], [("" if i is None else i, t) for i, t in it])]
    docs = frame(spark, data)
    for block in (decontam.BLOCK_WORDS, 30):
        got = decontam.clean(docs, bench, block_words=block)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((d[0], d[1]) for d, b in zip(data, bad, strict=True) if not b)
    assert any(bad) and decontam.clean(frame(spark, []), bench).count() == 0


def test_windows_shared_by_items_and_equal_hashes(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    it = [(i, passage + f" own{i}") for i in range(50)]
    data = [(1, "x " + passage), (2, passage.replace("w17", "v17"))]
    bench = spark.createDataFrame(it, "item_id long, text string")
    want = sorted(map(repr, brute.contamination(data, it)))
    got = decontam.contamination(spark.createDataFrame(data, "doc_id long, text string"), bench)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    # words whose hashes are all the same differ by their bytes still
    monkeypatch.setattr(decontam, "hash_runs", lambda data, start, end: np.ones(len(start), np.uint64))
    w = decontam.Windows(["1"], [passage], np.empty(0, np.uint64), np.empty(0, np.int64), 13)
    import pyarrow as pa

    cover, pairs = w.hits(decontam.Words(pa.array([passage, passage.replace("w", "v")])))
    assert (cover > 0).tolist() == [True] * 30 + [False] * 30 and pairs.tolist() == [[0, 0]]


# 5 near duplicates


def test_jaccard_components_against_brute_force(spark):
    data = documents(160, seed=9)
    got = ngram_join.jaccard_components(frame(spark, data)).collect()
    assert len(got) == len(data)
    named = [(d[0], d[1]) for d in data if d[0] is not None]
    want = brute.components(named)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((d, len(brute.shingle_set(t)), want[d]) for d, t in named)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len(set(want.values())) < len(want) - 10
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_one_of_each_class_stays_whatever_the_numbers(spark):
    data = documents(100, seed=9) + [(7, documents(100, seed=9)[60][1], "en", "a", 1), (None, "a b c d e f", "en", "a", 1), (None, "a b c d e f", "en", "a", 1)]
    root = brute.components([(i, d[1]) for i, d in enumerate(data)])
    classes = defaultdict(list)
    for i, d in enumerate(data):
        classes[root[i]].append((d[0] is None, d[0] or 0))
    docs = frame(spark, data)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(min(x) for x in classes.values())
    assert ngram_join.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("k", [8, 9, 10, 11])
def test_patterned_long_words_are_apart(spark, k):
    """A Thue-Morse word and its complement have equal sums of powers modulo 2^64, whatever the base."""
    word = "a"
    for _ in range(k):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    data = [(1, word, "", "", 0), (2, other, "", "", 0), (3, " ".join([word] * 6), "", "", 0), (4, " ".join([other] * 6), "", "", 0), (5, word, "", "", 0)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(data, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_several_texts_of_one_number_are_pooled(spark):
    t = ["a b c d e f g h", "q w e r t y u i", "z x c v b n m l"]
    data = [(5, t[0], "", "", 0), (5, t[1], "", "", 0), (3, t[1], "", "", 0), (7, t[2], "", "", 0), (5, t[2], "", "", 0)]
    assert {r.component_id for r in ngram_join.jaccard_components(frame(spark, data)).collect()} == {3}


def test_links_survive_blocks_and_flushes(spark, monkeypatch):
    """A chain in which neighbours are linked and ends are not, over small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    r = random.Random(1)
    w = [f"w{i}" for i in range(150)]
    data = []
    for i in range(60):
        data.append((100 + i, " ".join(w), "", "", 0))
        w[r.randrange(len(w))] = f"n{i}"
    got = ngram_join.jaccard_components(frame(spark, data, False)).collect()
    want = brute.components([(d[0], d[1]) for d in data])
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 13, 40, 200, 1000])
def test_every_linked_pair_shares_a_signature(n):
    g = np.random.default_rng(n)
    for _ in range(60):
        a = np.unique(g.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(g.integers(0, n // 5 + 1))
        keep = g.permutation(a)[: len(a) - gone]
        new = int(g.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([keep, g.integers(0, 1 << 63, new).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and len(b):
            sig, owner = ngram_join.signatures([a, b])
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_bands_have_deletion_segments_where_they_are_cheaper():
    kinds = [ngram_join.allocation(ngram_join.band_of(n)[2])[1] for n in (5, 12, 30, 100, 1000)]
    assert max(kinds) > 0 and kinds[-1] == 0


# 6 packing


def test_packing_is_lossless(spark):
    data = documents(80)
    out = packing.pack(frame(spark, data), 64).collect()
    enc = packing.encoder(packing.VOCABULARY)
    want = Counter((d[0], *enc.encode_ordinary(d[1] or ""), packing.end_token(packing.VOCABULARY)) for d in data)
    pieces = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and (ids[r.n_tokens :] == packing.end_token(packing.VOCABULARY)).all()
        p = np.frombuffer(r.positions, "<u4")
        assert p.tolist() == packing.positions(r.cu_seqlens, 64).tolist()
        for k, (d, at) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert p[a] == 0 and list(p[a:b]) == list(range(b - a))
            pieces[d].append((at, tuple(ids[a:b].tolist())))
    tokens = Counter()
    for (d, *t), n in want.items():
        tokens[d] += n * len(t)
    assert {d: sum(len(x) for _, x in v) for d, v in pieces.items()} == dict(tokens)
    single = [d for d in pieces if sum(n for k, n in want.items() if k[0] == d) == 1]
    for d in single:
        assert (d, *[x for _, t in sorted(pieces[d]) for x in t]) in want
    assert packing.pack(frame(spark, []), 64).count() == 0


def test_best_fit_takes_the_fullest_row():
    lengths = np.array([6, 5, 4, 3, 2])
    assert [sorted(lengths[r].tolist()) for r in packing.best_fit_decreasing(lengths, 10)] == [[4, 6], [2, 3, 5]]
    rng = np.random.default_rng(3)
    n = rng.integers(1, 101, 3000)
    got = packing.best_fit_decreasing(n, 100)
    assert sorted(i for r in got for i in r) == list(range(3000)) and max(n[r].sum() for r in got) <= 100 and len(got) <= 1.02 * n.sum() / 100 + 1


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(5)
    for n in (rng.integers(1, 65, 400), np.array([64, 64, 1]), np.array([], np.int64)):
        room, want = [], []
        for i in np.argsort(-n, kind="stable").tolist():
            fits = [k for k in range(len(room)) if room[k] >= n[i]]
            if fits:
                least = min(room[k] for k in fits)
                k = [k for k in fits if room[k] == least][-1]
            else:
                k = len(room)
                room.append(64)
                want.append([])
            room[k] -= n[i]
            want[k].append(i)
        got = packing.best_fit_decreasing(n, 64)
        # rows with equal room are interchangeable, so their contents may be swapped
        assert sorted(i for r in got for i in r) == list(range(len(n))) and sorted(int(n[r].sum()) for r in got) == sorted(int(n[r].sum()) for r in want)


def test_wide_vocabularies_take_four_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "id_type", lambda path: "<u4")
    d = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    table = __import__("pyarrow").table({"part": [0], "doc": [1], "ids": [np.array([70000, 5, 9], "<u4").tobytes()]})
    got = packing._pack(8, packing.VOCABULARY)(table).to_pylist()[0]
    assert np.frombuffer(got["ids"], "<u4")[:3].tolist() == [70000, 5, 9] and got["n_tokens"] == 3
    monkeypatch.undo()
    out = packing.write(packing.pack(d, 16), f"file://{tmp_path}/rows")
    assert rows(out) == rows(packing.pack(d, 16))


# 7 licences


def test_license_scan(spark):
    body = "Some words here.\nRELEASED   under the MIT licence\nmore"
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.replace("copyright holders", "copyright owners").replace(",", " ,").upper().replace("COPYRIGHT (C)", "Copyright (c)")
    data = [(1, body, "", "", 0), (2, licenses.MIT, "", "", 0), (3, mit, "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0), (6, "nothing", "", "", 0), (6, "nothing", "", "", 0), (None, body, "", "", 0), (7, "intro\n\n" + licenses.ISC + "\n", "", "", 0)]
    got = licenses.scan(frame(spark, data)).collect()
    assert len(got) == len(data)
    found = {r.doc_id: (r.whole, r.licenses) for r in got}
    assert found[1] == (None, "MIT") and found[2][0] == "MIT" and found[3][0] == "MIT" and found[4] == (None, "") and found[5] == (None, "") and found[6] == (None, "") and found[None] == (None, "MIT")
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_scan_drops_long_copyrights_and_rules_first(spark):
    names = "".join(f"Copyright (c) {1900 + i} Some Contributor of the Project <name{i}@example.org>\n" for i in range(100))
    bsd = names + "\n" + licenses.BSD_HEAD + licenses.BSD_THIRD + licenses.BSD_TAIL
    ruled = ("/" + "*" * 3000 + "/\n") + "\n".join("** " + x + " " * 200 + "**" for x in licenses.MIT.split("\n")) + ("\n/" + "*" * 3000 + "/")
    line = "#" * 4000 + " Released under the MIT License. " + "#" * 4000
    data = [(1, bsd, "", "", 0), (2, ruled, "", "", 0), (3, "intro\n" + line, "", "", 0), (4, "word " * 3000, "", "", 0)]
    found = {r.doc_id: (r.whole, r.licenses, r.n_units) for r in licenses.scan(frame(spark, data)).collect()}
    assert found == {1: ("BSD-3-Clause", "BSD-3-Clause", 1), 2: ("MIT", "MIT", 1), 3: (None, "MIT", 1), 4: (None, "", 0)}


def test_license_scan_knows_common_texts_and_takes_a_table(spark):
    folder = Path(licenses.__file__).parent / "known_licenses"
    names = sorted(f.stem for f in folder.glob("*.txt"))
    filled = (folder / "Apache-2.0.txt").read_text().replace("[yyyy] [name of copyright owner]", "2024 Someone")
    texts = [(folder / f"{n}.txt").read_text() for n in names] + [filled, "x\nSPDX-License-Identifier: MPL-2.0", "Licensed under CC BY-SA 3.0."]
    got = {r.doc_id: (r.whole, r.licenses) for r in licenses.scan(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()}
    assert {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0"} <= set(names)
    assert [got[i][0] for i in range(len(texts))] == [*names, "Apache-2.0", None, "CC-BY-SA-3.0"] and got[len(texts) - 2][1] == "MPL-2.0"
    table = spark.createDataFrame([("Own", "Do as you like."), ("Other", "do AS you like"), ("Third", "Ask first."), (None, "x"), ("Void", None)], "license string, text string")
    data = [(1, "Do as you like!", "", "", 0), (2, "a\nAsk first\nDo as you like", "", "", 0), (3, licenses.MIT, "", "", 0), (4, None, "", "", 0)]
    found = {r.doc_id: (r.whole, r.licenses, r.n_units) for r in licenses.scan(frame(spark, data), table).collect()}
    assert found == {1: ("Other,Own", "Other,Own", 1), 2: (None, "Other,Own,Third", 2), 3: (None, "", 0), 4: (None, "", 0)}


@pytest.mark.parametrize("above", ["Copyright (c) Facebook, Inc. and its affiliates.", "Copyright (c) <year> <copyright holders>", "# Copyright 2020 X", "Copyright 2020 X\nAll rights reserved.", "/* Copyright The Example Authors. */", "\u00a9 Acme", " * (C) 1999 x", "Copyright: Me\nCopyright [yyyy] [name]"])
def test_copyright_lines_are_no_terms(above):
    assert licenses.canonical(above + "\n\n" + licenses.MIT) == licenses.canonical(licenses.MIT)
    kept = "copyright notice and this permission notice\ncopyright law\n(c) You must retain\nall rights reserved by others"
    assert licenses.canonical(kept) == "copyright notice and this permission notice copyright law c you must retain all rights reserved by others"


def plain_scan(text, table):
    text = text or ""
    units = {text} | {u for cut in ("\n[\x20\t\r]*\n", "\n") for u in re.split(cut, text) if u}
    forms = Counter(licenses.canonical(u) for u in units)
    found = {table[f] for f in forms if f in table}
    return table.get(licenses.canonical(text)), ",".join(sorted(found)), sum(n for f, n in forms.items() if f in table)


def test_license_scan_against_a_plain_version(spark):
    r = random.Random(12)
    table = {c: n for c, n in ((licenses.canonical(t), n) for n, t in reversed(licenses.KNOWN))}
    table.pop("", None)
    short = [t for _, t in licenses.KNOWN if len(t) < 3000]
    line = lambda: r.choice(["", " ", "\t", "Copyright (c) Someone", "# Copyright 2001 A, B", "All rights reserved.", "some other words", "(c) you may", r.choice(short), r.choice(short).upper(), "// " + r.choice(short).replace("\n", "\n// "), r.choice(short).replace("license", "licence")])
    data = [(i, "\n".join(line() for _ in range(r.randint(1, 5))), "", "", 0) for i in range(150)]
    data += [(200 + i, r.choice(["", "Copyright \u00a9 Me\n\n"]) + t, "", "", 0) for i, (_, t) in enumerate(r.sample(licenses.KNOWN, 40))] + [(300, None, "", "", 0), (301, "", "", "", 0)]
    got = {x.doc_id: (x.whole, x.licenses, x.n_units) for x in licenses.scan(frame(spark, data)).collect()}
    assert got == {i: plain_scan(t, table) for i, t, *_ in data} and sum(g[0] is not None for g in got.values()) > 40


def test_canonical_forms_agree(spark):
    texts = [t for _, t in licenses.KNOWN] + ["Sub-Licence, AND/OR  copyright owner ©", "(c) 2001 x\nCopyright 1999 y\nkeep copyright"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(licenses.canonical_column(F.col("t"))).collect()] == [licenses.canonical(t) for t in texts]


# 8 secrets


def secrets():
    r = random.Random(3)
    parts = ["password = hunter2hunter2", "passwd:abc", "TOKEN='" + "Ab1/" * 9 + "'", "api-key: no", "apikey=0123456789abcdef0123", "AKIA" + "A1" * 8, "AKIAAKIA", "AKIA" + "Z" * 30, "deadbeef" * 3, "abcdef",
             "secret: token=abcdefghijklmnop", "password=token: abcdefghijklmnop", "é日", "client_id = user-77", "https://api.example.com/v1", "x" * 30, "aB3" * 15, "\n", "postgres://db.example.org:5432/main"]
    return [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 14))), "", "", 0) for i in range(120)] + [(200, None, "", "", 0), (201, "", "", "", 0), (5, "token=" + "q" * 400, "", "", 0), (None, "AKIA" + "B" * 20, "", "", 0)]


def test_base_secrets_against_brute_force(spark):
    data = secrets()
    got = secret_scan.report(frame(spark, data)).collect()
    want = Counter((d[0], *(brute.base_secrets(d[1])[i] for i in (0, 1, 2, 4))) for d in data)
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        base = {x for d in data if d[0] == r.doc_id for x in brute.base_secrets(d[1])[3].split(",") if x}
        assert {x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")} <= base
    assert secret_scan.report(frame(spark, [])).count() == 0


def test_weak_parts_need_their_complements(spark):
    opaque, ident, url = "aB3dE" * 8, "client_id = user-77", "https://api.example.com/v1"
    data = [(1, f"{ident} and {opaque}"), (2, opaque), (3, ident), (4, url), (5, f"{url} {ident} {opaque}"), (6, f"{ident} {'y ' * 400} {opaque}"), (7, f"{url} {ident}"), (8, f"password = hunter2hunter2 {ident}")]
    got = {r.doc_id: {x.split(":")[0] for x in r.spans.split(",") if x} for r in secret_scan.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: {"ident", "opaque"}, 2: set(), 3: set(), 4: set(), 5: {"ident", "opaque", "endpoint"}, 6: set(), 7: set(), 8: {"assign", "ident"}}


def test_scope_is_the_gap_whatever_the_offset_and_length(spark):
    secrets, idents = ["password=abcdefghijklmnop", "password=" + "zY9/" * 300], ["client_id = user-77", "client_id = " + "user-77." * 150]
    data, want = [], {}
    for secret in secrets:
        for ident in idents:
            for gap in (1, 300, 385, 399, 400, 401, 450):
                for at in (0, 1, 15, 199, 398, 399, 400, 777):
                    for a, b in ((secret, ident), (ident, secret)):
                        want[len(data)] = {"assign", "ident"} if gap <= 400 else {"assign"}
                        data.append((len(data), " " * at + a + " " * gap + b))
    url = "https://h.example/" + "p" * 1500
    for at in (0, 399):  # a long candidate that touches a base finding far from its start; one that only ends near
        want[len(data)] = {"assign", "ident"}
        data.append((len(data), " " * at + url + "?token=abcdefghijklmnop client_id = user-77"))
        want[len(data)] = {"assign", "ident", "endpoint"}
        data.append((len(data), " " * at + url + " token=abcdefghijklmnop client_id = user-77"))
    got = {r.doc_id: {x.split(":")[0] for x in r.spans.split(",") if x} for r in secret_scan.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want


def test_opaque_strings_have_their_classes_anywhere(spark):
    ident = "client_id = user-77 "
    data = [(1, ident + "aB" * 40 + "7"), (2, ident + "z7" * 500 + "B"), (3, ident + "B7" * 30 + "a/"), (4, ident + "aB" * 40), (5, ident + "aB7" * 10)]
    got = {r.doc_id: {x.split(":")[0] for x in r.spans.split(",") if x} for r in secret_scan.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {k: "opaque" in v for k, v in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False}


# 9 quality


def test_quality_counts_against_brute_force(spark):
    data = documents(100) + [(300, "a b c d e f g h " * 5, "en", "a", 0), (301, "w " * 8, "en", "a", 0), (302, "# $x\n# $x\n\n\n \n# $x", "en", "a", 0), (303, "w " * 400, "de", "a", 0)]
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(0, 90)] + [(4, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark, data).drop("quality"), labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((d[0], *brute.quality(d[1])) for d in data)
    assert not any(r.kept and r.base_failed for r in got)
    bare = quality.judge(frame(spark, data), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in bare)
    assert quality.judge(frame(spark, []), labels).count() == 0
    kept = quality.keep(frame(spark, data), labels)
    assert set(kept.columns) == set(frame(spark, []).columns) and kept.count() == sum(r.kept for r in got)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 10), (3, 40), (10, 10), (25, 900), (0, 5000)]
    d = spark.createDataFrame(cases, "k long, n long")
    for (k, n), r in zip(cases, d.select(quality.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect(), strict=True):
        assert r[0] == pytest.approx(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)), rel=1e-9)


RULES = "symbols double, capitals double, word_length double, repeats double"


def labelled(spark, data):
    """(key's number, stratum, quality, base_failed, symbols, capitals) rows; keys begin with the number's last digit."""
    rows = [(f"{i % 10}{i}", s, q, f, a, b, 5.0, 0.0) for i, s, q, f, a, b in data]
    return spark.createDataFrame(rows, f"text_key string, stratum string, quality int, base_failed boolean, {RULES}")


def test_cutoffs_are_certified_only_with_enough_evidence(spark):
    data = [(i, "many", 1, False, 0.0, 0.0) for i in range(2000)] + [(i, "many", 0, False, 0.3, 0.0) for i in range(2000, 2100)]
    data += [(i, "few", 1, False, 0.0, 0.0) for i in range(40)] + [(i, "few", 0, False, 0.3, 0.0) for i in range(40, 60)]
    data += [(i, "mixed", 1, False, 0.3 if i % 7 == 0 else 0.0, 0.0) for i in range(2000)] + [(i, "mixed", 0, False, 0.3, 0.0) for i in range(2000, 2100)]
    # copies are one trial: 40 texts, each 100 times
    data += [(i, "copies", 1, False, 0.0, 0.0) for i in range(40)] * 100 + [(i, "copies", 0, False, 0.3, 0.0) for i in range(40, 60)] * 100
    # what fails the base test isn't the rules' to judge
    data += [(i, "based", 1, False, 0.0, 0.0) for i in range(2000)] + [(i, "based", 1, True, 0.3, 0.0) for i in range(2000, 2500)] + [(i, "based", 0, False, 0.3, 0.0) for i in range(2500, 2600)]
    got = rows(quality.cutoffs(labelled(spark, data), quality.Risk()))
    assert got == [("based", "symbols", 0.02), ("many", "symbols", 0.02)]
    assert quality.cutoffs(labelled(spark, []), quality.Risk()).count() == 0


def test_the_union_of_rules_is_what_is_certified(spark):
    """Two rules that each reject 1.2 % of the good documents, other ones: either alone passes at 2 %, both together don't."""
    good = [(i, "s", 1, False, 0.3 if 0 <= i % 1000 < 12 else 0.0, 0.3 if 500 <= i % 1000 < 512 else 0.0) for i in range(10000)]
    bad = [(20000 + i, "s", 0, False, 0.3, 0.0) for i in range(150)] + [(30000 + i, "s", 0, False, 0.0, 0.3) for i in range(100)]
    got = rows(quality.cutoffs(labelled(spark, good + bad), quality.Risk()))
    assert got == [("s", "symbols", 0.02)]
    looser = rows(quality.cutoffs(labelled(spark, good + bad), quality.Risk(alpha=0.04)))
    assert looser == [("s", "capitals", 0.2), ("s", "symbols", 0.02)]


def test_certified_rules_reject_documents(spark):
    """Texts, labels and languages of about the size of the small tables; the rules must reach the verdicts."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    data = [(i, " ".join(word() + (" # $" if i % 8 == 0 else "") for _ in range(40)), r.choice(["en", "en", "de"]), "a", 0) for i in range(2400)]
    marks = [(i, 0 if i % 8 == 0 else 1, 0) for i in range(2400)]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(data, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert not any(x.base_failed for x in got.values())
    assert all(got[i].kept == (i % 8 != 0) for i in got)


# 10 chat


def conversations():
    r = random.Random(2)
    bits = ["\\", "<", "/turn>", "</turn>", "###", "### ", "#", "####", "\n", ": ", "Assistant", "é日", "x", "", "\\/", "<\\/turn>", "$1", "\\n"]
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for c in range(60) for t in range(r.randint(1, 5))]
    return rows + [(60, 0, None, None), (61, None, "user", "a"), (61, None, "user", "a"), (61, 0, "assistant", "b"), (None, 1, "assistant", "c"), (62, 0, "a: b\\### </turn>:", "d"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def test_chat_round_trip(spark):
    data = conversations()
    got = chat.digests(chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "'x' AS escaped"))).collect()
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.round_trip and (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), sha(loss))
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_loss_mask_is_ranges_of_the_formatted_text(spark):
    d = chat.format_conversations(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    for r in d.withColumn("mask", chat.loss_mask(F.col("formatted"))).collect():
        cut = [r.formatted[a:b] for a, b in r.mask]
        assert [chat_plain(x) for x in cut] == [t.text for t in r.turns if t.role == "assistant"]
        assert all(r.formatted[b:].startswith("</turn>") and r.formatted[:a].endswith("### assistant: ") for a, b in r.mask)


def chat_plain(escaped):
    import re

    return re.sub(r"(?s)\\(.)", r"\1", escaped)


def test_very_long_conversations(spark):
    data = [(1, 0, "assistant", "é### </turn>" * 60000), (1, 1, "user", "u")] + [(2, i, "assistant" if i % 2 else "user", f"日{i} ###") for i in range(3000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        loss = "".join(x[3] for x in data if x[0] == c and x[2] == "assistant")
        assert got[c].round_trip and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_formatted_text_has_no_raw_control_strings(spark):
    d = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(d).collect():
        assert r.formatted.count("</turn>") == len(r.turns) and r.formatted.count("###") == len(r.turns)
