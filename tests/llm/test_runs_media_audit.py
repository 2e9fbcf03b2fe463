"""Operators 11 to 13 against plain versions."""

import hashlib
import itertools
import random
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.llm import filter_audit, media_columns, periodic

from . import brute
from .data import documents, frame


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# 11 periodic runs


def plain_runs(w, least=12):
    """All runs by trying every period on every stretch; {(start, end): smallest period}."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        t = 0
        while t + p < len(w):
            if w[t] != w[t + p]:
                t += 1
                continue
            s = t
            while t + p < len(w) and w[t] == w[t + p]:
                t += 1
            if t + p - s >= max(least, 2 * p):
                found.setdefault((s, t + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_report(doc_id, text):
    w = brute.words(text)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and w:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    out = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in out)))


def report(spark, rows, extra=False):
    d = frame(spark, rows, extra) if extra else spark.createDataFrame(rows, "doc_id long, text string")
    found = periodic.find_runs(d.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text"))))
    return sorted(map(tuple, periodic.digests(found).collect()), key=repr)


def test_runs_of_random_words():
    r = random.Random(3)
    for case in range(300):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.choice([0, 1, 11, 12, 13, 40, 90]))]
            if r.random() < 0.5 and w:
                w = w[: r.randint(1, len(w))] * r.randint(2, 6)
            texts.append(w)
        count = np.array([len(w) for w in texts])
        ids, begin = [1000], []
        for k, w in enumerate(texts):
            begin.append(len(ids))
            ids += [*w, 1001 + k]
        least = r.choice([2, 5, 12])
        s, e, p = periodic.runs_of(np.array(ids), np.array(begin), count, least)
        want = sorted((b + x, b + x + n, q) for b, w in zip(begin, texts, strict=True) for x, n, q in plain_runs(w, least))
        assert list(zip(s.tolist(), e.tolist(), p.tolist(), strict=True)) == want, (case, texts)


def test_long_run_in_small_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "_CHUNK", 50)
    w = list(range(7)) + [1, 2, 1, 2, 3] * 30 + [9] * 20
    s, e, p = periodic.runs_of(np.array([900, *w, 901]), np.array([1]), np.array([len(w)]))
    assert [(a - 1, b - a, q) for a, b, q in zip(s, e, p, strict=True)] == plain_runs(w)


def test_periodic_report_of_awkward_rows(spark):
    r = random.Random(8)
    data = documents(70)
    data += [(900 + i, " ".join(r.choice("aé") for _ in range(r.randint(0, 90))), None, None, 0) for i in range(60)]
    data += [(2000, "x " * 3000, "en", "a", 1), (2001, "a b\n" * 5 + "c" * 9000, "en", "a", 1), (2002, " ".join(f"{i % 997}" for i in range(5000)), "en", "a", 1)]
    got = report(spark, data, True)
    assert got == sorted((plain_report(d[0], d[1]) for d in data), key=repr)
    assert sum(g[1] > 0 for g in got) > 20 and any(zlib.crc32(str(g[0]).encode()) % 10 == 0 and g[1] for g in got)


def test_periodic_general_interface(spark):
    d = spark.createDataFrame([("k", "a b a b a b z", 7)], "key string, words string, runs int")
    got = periodic.find_runs(d, "words", least=4).collect()
    assert [(r.key, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [("k", [(0, 6, 2)], "a b z")]
    assert report(spark, []) == []


# 12 media columns


def plain_payload(text):
    b = (text or "").encode()
    return b + b"\0" * (-len(b) % 64 or (0 if b else 64))


@pytest.mark.parametrize("n", [64, 128, 64 * 37, 64 * 5000])
def test_image_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = media_columns.encode(data)
    assert media_columns.decode(media) == data and media_columns.header(media[:33]) == (64, n // 64, 8, 0)
    with pytest.raises(ValueError):
        media_columns.decode(media[:60] + bytes([media[60] ^ 1]) + media[61:])
    with pytest.raises(ValueError):
        media_columns.header(b"\0" * 40)
    with pytest.raises(ValueError):
        media_columns.encode(data[:-1])


def test_media_columns_of_awkward_rows(spark):
    data = [*documents(60), (500, "y" * 64, None, None, 1), (501, "y" * 63, None, None, 1), (502, "y" * 65, None, None, 1), (503, "z" * 64 * 4001, None, None, 1), (504, "\0" * 3, None, None, 1)]
    got = media_columns.media_columns(frame(spark, data).repartition(5)).collect()
    assert len(got) == len(data)
    want = Counter((d[0], len((d[1] or "").encode()), hashlib.sha256(plain_payload(d[1])).hexdigest()) for d in data)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == want
    by_digest = {}
    payloads = {hashlib.sha256(plain_payload(d[1])).hexdigest(): plain_payload(d[1]) for d in data}
    for r in got:
        p = payloads[r.digest]
        media = media_columns.encode(p)
        assert r.payload_sha256 == r.digest and (r.payload_bytes, r.tail_crc32) == (len(p), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256, r.length, r.width * r.height) == (len(media), hashlib.sha256(media).hexdigest(), len(media), len(p))
        values = tuple(r[c] for c in r.asDict() if c not in ("doc_id", "n_bytes"))
        assert by_digest.setdefault(r.digest, values) == values  # equal payloads, equal values
        with open(r.shard.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length) == media


def test_shards_are_tar_files_and_hold_each_payload_once(spark, tmp_path):
    data = [(b"a" * 64,)] * 9 + [(bytes([i]) * 128,) for i in range(20)]
    media_columns.write(spark.createDataFrame(data, "payload binary").coalesce(1), f"file://{tmp_path}/t")
    (part,) = tmp_path.glob("t/part-*")
    assert part.stat().st_size % 512 == 0
    with tarfile.open(part) as t:
        found = {m.name: t.extractfile(m).read() for m in t.getmembers()}
    assert {media_columns.decode(v) for v in found.values()} == {p for (p,) in data} and len(found) == 21
    members = media_columns.index(spark, f"file://{tmp_path}/t").collect()
    assert {f"{m.digest}.png" for m in members} == set(found) and {(m.width, m.height) for m in members} == {(64, 1), (64, 2)}
    assert media_columns.media_columns(frame(spark, [])).collect() == []


# 13 filter interaction audit


def plain_audit(data, labels):
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for i, t, *_ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, _, source, _ in data:
        t = t or ""
        w = brute.words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        rows, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_filter_audit_of_awkward_rows(spark):
    r = random.Random(4)
    data = documents(60)
    data += [(300 + i, " ".join(r.choice(["ab", "Cd", "e#", "f"]) * r.randint(1, 2) for _ in range(r.choice([5, 199, 200, 240]))), "en", r.choice(["a", "", None, "q"]), 1) for i in range(40)]
    data += [(700 + i, r.choice(data)[1], "en", r.choice(["a", "b"]), 1) for i in range(30)] + [data[-1]] * 3 + [(data[-1][0], data[-1][1], "en", "zz", 1), (data[-2][0], "other", "en", "a", 1)]
    labels = [(d[0], r.choice([0, 1, None]), r.choice([0, 1, None])) for d in data for _ in range(r.randint(0, 2))] + [(None, 1, 1), (9999, 1, 1)]
    got = filter_audit.report(frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(data, labels)


def test_filter_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.report(frame(spark, []), none).collect() == []
    assert sorted(map(tuple, filter_audit.report(frame(spark, documents(9)), none).collect())) == plain_audit(documents(9), [])
