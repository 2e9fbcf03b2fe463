"""The sound data source: ranges by seeking, files by a two-phase commit."""

import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from speechlake.operators import signal as G
from speechlake.sources import media as M
from speechlake.sources import pcm as P


def tone(n, seed=0):
    return np.random.default_rng(seed).uniform(-1.2, 1.2, n).astype(np.float32)


class Counted:
    def __init__(self, file, log):
        self.file, self.log = file, log

    def read_at(self, n, at):
        self.log.append((at, n))
        return self.file.read_at(n, at)


def test_a_range_of_a_long_file_reads_its_bytes_alone(tmp_path, monkeypatch):
    long = tmp_path / "long.wav"
    n = (3 << 30) // 2 - 22
    with open(long, "wb") as f:  # sparse
        f.write(P.header(n & 0x7FFFFFFF, 16000))
        f.seek(44 + 2 * 16000 * 50_000)
        f.write(np.arange(16000 * 10, dtype="<i2").tobytes())
        f.truncate(3 << 30)
    log, real = [], P.layout
    monkeypatch.setattr(P, "layout", lambda file, size: real(Counted(file, log), size))
    samples = P.read_samples
    monkeypatch.setattr(P, "read_samples", lambda file, *a: samples(Counted(file, log), *a))
    r = P.PcmReader({"path": str(long), "start": "50000", "seconds": "10"})
    got = [b for p in r.partitions() for b in r.read(p)]
    assert len(got) == 1 and np.array_equal(got[0].column("samples")[0].values.to_numpy(), np.arange(160000, dtype="<i2").astype(np.float32) / 32768)
    assert sum(n for _, n in log) <= 2 * 160000 + 100
    every = P.PcmReader({"path": str(long)}).partitions()
    assert len(every) > 40 and all((hi - lo) * 4 * P.CHUNK <= P.PART_BYTES for p in every for _, _, lo, hi in p.parts)


def test_conditions_are_pushed(tmp_path):
    for k in range(3):
        tone(P.CHUNK * 2 + 7, k).tofile(tmp_path / f"{k}.pcm")
    r = P.PcmReader({"path": str(tmp_path)})
    other = StringContains(("path",), "x")
    assert list(r.pushFilters([GreaterThanOrEqual(("chunk",), 1), LessThan(("chunk",), 2), In(("path",), (f"{tmp_path}/1.pcm", "z")), other])) == [other]
    assert [p for x in r.partitions() for p in x.parts] == [(f"{tmp_path}/1.pcm", 4 * (P.CHUNK * 2 + 7), 1, 2)]
    r = P.PcmReader({"path": str(tmp_path)})
    assert list(r.pushFilters([EqualTo(("chunk",), 2)])) == [] and {p[2:] for x in r.partitions() for p in x.parts} == {(2, 3)}


def test_reading_equals_whole_files_cut(spark, tmp_path):
    x, y = tone(P.CHUNK + 100, 1), tone(5000, 2)
    x.tofile(tmp_path / "a.pcm")
    (tmp_path / "b.wav").write_bytes(b"RIFF\0\0\0\0WAVELIST\x03\0\0\0abc\0" + G.pcm16_wav(y)[36:])
    (tmp_path / "empty.pcm").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    for start, seconds in ((0.0, None), (0.1, 0.05), (29.9, 1.0), (99.0, 1.0)):
        got = {}
        for r in P.read_audio(spark, f"file://{tmp_path}", start, seconds).orderBy("path", "chunk").collect():
            got.setdefault(os.path.basename(r.path), []).extend(r.samples)
        want = {f: M.cut_wav((tmp_path / f).read_bytes(), start, seconds).tolist() for f in ("a.pcm", "b.wav", "empty.pcm")}
        assert got == want
    d = P.read_audio(spark, f"file://{tmp_path}").where("chunk = 1")
    assert [len(r.samples) for r in d.collect()] == [100]
    assert "Filter " not in d._jdf.queryExecution().executedPlan().toString()


def chunked(spark, sounds, size=700):
    rows = [(n, k // size, x[k : k + size].tolist()) for n, x in sounds.items() for k in range(0, max(1, len(x)), size)]
    return spark.createDataFrame(rows, "name string, chunk int, samples array<double>").repartition(5)


def test_files_are_written_bit_for_bit(spark, tmp_path):
    sounds = {"a": tone(3000, 3), "b ü": tone(1, 4), "none": tone(0)}
    for form in ("wav", "raw"):
        out = tmp_path / form
        P.write_audio(chunked(spark, sounds), f"file://{out}", form)
        end = ".wav" if form == "wav" else ".pcm"
        assert {f.name: f.read_bytes() for f in out.iterdir()} == {n + end: G.pcm16_wav(x) if form == "wav" else x.tobytes() for n, x in sounds.items()}
    with wave.open(str(tmp_path / "wav" / "a.wav")) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (1, 16000, 2, 3000)
    back = {r.path.rsplit("/", 1)[1]: r.samples for r in P.read_audio(spark, f"file://{tmp_path}/raw").collect()}
    assert back == {n + ".pcm": x.tolist() for n, x in sounds.items()}


def test_failures_leave_no_files(spark, tmp_path):
    out = f"file://{tmp_path}/o"
    P.write_audio(chunked(spark, {"a": tone(3000, 3)}), out)
    before = (tmp_path / "o" / "a.wav").read_bytes()
    bad = chunked(spark, {"b": tone(900), "c": tone(900)}).withColumn("chunk", F.when((F.col("name") == "c") & (F.col("chunk") == 1), F.raise_error(F.lit("lost"))).otherwise(F.col("chunk")))
    for d in (bad, chunked(spark, {"a": tone(9)}), chunked(spark, {"x/y": tone(9)}), chunked(spark, {"b": tone(9)}).union(chunked(spark, {"b": tone(9)}))):
        with pytest.raises(Exception):
            P.write_audio(d, out)
    assert {f.name: f.read_bytes() for f in (tmp_path / "o").iterdir()} == {"a.wav": before}
    P.write_audio(chunked(spark, {"z": tone(5)}), out, mode="overwrite")
    assert [f.name for f in (tmp_path / "o").iterdir()] == ["z.wav"]
