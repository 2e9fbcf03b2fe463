"""A Spark data source of raw and WAV sound files: ranges read by seeking (SRC-01..03), files written by a two-phase commit (SNK-01/02).

Reading gives rows (path, chunk, samples) of ``CHUNK`` samples each, counted from the range's start. Options: path, start and seconds
(the range; default: all), rate. Work is cut into partitions by byte range, so a long file is read by many tasks and short ones share
one; conditions on path and chunk (=, <, <=, >, >=, in) are pushed into the scan, and what they leave out isn't read. A task reads a
WAV's headers and then only the bytes of its samples. Sound is raw little-endian float32, or mono 16-bit PCM in a WAV.

Writing takes rows (name, chunk, samples, total) in order within a name, all of one name in one task, as ``write_audio`` deals them, and makes a
file of each: format wav (16 bits, clipped, rounded half up) or raw (float32 as it is). Tasks write into a hidden folder; only when all have
ended are the files of the successful attempts moved to their names, so a lost task leaves none and a failed job nothing.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS) by the paths that Spark uses.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

RATE = 16000
CHUNK = 30 * RATE
PART_BYTES = 64 << 20
SUFFIXES = (".wav", ".pcm")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
READ = "path string, chunk long, samples array<float>"
WRITE = "name string, chunk long, samples array<float>, total long"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def layout(file, size: int) -> tuple[str, int, int]:
    """(sample type, offset of the first sample, samples) of an open file, from its headers alone."""
    head = file.read_at(min(12, size), 0)
    if head[:4] != b"RIFF":
        return "<f4", 0, size // 4
    at = 12
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"data":
            return "<i2", at + 8, min(n, size - at - 8) // 2
        at += 8 + n + n % 2
    return "<i2", size, 0


def read_samples(file, kind: str, base: int, first: int, last: int) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    x = np.frombuffer(file.read_at((last - first) * wide, base + first * wide), kind)
    return x.astype(np.float32) / 32768 if kind == "<i2" else x.astype(np.float32)


@dataclass
class Ranges(InputPartition):
    """Chunks [low, high) of files of a size."""

    parts: list[tuple[str, int, int, int]]


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rate = int(options.get("rate", RATE))
        self.first = int(float(options.get("start", 0)) * self.rate)
        seconds = options.get("seconds")
        self.most = None if seconds is None else int(float(seconds) * self.rate)
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value, column = getattr(f, "value", None), getattr(f, "attribute", None)
            if column == ("chunk",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    stop = value + (not isinstance(f, LessThan))
                    self.high = stop if self.high is None else min(self.high, stop)
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {value}
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif not (isinstance(f, IsNotNull) and column in (("path",), ("chunk",), ("samples",))):  # these never are
                yield f

    def _files(self) -> Iterator[tuple[str, int]]:
        system, root = store(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = "" if root == self.path or "://" not in self.path else self.path[: self.path.index("://") + 3]
        for f in sorted(found, key=lambda f: f.path):
            inside = f.path[len(root) :]
            if f.type == fs.FileType.File and (f is info or f.path.lower().endswith(SUFFIXES) and "/_" not in inside and "/." not in inside):
                yield prefix + f.path, f.size

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        held = PART_BYTES
        for path, size in self._files():
            if self.paths is not None and path not in self.paths:
                continue
            # two bytes a sample at least, so no file has more chunks; tasks find where it ends
            samples = max(0, size // 2 - self.first) if self.most is None else self.most
            stop = max(1, -(-samples // CHUNK))
            stop = stop if self.high is None else min(stop, self.high)
            step = max(1, PART_BYTES // (4 * CHUNK))
            for low in range(self.low, stop, step):
                part = (path, size, low, min(stop, low + step))
                cost = min(size, (part[3] - low) * 4 * CHUNK)
                if held + cost > PART_BYTES:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append(part)
                held += cost
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, size, low, high in partition.parts:
            system, name = store(path)
            with system.open_input_file(name) as file:
                kind, base, n = layout(file, size)
                end = n if self.most is None else min(n, self.first + self.most)
                for chunk in range(low, high):
                    a = self.first + chunk * CHUNK
                    b = min(end, a + CHUNK)
                    if a >= b and chunk:
                        break
                    x = read_samples(file, kind, base, a, b) if a < b else np.empty(0, np.float32)
                    yield pa.record_batch([pa.array([path]), pa.array([chunk], pa.int64()), pa.array([x], pa.list_(pa.float32()))], ["path", "chunk", "samples"])


def header(samples: int, rate: int) -> bytes:
    """The 44 bytes before the samples of a mono 16-bit WAV."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * samples, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * samples)


def sample_bytes(samples: np.ndarray, form: str) -> bytes:
    if form == "raw":
        return np.asarray(samples, "<f4").tobytes()
    return np.floor(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767 + 0.5).astype("<i2").tobytes()


@dataclass
class Done(WriterCommitMessage):
    folder: str
    names: list[str]


class PcmWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.form, self.rate = options["path"].rstrip("/"), options.get("form", "wav"), int(options.get("rate", RATE))
        if self.form not in ("wav", "raw"):
            raise ValueError(f"no such form of sound file: {self.form}")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.end = ".wav" if self.form == "wav" else ".pcm"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        system, root = store(self.path)
        folder = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        names: list[str] = []
        now, out, last, left = None, None, -1, 0

        def close() -> None:
            if out is not None:
                out.close()
                if left:
                    raise ValueError(f"{now}: {left} samples are missing of those counted")

        for batch in iterator:
            for name, chunk, samples, total in zip(*(batch.column(c) for c in ("name", "chunk", "samples", "total")), strict=True):
                name, chunk = name.as_py(), chunk.as_py()
                if name != now:
                    close()
                    if not name or "/" in name or name.startswith((".", "_")) or name in names:
                        raise ValueError(f"not a file name, or not in one piece: {name!r}")
                    if not names:
                        system.create_dir(folder, recursive=True)
                    now, last, left = name, -1, total.as_py()
                    names.append(name)
                    out = system.open_output_stream(f"{folder}/{name}{self.end}")
                    if self.form == "wav":
                        out.write(header(left, self.rate))
                if chunk <= last:
                    raise ValueError(f"{name}: chunk {chunk} after {last}")
                x = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.empty(0)
                out.write(sample_bytes(x, self.form))
                last, left = chunk, left - len(x)
        close()
        return Done(folder, names)

    def commit(self, messages: list[Done | None]) -> None:
        system, root = store(self.path)
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        try:
            if len(set(every)) < len(every):
                raise ValueError("a name came to several tasks")
            have = {f.base_name: f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(SUFFIXES)}
            clash = [n for n in every if n + self.end in have]
            if clash and not self.overwrite:
                raise ValueError(f"there already: {clash[:3]}")
            system.create_dir(root, recursive=True)
            for path in have.values() if self.overwrite else ():
                system.delete_file(path)
            for m in done:
                for n in m.names:
                    system.move(f"{m.folder}/{n}{self.end}", f"{root}/{n}{self.end}")
        finally:
            self._clear()

    def abort(self, messages: list[Done | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = store(self.path)
        if system.get_file_info(f"{root}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary-{self.job}")


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PcmWriter:
        return PcmWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcmSource)
    spark.conf.set(PUSHDOWN, "true")


def read_audio(spark: SparkSession, path: str, start: float = 0.0, seconds: float | None = None, rate: int = RATE) -> DataFrame:
    """SRC-01..03: rows (path, chunk, samples) of a range of each raw or WAV file; only its bytes are read."""
    register(spark)
    reader = spark.read.format("pcm").option("start", start).option("rate", rate)
    return (reader if seconds is None else reader.option("seconds", seconds)).load(path)


def write_audio(chunks: DataFrame, path: str, form: str = "wav", rate: int = RATE, mode: str = "append") -> None:
    """SNK-01/02: a file for each name of (name, chunk, samples); mode append (a name that is there is an error) or overwrite."""
    register(chunks.sparkSession)
    total = chunks.groupBy("name").agg(F.sum(F.coalesce(F.size("samples"), F.lit(0))).alias("total"))
    rows = chunks.join(total, "name").select("name", F.col("chunk").cast("long").alias("chunk"), F.col("samples").cast("array<float>").alias("samples"), "total")
    rows.repartition("name").sortWithinPartitions("name", "chunk").write.format("pcm").option("form", form).option("rate", rate).mode(mode).save(path)
