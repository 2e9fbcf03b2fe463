"""Audio sources and sinks (SRC-01..04, SRC-08..12, SNK-01, SNK-10/11, AG-13) and model boundaries (UD-01..06).

Raw and WAV files come in through the sound data source (``pcm``), others through Spark's binary reader. Decoding of compressed media and all neural
models are boundaries: functions over Arrow batches that a user supplies; what is here for them are deterministic stand-ins for tests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pcm import read_audio

RATE = 16000
MEDIA_GLOB = "*.{wav,mp3,m4a,aac,flac,ogg,opus,wma,mp4,mov,mkv,webm,avi,pcm}"
CHUNKS = "path string, chunk long, samples array<float>"
CHUNK = 30 * RATE


def decode_pcm(data: bytes) -> np.ndarray:
    """Raw little-endian float32, or a 16-bit mono WAV at the working rate."""
    if data[:4] == b"RIFF":
        at = 12
        while at + 8 <= len(data):
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"data":
                return np.frombuffer(data[at + 8 : at + 8 + n // 2 * 2], "<i2").astype(np.float32) / 32768
            at += 8 + n + n % 2
        return np.empty(0, np.float32)
    return np.frombuffer(data[: len(data) // 4 * 4], "<f4")


def cut_wav(data: bytes, start: float, seconds: float | None) -> np.ndarray:
    """The samples of a range alone, of raw float32 or a 16-bit mono WAV: only the range's bytes are converted."""
    kind, at, n = "<f4", 0, len(data)
    if data[:4] == b"RIFF":
        kind, at, n, pos = "<i2", 0, 0, 12
        while pos + 8 <= len(data):
            size = int.from_bytes(data[pos + 4 : pos + 8], "little")
            if data[pos : pos + 4] == b"data":
                at, n = pos + 8, min(size, len(data) - pos - 8)
                break
            pos += 8 + size + size % 2
    wide = np.dtype(kind).itemsize
    first = min(int(start * RATE), n // wide)
    count = n // wide - first if seconds is None else min(int(seconds * RATE), n // wide - first)
    x = np.frombuffer(data, kind, count, at + wide * first)
    return x.astype(np.float32) / 32768 if kind == "<i2" else x


def read_media(spark: SparkSession, path: str, start: float = 0.0, seconds: float | None = None, decoder: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """SRC-01/02/04: files as chunk rows of samples of a range. Raw and WAV files are read by the sound data source, the range's bytes alone; a
    decoder for other media takes whole files."""
    if decoder is None:
        return read_audio(spark, path, start, seconds, RATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                x = decoder(content.as_py())[int(start * RATE) :]
                x = x if seconds is None else x[: int(seconds * RATE)]
                for k in range(0, max(1, len(x)), CHUNK):
                    yield pa.record_batch([pa.array([name]), pa.array([k // CHUNK], pa.int64()), pa.array([x[k : k + CHUNK]], pa.list_(pa.float32()))], ["path", "chunk", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", MEDIA_GLOB).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, CHUNKS)


def sample_range(chunks: DataFrame, start: int, end: int | None) -> DataFrame:
    """SRC-03: samples [start, end) of chunk rows; only the chunks that hold some are read. No end, or 0: to the end of the file."""
    lo = max(0, start)
    rows = chunks.where(F.col("chunk") >= lo // CHUNK)
    if end:  # conditions on the chunk alone, which a scan can take over
        rows = rows.where(F.col("chunk") <= (end - 1) // CHUNK)
    first = F.greatest(F.lit(0), lo - F.col("chunk") * CHUNK).cast("int")
    last = F.size("samples") if not end else F.least(F.size("samples"), (end - F.col("chunk") * CHUNK).cast("int"))
    return rows.withColumn("samples", F.slice("samples", first + 1, F.greatest(F.lit(0), last - first)))


def small_files(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """SRC-11: whole files of at most 1 GiB; the size is checked from the listing before anything is read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most)


def integrity(files: DataFrame, expected: DataFrame) -> DataFrame:
    """SRC-12: (name, ok): required files that are there with their size and, where given, SHA-256."""
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found"), F.sha2("content", 256).alias("digest"))
    j = expected.join(f, "name", "left")
    return j.select("name", F.coalesce((F.col("found") == F.col("bytes")) & (F.col("sha256").isNull() | (F.col("sha256") == F.col("digest"))), F.lit(False)).alias("ok"))


def hotwords(lines: DataFrame) -> DataFrame:
    """SRC-10: trimmed words, blanks dropped."""
    return lines.select(F.trim("value").alias("word")).where("word != ''")


def read_settings(spark: SparkSession, path: str) -> dict:
    """SRC-09: a JSON object of settings; a missing or broken file gives none."""
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except (AnalysisException, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def write_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """SRC-09: settings are one small object, written as text where ``read_settings`` finds it."""
    spark.createDataFrame([(json.dumps(settings, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_pcm(chunks: DataFrame, path: str) -> None:
    """SNK-01: chunk rows (path, chunk, samples) as files that ``sample_range`` reads again: float32 arrays, in order within a file."""
    chunks.select("path", "chunk", F.col("samples").cast("array<float>").alias("samples")).repartition("path").sortWithinPartitions("path", "chunk").write.parquet(path)


def directory_bytes(spark: SparkSession, path: str) -> DataFrame:
    """AG-13: (files, bytes) below a folder, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def complete_sets(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """SRC-12: (model, folder): for each model the first folder (by its place) that has all of its files.

    ``files`` (folder, place, name, bytes), ``catalogue`` (model, name, bytes; null: any size).
    """
    fits = F.col("c.bytes").isNull() | (F.col("c.bytes") == F.col("f.bytes"))
    have = files.alias("f").join(catalogue.alias("c"), (F.col("f.name") == F.col("c.name")) & fits).groupBy("c.model", "f.folder", "f.place").agg(F.countDistinct("c.name").alias("n"))
    need = catalogue.groupBy("model").agg(F.countDistinct("name").alias("n"))
    return have.join(need, ["model", "n"]).groupBy("model").agg(F.min_by("folder", "place").alias("folder"))


MANIFEST = (
    "schemaVersion int, dataset struct<name:string,language:string,license:string,consent:string,annotationStatus:string>, recordings array<struct<id:string,audio:string,"
    "cases:array<struct<id:string,start:double,end:double,overlapStart:double,overlapEnd:double,references:array<struct<speaker:string,text:string>>>>>>"
)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: evaluation manifests flattened to one row per case, as ``validate_cases`` takes them."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.col("dataset.name").alias("dataset"), F.explode("recordings").alias("r"))
    c = m.select("dataset", F.col("r.id").alias("recording_id"), F.col("r.audio").alias("audio"), F.explode_outer("r.cases").alias("c"))
    ref = lambda i, f: F.try_element_at("c.references", F.lit(i))[f]
    return c.select(
        "dataset", "recording_id", "audio", F.col("c.id").alias("case_id"), F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"), F.col("c.overlapStart").alias("overlap_start"),
        F.col("c.overlapEnd").alias("overlap_end"), ref(1, "speaker").alias("speaker_a"), ref(1, "text").alias("text_a"), ref(2, "speaker").alias("speaker_b"), ref(2, "text").alias("text_b"),
        F.coalesce(F.size("c.references"), F.lit(0)).alias("n_references"),
    )


def write_new(df: DataFrame, path: str) -> None:
    """SNK-10/11: JSON lines into a folder that must not exist yet."""
    df.write.mode("errorifexists").json(path)


# Model boundaries: pure functions of (recording_id, start, end) here; a user passes real ones with the same shape.


def stub_text(recording_id: object, start: float, end: float) -> str:
    """A stand-in recogniser: the same text for the same span, and no more than that."""
    h = hashlib.sha256(f"{recording_id}|{start:.3f}|{end:.3f}".encode()).hexdigest()
    return " ".join(h[i : i + 4] for i in range(0, 4 * max(1, min(8, int(end - start) + 1)), 4))


def recognize(items: DataFrame, recognizer: Callable[[object, float, float], str] = stub_text) -> DataFrame:
    """UD-01 with CN-17: distinct (recording_id, start, end to the millisecond) are recognised once and joined back."""
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    keyed = items.withColumns({"_a": ms("start_s"), "_b": ms("end_s")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [recognizer(r, x / 1000, y / 1000) for r, x, y in zip(*(b.column(c).to_pylist() for c in ("recording_id", "_a", "_b")), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in ("recording_id", "_a", "_b")), pa.array(text, pa.string())], ["recording_id", "_a", "_b", "text"])

    kind = dict(items.dtypes)["recording_id"]
    done = keyed.select("recording_id", "_a", "_b").distinct().mapInArrow(run, f"recording_id {kind}, _a long, _b long, text string")
    return keyed.join(done, ["recording_id", "_a", "_b"]).drop("_a", "_b")


def _unit(*key: object) -> float:
    """A number in 0 .. 1 that only depends on the key."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:6], "big") / (1 << 48)


def stub_embedding(recording_id: object, start: float, end: float, size: int = 16) -> list[float]:
    """UD-02's stand-in: a vector that is the same for the same span."""
    return [_unit("e", recording_id, f"{start:.3f}", f"{end:.3f}", i) - 0.5 for i in range(size)]


def stub_tracks(recording_id: object, start: float, end: float) -> list[tuple[float, float, int]]:
    """UD-03's and UD-06's stand-in: tracks (start, end, speaker) of two speakers that overlap a little."""
    cut = start + (end - start) * (0.3 + 0.4 * _unit("d", recording_id, f"{start:.3f}", f"{end:.3f}"))
    return [(start, min(end, cut + 0.2), 0), (max(start, cut - 0.2), end, 1)] if end > start else []


def stub_stems(recording_id: object, start: float, end: float) -> list[tuple[int, float, float]]:
    """UD-04's stand-in: (stem, share, correlation) of two stems."""
    share = 0.2 + 0.6 * _unit("s", recording_id, f"{start:.3f}", f"{end:.3f}")
    return [(0, share, 0.1), (1, 1 - share, 0.1)]


def stub_denoise(samples: np.ndarray) -> np.ndarray:
    """UD-05's stand-in: samples under a hundredth are silence."""
    return np.where(np.abs(samples) < 0.01, 0, samples).astype(np.float32)


def spans(items: DataFrame, model: Callable[[object, float, float], object], result: str) -> DataFrame:
    """UD-02, UD-04: a model over (recording_id, start_s, end_s), its result (of the given SQL type) as a column ``result`` beside the items' own."""
    call = F.udf(lambda r, a, b: model(r, a, b), result, useArrow=True)
    return items.withColumn("result", call("recording_id", "start_s", "end_s"))


def tracks(items: DataFrame, model: Callable[[object, float, float], list[tuple[float, float, int]]] = stub_tracks) -> DataFrame:
    """UD-03, UD-06: (recording_id, speaker, start_s, end_s): the tracks that a model finds in each item, chunk by chunk."""
    out = spans(items, model, "array<struct<start_s:double,end_s:double,speaker:int>>")
    return out.select("recording_id", F.explode("result").alias("t")).select("recording_id", "t.speaker", "t.start_s", "t.end_s")


def denoise(chunks: DataFrame, model: Callable[[np.ndarray], np.ndarray] = stub_denoise) -> DataFrame:
    """UD-05: chunk rows with their samples through a model, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [model(np.asarray(x, np.float32)) for x in b.column("samples").to_pylist()]
            yield b.set_column(b.schema.get_field_index("samples"), "samples", pa.array(clean, pa.list_(pa.float32())))

    return chunks.mapInArrow(run, chunks.schema)
