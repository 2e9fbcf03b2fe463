"""Operator 12, media columns: payloads as images in content-addressed tar shards, and their metadata and features read back from there.

A payload is stored without loss as an 8-bit grey PNG, 64 samples a row (so its length is a positive multiple of 64). Each task writes
one shard, an ordinary tar file, with one member for each distinct payload it meets, named by the payload's SHA-256. Payloads aren't
shuffled: the same payload may lie in several shards, and the index keeps one address of each digest (the smallest shard and offset).
Rows carry digest, shard, offset and length; metadata columns come from range reads of the headers alone (512 bytes of tar and 33 of PNG
a member, hopping over the samples), features from range reads of the members that the index names, in order of offset.

Spark's text writer makes the shards, through its own commit protocol, so any store will do and a lost task leaves none: a row ends in
the zero byte that ends a tar header. Reading opens them through pyarrow's file systems (local, HDFS, S3, GCS), by the path that Spark
gives. A payload, one at a time, must fit into a task. Equal payloads have equal values in every column; an empty table has empty shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .shingles import slices

SAMPLES = 64  # a row of the image
BLOCK = 512  # of a tar file
STRETCH = 64 << 20  # bytes of a shard that one group of range reads covers
_MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER = len(_MAGIC) + 25  # with the image header chunk
INDEX = "digest string, shard string, offset long, length long, width long, height long, bit_depth int, colour_type int"
INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: Column) -> Column:
    """The text in UTF-8 (null: empty), then bytes 0 up to a positive multiple of 64."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    size = F.greatest(F.lit(SAMPLES), F.ceil(n / SAMPLES) * SAMPLES).cast("int")
    return F.concat(data, F.repeat(F.lit("\0"), size - n).cast("binary"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(samples: bytes) -> bytes:
    """An 8-bit grey PNG, each row of 64 samples as it is (filter 0)."""
    if not samples or len(samples) % SAMPLES:
        raise ValueError(f"a payload is a positive multiple of {SAMPLES} bytes, this one has {len(samples)}")
    rows = np.frombuffer(samples, np.uint8).reshape(-1, SAMPLES)
    lines = np.zeros((len(rows), SAMPLES + 1), np.uint8)
    lines[:, 1:] = rows
    size = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", size) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits a sample, colour type) from the first 33 bytes of a PNG."""
    if len(data) < HEADER or data[:8] != _MAGIC or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != int.from_bytes(data[29:33], "big"):
        raise ValueError("no PNG header")
    return struct.unpack(">IIBB", data[16:26])


def decode(media: bytes) -> bytes:
    """The samples of an image that encode() made; every chunk's check sum must hold."""
    width, height, depth, colour = header(media)
    at, packed, kind = len(_MAGIC), [], b""
    while kind != b"IEND":
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an image of unfiltered 8-bit grey samples")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, sample range, mean in thousandths, and a 64-bit average hash: which columns are lighter than the whole."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, SAMPLES)
    columns = rows.sum(axis=0, dtype=np.int64)
    light = np.packbits(columns * SAMPLES > columns.sum()).tobytes().hex()
    return f"grey8 {SAMPLES}x{len(rows)} {rows.min()}..{rows.max()} mean {1000 * int(columns.sum()) // len(samples)} columns {light}"


def _rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """A shard's bytes, cut so that each row lacks the one zero byte that Spark writes after it."""
    seen, rest, out, held = set(), b"", [], 0
    for batch in slices(batches, column):
        for value in batch.column(column):
            samples = value.as_py()
            name = hashlib.sha256(samples).hexdigest()
            if name in seen:
                continue
            seen.add(name)
            media = encode(samples)
            info = tarfile.TarInfo(f"{name}.png")
            info.size = len(media)
            out.append(rest + info.tobuf(tarfile.USTAR_FORMAT)[:-1])
            rest = media + b"\0" * (-len(media) % BLOCK)
            held += len(out[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["row"])
                out, held = [], 0
    yield pa.RecordBatch.from_arrays([pa.array([*out, rest + b"\0" * (2 * BLOCK - 1)], pa.binary())], names=["row"])


def write(payloads: DataFrame, path: str, column: str = "payload") -> None:
    """Write the payloads (binary, never null) as tar shards into a new folder."""
    rows = payloads.select(F.col(f"`{column}`").alias(column)).mapInArrow(lambda b: _rows(b, column), "row binary")
    rows.select(F.col("row").cast("string")).write.option("lineSep", "\0").text(path)


def _open(path: str):
    url = urlsplit(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(path.split(":", 1)[1] if url.scheme else path)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _members(path: str, size: int) -> Iterator[tuple]:
    with _open(path) as shard:
        at = 0
        while at + BLOCK <= size:
            head = shard.read_at(min(BLOCK + HEADER, size - at), at)
            if not any(head[:BLOCK]):
                break
            info = tarfile.TarInfo.frombuf(head[:BLOCK], "utf-8", "strict")
            yield info.name.removesuffix(".png"), path, at + BLOCK, info.size, *header(head[BLOCK:])
            at += BLOCK + -(-info.size // BLOCK) * BLOCK


def index(spark: SparkSession, path: str) -> DataFrame:
    """Every member of the shards in a folder: digest, shard, offset and length of the media, and metadata from its header."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                found = list(_members(shard, size))
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in found], t) for k, t in enumerate(kinds)], names=INDEX_COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(work, INDEX)


def addresses(members: DataFrame) -> DataFrame:
    """One member of each digest, that of the smallest shard and offset."""
    rest = [c for c in members.columns if c != "digest"]
    return members.groupBy("digest").agg(F.min(F.struct(*rest)).alias("m")).select("digest", "m.*")


def read_back(chosen: DataFrame) -> DataFrame:
    """All columns, and what the members' stored bytes say: digests of payload and media, check sum of the last 64 bytes, and the feature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            out = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if name != path:
                    if shard is not None:
                        shard.close()
                    path, shard = name, _open(name)
                media = shard.read_at(length, offset)
                samples = decode(media)
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-SAMPLES:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([m[k] for m in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(c.split()[0] for c in FEATURES.split(", "))])
        if shard is not None:
            shard.close()

    place = chosen.select(INDEX_COLUMNS).repartition("shard", F.floor(F.col("offset") / STRETCH))
    return place.sortWithinPartitions("shard", "offset").mapInArrow(work, f"{INDEX}, {FEATURES}")


def media_columns(docs: DataFrame) -> DataFrame:
    """Every document with the address and columns of its payload; the shards stay in the shared folder."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    data = payload(F.col("text"))
    write(docs.select(data.alias("payload")), path)
    stored = read_back(addresses(index(spark, path)))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("digest"))
    return rows.join(stored, "digest", "left")
