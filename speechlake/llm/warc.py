r"""Operator 2: web archives written as WARC/1.1 records, read back, and assembled to one nested row per capture.

A page becomes three records: a request, a response (or a revisit of an equal payload) and metadata; request and metadata
name the response in WARC-Concurrent-To. Spark's own text writer makes the files, one row a record and CR LF CR LF as the
row's end, which is exactly how WARC separates records; so they can lie in any store that Spark can write. Pages go by size
class into files of so many records that none holds much more than ``FILE_BYTES``, or one page. Reading inflates a file piece
by piece, one gzip member or many, and cuts by Content-Length alone, whatever payloads hold; equi-joins on record identifiers
put captures together wherever their records lie.

Records are named after a key of their page's row that is the same in every job: the row's place in its file, or a number
that is written with the rows first.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

LEAST_REVISIT = 1000
FILE_BYTES = 1 << 28
#: Largest payloads of the size classes of pages; the last has no bound, and a file each.
CLASSES = (1 << 18, 1 << 22, 1 << 26)
SALTS = 16
NL = "\r\n"


def _id(kind: str, *key: Column) -> Column:
    m = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(k.cast("string"), F.lit("-")) for k in key)))
    cut = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, ident: Column, uri: Column, content: str, block: Column, *more: Column) -> Column:
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
            F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(NL, *head), F.lit(NL + NL), block)  # concat_ws leaves out headers that are null


def identified(pages: DataFrame) -> DataFrame:
    """page_id, url and html with a ``key`` of the row: its file and place in it, where pages are read from files that tell it; else
    a number, written with the rows."""
    if "_metadata" not in pages.columns:
        try:
            return pages.select("page_id", "url", "html", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("key"))
        except AnalysisException:  # not a file that numbers its rows
            pass
    return materialize(pages.select("page_id", "url", "html", F.monotonically_increasing_id().cast("string").alias("key")), "pages")


def write(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html; other columns are left out) as archives below ``path``.

    Of equal payloads of at least 1000 bytes, the page with the largest number is the response and the others revisit it;
    rows that repeat that number are responses too, and where no number is known all are. A null html is an empty payload; a null url an
    empty one; line breaks in urls are escaped. Payloads are equal when length and SHA-1 are.
    """
    pages = identified(pages)
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("key").alias("row"), "page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    p = p.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    first = p.where(F.col("n") >= LEAST_REVISIT).groupBy("digest", "n").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies"))
    # n is written anew (xor 0), so that both sides are dealt out for the join and copies of one page can be cut into several tasks
    first = first.where("copies > 1 AND first.page_id IS NOT NULL").select("digest", F.col("n").bitwiseXOR(F.lit(0).cast("long")).alias("n"), "first")
    p = p.join(first.hint("merge"), ["digest", "n"], "left")
    p = p.withColumn("again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit(False)) & F.col("first").isNotNull())
    uri = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=UTF-8{NL}Content-Length: "), F.col("n").cast("string"), F.lit(NL + NL))
    ident, target = _id("response", F.col("row"), F.col("page_id")), F.col("first")
    refers = F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), _id("response", target["row"], target["page_id"])))
    profile = F.when(F.col("again"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), ident)
    response = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), ident, uri, "application/http;msgtype=response",
        F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html"))), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), refers, profile,
    )
    request = _record(F.lit("request"), _id("request", F.col("row"), F.col("page_id")), uri, "application/http;msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{NL}{NL}")), beside)
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(NL)), F.lit(""))
    metadata = _record(F.lit("metadata"), _id("metadata", F.col("row"), F.col("page_id")), uri, "application/warc-fields", fields, beside)
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for low, high in zip((-1, *CLASSES), (*CLASSES, None), strict=True):
        if longest > low:
            part = p.where(F.col("n") > low) if high is None else p.where(F.col("n").between(low + 1, high))
            rows = part.select(F.explode(F.array(request, response, metadata)).alias("value"))
            many = 3 * max(1, FILE_BYTES // high if high else 1)
            rows.write.mode("append").option("lineSep", NL + NL).option("maxRecordsPerFile", many).option("compression", "gzip").text(path)


RECORDS = "id string, type string, concurrent_to string, refers_to string, uri string, page_id long, digest string, bytes long, payload binary"


def inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of gzip members, one after the other, piece by piece. Only the piece in which a member ends is read again for the next."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("a gzip member is cut short")
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; every record ends by its Content-Length. Holds one record at a time."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        searched = 0
        while (stop := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held:
                    raise ValueError("an archive ends within a record's headers")
                return
        lines = held[:stop].decode("utf-8").split(NL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
        end = stop + 4 + int(head["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"{head.get('warc-record-id')} doesn't end where its length says")
        yield head, bytes(held[stop + 4 : end])
        del held[: end + 4]


def _records(keep: bool, rows_at_once: int = 4096, bytes_at_once: int = 16 << 20):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def one(head: dict[str, str], block: bytes) -> tuple:
        kind, page, digest, size, payload = head["warc-type"], None, None, None, None
        if kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8").split(NL) if x)
            page = int(fields["page-id"]) if "page-id" in fields else None
        elif kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            said = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split(NL)[1:])}
            size, digest = int(said["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                size, payload = len(body), body if keep else None
                if hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
        return head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), page, digest, size, payload

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in parse(inflate(content.as_py())):
                    rows.append(one(head, block))
                    held += len(block) if keep else 0
                    if len(rows) >= rows_at_once or held > bytes_at_once:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; the digest of each payload is verified. A file's compressed bytes are read as a whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records(payloads), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: response, request and metadata structs, joined through concurrent-to; a missing one is null."""
    row = lambda *names: F.struct(*names)
    main = records.where("type IN ('response', 'revisit')").select("id", row("id", "type", "uri", "refers_to", "digest", "bytes", "payload").alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("id"), row(F.col("id"), "uri").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), row(F.col("id"), "page_id").alias("metadata"))
    return main.join(request, "id", "left").join(metadata, "id", "left").drop("id")


def captures(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and assemble: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri, n_records long.

    One row per page row, repeated ones too; refers_to is the page number of the response that a revisit names, n_records how
    many records the capture has. The archives are parsed once, their records without payloads written for the joins.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    records = materialize(read(spark, path, payloads=False), "records")
    there = lambda c: F.col(c).isNotNull().cast("long")
    rows = assemble(records).select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.id").alias("id"), F.col("response.refers_to").alias("to"),
        F.col("response.bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("response.uri").alias("target_uri"), (1 + there("request") + there("metadata")).alias("n_records"),
    )
    # rows that refer to nothing are spread by a key of their own; a target that many revisit has a copy under each salt
    wanted = records.where("type = 'revisit' AND refers_to IS NOT NULL").select(F.col("refers_to").alias("to")).distinct()
    named = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("to"), F.col("page_id").alias("refers_to"))
    named = wanted.join(named, "to").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("to", F.coalesce("to", "id")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("to", F.when(F.col("record_type") == "revisit", F.col("to")).otherwise(F.concat(F.lit("none "), "id")))
    out = rows.join(named.hint("merge"), ["to", "salt"], "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "n_records")
