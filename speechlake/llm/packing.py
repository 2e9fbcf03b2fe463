"""Operator 6: token-ID output by best-fit-decreasing packing.

Documents are tokenised with a public tokenizer, an end token closes each, and what is longer than a row is split into
full rows and a rest, losing nothing. Within a group (a bounded number of documents, by a hash of the number) the pieces
go, longest first, into the fullest row that still holds them; a segment tree over remaining capacities finds it. A row
of the packed id matrix has fixed length: ids as little-endian integers, padded with the end token, the cumulative lengths of
its segments, and each token's position, which restarts at every segment. Ids take two bytes where the vocabulary and its
end token fit in them, else four. ``write`` puts the rows into files.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plan_bytes
from .shingles import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's source splits a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_BYTES = 4 << 20  # of input, for each group that is packed together


@lru_cache(maxsize=1)
def encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_token(path: str) -> int:
    """The id after the vocabulary's last, which closes every document and pads rows."""
    return encoder(path).max_token_value + 1


def id_type(path: str) -> str:
    """NumPy's name of the ids' type."""
    return "<u2" if end_token(path) < 1 << 16 else "<u4"


class BestFit:
    """Rows of equal capacity by what they still hold: a segment tree over 0 .. capacity that counts rows."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``need``, taken out; None where no row has that."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row; every length is 1 .. capacity."""
    out: list[list[int]] = []
    free = BestFit(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = free.take(n)
        if got is None:
            room, row = capacity, len(out)
            out.append([])
        else:
            room, row = got
        out[row].append(i)
        if room > n:
            free.put(room - n, row)
    return out


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = encoder(path), id_type(path)
        end = np.array([end_token(path)], kind).tobytes()
        for batch in slices(batches, "text"):
            ids = [enc.encode_to_numpy(t or "", disallowed_special=()).astype(kind).tobytes() + end for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("part"), batch.column("doc"), pa.array(ids, pa.binary())], ["part", "doc", "ids"])

    return run


ROW = "part long, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, doc_offsets array<long>"


def _pack(length: int, path: str):
    def run(table: pa.Table) -> pa.Table:
        kind = np.dtype(id_type(path))
        wide = kind.itemsize
        # equal numbers are ordered by content, so that the result doesn't depend on how rows arrive
        docs = sorted(zip(table.column("doc").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        pieces = [(d, at, ids[wide * at : wide * (at + length)]) for d, ids in docs for at in range(0, len(ids) // wide, length)]
        sizes = np.array([len(p[2]) // wide for p in pieces], np.int64)
        out = {k: [] for k in ("part", "row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "doc_offsets")}
        part = table.column("part")[0].as_py()
        pad = np.full(length, end_token(path), kind).tobytes()
        for k, row in enumerate(best_fit_decreasing(sizes, length)):
            total = int(sizes[row].sum())
            out["part"].append(part)
            out["row"].append(k)
            out["n_tokens"].append(total)
            out["ids"].append(b"".join(pieces[i][2] for i in row) + pad[: wide * (length - total)])
            edges = [0, *np.cumsum(sizes[row]).tolist()]
            out["positions"].append(positions(edges, length).astype("<u4").tobytes())
            out["cu_seqlens"].append(edges)
            out["doc_ids"].append([pieces[i][0] for i in row])
            out["doc_offsets"].append([pieces[i][1] for i in row])
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return run


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed rows (part, row, n_tokens, ids, positions, cu_seqlens, doc_ids, doc_offsets) of documents (doc_id, text).

    ids: ``length`` integers of ``id_type``, segments one after the other and then padding; segment k is
    ids[cu_seqlens[k]:cu_seqlens[k+1]] and holds tokens doc_offsets[k] .. of document doc_ids[k]; positions (little-endian uint32)
    restart at each segment, the padding being one. A null or empty text is its end token alone; a null number is kept as null; rows with the
    same number or equal rows are packed each on their own. Extra columns are ignored; an empty table gives no rows.
    """
    groups = max(1, plan_bytes(docs) // GROUP_BYTES)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("part")
    ids = docs.select(part, F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(_tokenize(vocabulary), "part long, doc long, ids binary")
    return ids.groupBy("part").applyInArrow(_pack(length, vocabulary), ROW)


def write(packed: DataFrame, path: str | None = None) -> DataFrame:
    """The packed rows written as Parquet files (into the shared folder where no path is given), and read back from them."""
    if path is None:
        return materialize(packed, "packed")
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position of each token within its segment; padding counts on from 0 as a segment of its own."""
    edges = np.array([*cu_seqlens, length] if cu_seqlens[-1] < length else cu_seqlens)
    return np.arange(length) - np.repeat(edges[:-1], np.diff(edges))
