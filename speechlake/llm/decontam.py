r"""Operator 4: benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``width`` consecutive words of an item, or all words of a shorter one; windows with the same words are one. A
text can hold a window only if it holds the window's rarest word, so that single word is the necessary prefix of the window
under the order by rarity (counted over all documents, in one pass for the whole benchmark). The join goes over the hashes of
these prefix words alone; the word's place in the window gives the only start that an occurrence can have, which must lie
inside the text with the window's whole length; of what is left the hashes of all words are compared, and then their bytes.

The benchmark is the query set: it is dealt by hash into blocks of about ``BLOCK_WORDS`` words, each shipped to all tasks, and
the documents pass the blocks one after the other in one scan, without a shuffle. The verdict is reached in the task that has
the row, so no text leaves its task and no row needs a number to be known by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shingles import U, hash_runs, runs, slices, text_bytes

WIDTH = 13
BLOCK_WORDS = 2_000_000
_INSIDE = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])


class Words:
    """The words of texts, lower-cased: digits, letters and anything beyond ASCII. Their hashes, bytes, and how many each text has."""

    def __init__(self, text: pa.Array) -> None:
        data, offsets = text_bytes(pc.ascii_lower(pc.fill_null(text, "")))
        self.start, self.end, self.count = runs(_INSIDE[data], offsets)
        self.hash = hash_runs(data, self.start, self.end)
        self.data = data

    def bytes(self, places: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[places].tolist(), self.end[places].tolist(), strict=True)]


class Windows:
    """The distinct windows of one block of items: their words, owners, and the prefix word by which each is found."""

    def __init__(self, ids: list[str], texts: list[str | None], known: np.ndarray, seen: np.ndarray, width: int) -> None:
        w = Words(pa.array(texts, pa.string()))
        number: dict[bytes, int] = {}
        word = np.array([number.setdefault(x, len(number)) for x in w.bytes(np.arange(len(w.start)))], np.int64)
        self.vocabulary = list(number)
        self.hash = np.zeros(len(number), U)
        self.hash[word] = w.hash
        many = np.where(w.count > 0, np.maximum(1, w.count - width + 1), 0)
        item = np.repeat(np.arange(len(ids)), many)
        start = np.repeat(np.cumsum(w.count) - w.count, many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(w.count, width)[item]
        at = start[:, None] + np.arange(width)
        inside = np.arange(width) < size[:, None]
        words = np.where(inside, word[np.minimum(at, max(0, len(word) - 1))], -1) if len(word) else np.empty((0, width), np.int64)
        self.words, which = np.unique(words, axis=0, return_inverse=True) if len(words) else (words, np.empty(0, np.int64))
        self.size = (self.words >= 0).sum(1)
        # the items of each window: sets of items, one for all windows that have the same
        pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0) if len(words) else np.empty((0, 2), np.int64)
        cut = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))
        sets: dict[tuple[int, ...], int] = {}
        self.owner = np.array([sets.setdefault(tuple(pairs[a:b, 1].tolist()), len(sets)) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)
        self.owners = [[ids[i] for i in s] for s in sets]
        count = np.zeros(len(number), np.int64)
        if len(known) and len(number):
            place = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
            count = np.where(known[place] == self.hash, seen[place], 0)
        rarity = np.where(self.words >= 0, count[self.words], np.iinfo(np.int64).max) if len(self.words) else self.words
        self.offset = rarity.argmin(1) if len(self.words) else np.empty(0, np.int64)
        key = self.hash[self.words[np.arange(len(self.words)), self.offset]] if len(self.words) else np.empty(0, U)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.first, self.many = np.unique(key[self.order], return_index=True, return_counts=True)

    def hits(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word's covering occurrences, distinct (text, set of items) pairs) over the texts' words."""
        flat = text.hash
        cover = np.zeros(len(flat) + 1, np.int64)
        none = np.empty((0, 2), np.int64)
        if not len(self.keys) or not len(flat):
            return cover[:-1], none
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == flat)
        group = at[place]
        many = self.many[group]
        window = self.order[np.repeat(self.first[group] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        begin = np.repeat(place, many) - self.offset[window]
        end = np.cumsum(text.count)
        doc = np.searchsorted(end, np.repeat(place, many), "right")
        ok = (begin >= (end - text.count)[doc]) & (begin + self.size[window] <= end[doc])  # position and length
        window, begin, doc = window[ok], begin[ok], doc[ok]
        for k in range(self.words.shape[1]):
            w = self.size[window] > k
            same = np.ones(len(window), bool)
            same[w] = flat[begin[w] + k] == self.hash[self.words[window[w], k]]
            window, begin, doc = window[same], begin[same], doc[same]
        # equal hashes: the words' bytes decide
        k = np.arange(self.words.shape[1])
        word = self.words[window]
        inside = word >= 0
        pair, which = np.unique(((begin[:, None] + k) * len(self.vocabulary) + word)[inside], return_inverse=True)
        equal = np.array([a == self.vocabulary[b] for a, b in zip(text.bytes(pair // len(self.vocabulary)), (pair % len(self.vocabulary)).tolist(), strict=True)], bool)
        full = np.ones(inside.shape, bool)
        full[inside] = equal[which]
        exact = full.all(1)
        window, begin, doc = window[exact], begin[exact], doc[exact]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + self.size[window], -1)
        pairs = np.unique(np.stack([doc, self.owner[window]], 1), axis=0) if len(window) else none
        return np.cumsum(cover)[:-1], pairs


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for batch in slices(batches, "text"):
            flat = Words(batch.column("text")).hash
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            total += np.bincount(at[known[at] == flat], minlength=len(known))
        yield pa.record_batch([pa.array(known.view(np.int64)), pa.array(total)], ["word", "n"])

    return run


STATE = "_marks binary, _items array<string>"
VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string"


def _pass(windows, text: str, carried: list[str], last: bool):
    """Adds one block's hits to each text's marks (one byte a word); the last block's pass sums up instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(batch.column(text))
            count = words.count
            cover, pairs = windows.value.hits(words)
            end = np.cumsum(count)
            hit = cover > 0
            names: list[set[str]] = [set(x or ()) for x in batch.column("_items").to_pylist()]
            for i, m in enumerate(batch.column("_marks").to_pylist()):
                if m:
                    hit[end[i] - count[i] : end[i]] |= np.frombuffer(m, bool)
            for doc, owner in pairs.tolist():
                names[doc].update(windows.value.owners[owner])
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
            n_hit = sums[end] - sums[end - count]
            rows = [batch.column(c) for c in carried]
            if last:
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
                more = {"n_words": pa.array(count), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in names], pa.int64()), "items_sha256": pa.array(digest)}
            else:
                keep = [hit[b - n : b].tobytes() if h else None for b, n, h in zip(end.tolist(), count.tolist(), n_hit.tolist(), strict=True)]
                more = {"_marks": pa.array(keep, pa.binary()), "_items": pa.array([list(x) for x in names], pa.list_(pa.string()))}
            yield pa.record_batch([*rows, *more.values()], [*carried, *more])

    return run


def _judged(docs: DataFrame, text: str, keep: list[str], items: DataFrame, width: int, block_words: int) -> DataFrame:
    """The ``keep`` columns of ``docs`` (whose column ``text`` is judged) with the verdict's counts; one row for each row."""
    spark = docs.sparkSession
    # an item weighs its bytes over 2, the most words it can have
    weight = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 2) + 1
    bench = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text", weight.alias("w"))
    blocks = max(1, -(-int(bench.agg(F.sum("w")).first()[0] or 0) // block_words))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    part = lambda k: sorted((r["id"], r["text"] or "") for r in bench.where(block == k).select("id", "text").collect())
    held = part(0)
    known = np.unique(np.concatenate([np.unique(Words(pa.array([t for _, t in (part(k) if k else held)], pa.string())).hash) for k in range(blocks)]))
    seen = np.zeros(len(known), np.int64)
    if len(known):
        counted = docs.select(F.col(text).alias("text")).mapInArrow(_counter(spark.sparkContext.broadcast(known)), "word long, n long")
        found = {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
        seen = np.array([found.get(x, 0) for x in known.tolist()], np.int64)
    columns = [*keep, *([] if text in keep else [text])]
    types = {f.name: f for f in docs.schema.fields}
    schema = lambda names, more: StructType([StructField(c, types[c].dataType) for c in names] + StructType.fromDDL(more).fields)
    out = docs.select(*columns, F.lit(None).cast("binary").alias("_marks"), F.lit(None).cast("array<string>").alias("_items"))
    for k in range(blocks):
        rows = part(k) if k else held
        windows = spark.sparkContext.broadcast(Windows([i for i, _ in rows], [t for _, t in rows], known, seen, width))
        last = k == blocks - 1
        names = keep if last else columns
        out = out.mapInArrow(_pass(windows, text, names, last), schema(names, VERDICT if last else STATE))
    return out


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``, against ``items`` (item_id, text).

    A word inside any occurrence of an item's window is hit; contaminated: some hit, and at least one word in twenty. Null or
    empty texts have no words and no hits; null or empty items have no windows; an item without a number counts as ''.
    Rows with the same number, or equal rows, are judged each on their own, and an item_id with several texts counts once.
    Extra columns are ignored. Empty tables are fine on either side.
    """
    plain = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    out = _judged(plain, "text", ["doc"], items, width, block_words)
    return out.select(F.col("doc").alias(doc), "n_words", "n_hit", "n_items", "items_sha256", F.expr(CONTAMINATED).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that aren't contaminated, each judged by its own text: rows that share a
    doc_id, or have none, don't speak for each other. Empty tables are fine on either side.
    """
    names = [f"in_{k}" for k in range(len(docs.columns))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    out = _judged(inner, names[docs.columns.index("text")], names, items, width, block_words)
    return out.where(f"NOT ({CONTAMINATED})").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
