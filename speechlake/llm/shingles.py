"""Arrow/NumPy kernels: whole texts to word hashes, and to sets of 64-bit word-shingle hashes.

A word is a maximal run of characters other than space and U+0009..U+000D, after lower-casing A-Z.
All steps work on whole columns; only making each document's hashes distinct goes document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), keyed by ``seed``."""
    x = x ^ U((seed * 0xD6E8FEB86659FD93 + 0xA5A5A5A5) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * GOLD
    return x ^ (x >> U(32))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of text, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(n) - n) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of each and of the end); null counts as empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return whole, offsets - offsets[0]


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, from its length and its lanes of eight bytes, one after the other, each through ``mix``.

    A step is a bijection of what came before it, so runs that first differ in a lane only meet again by a chance of 2^-64, whatever
    pattern they follow (sums of powers, as a polynomial modulo 2^64, are blind to some).
    """
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    out = mix((end - start).astype(U), 7)
    left = np.arange(len(start))
    at = start.astype(np.int64)
    while len(left):
        rest = end[left] - at
        lane = lanes[at].view(U)[:, 0]
        short = rest < 8
        lane[short] &= (U(1) << (U(8) * rest[short].astype(U))) - U(1)
        out[left] = mix(out[left] ^ lane, 9) * GOLD
        on = rest > 8
        left, at = left[on], at[on] + 8
    return mix(out, 11)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none across a text's edge, and how many each text has."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = np.unique(offsets)
    edge = edge[edge < n]
    first[edge] |= inside[edge]
    edge = edge[edge > 0]
    last[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, offsets))


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in order, number of words of each)."""
    data, offsets = text_bytes(pc.ascii_lower(pc.fill_null(text, "")))
    start, end, count = runs(~_SPACE[data], offsets)
    return hash_runs(data, start, end), count


def windows(flat: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive items."""
    rolled = np.zeros(max(0, len(flat) - width + 1), U)
    for k in range(width):
        rolled = mix(rolled * GOLD + flat[k : k + len(rolled)], k)
    return rolled


def whole(flat: np.ndarray) -> np.ndarray:
    """One hash for a short sequence, apart from those of windows by its length."""
    one = np.full(1, len(flat), U)
    for k in range(len(flat)):
        one = mix(one * GOLD + flat[k : k + 1], 64 + k)
    return one


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than ``width``: the whole sequence as one."""
    flat, count = words(text)
    rolled = windows(flat, width)
    out = []
    for stop, n in zip(np.cumsum(count).tolist(), count.tolist(), strict=True):
        if n >= width:
            got = np.sort(rolled[stop - n : stop - width + 1])
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            out.append(got[keep])
        else:
            out.append(whole(flat[stop - n : stop]) if n else np.empty(0, U))
    return out
