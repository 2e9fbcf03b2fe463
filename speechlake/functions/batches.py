"""Edit distances of many texts at once (TX-05, TX-08, TX-09): the bit-parallel columns of ``alignment``, a lane of an array for each pair of texts.

A pair's column of n rows lies in as many 64-bit words as it needs, and every step advances the columns of all pairs of a batch. Batches hold pairs of
like size; texts longer than ``LONG`` go one by one through ``alignment``, where a step costs as much for long columns as for short ones.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import alignment as A

LONG = 1024  # characters of a text, from which it is aligned by itself
TABLE = 1 << 18  # words of a batch's tables of characters
PART = 1 << 20  # bytes of texts looked at together
ONE, TOP = np.uint64(1), np.uint64(63)


class Texts:
    """Texts as code points, one after the other; nulls count as empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.empty(0, np.uint8)
        at = at - at[0] if len(at) else np.zeros(1, np.int64)
        begins = (data & 0xC0) != 0x80
        if begins.all():
            self.codes, self.at = data, at
        else:
            self.codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            self.at = np.concatenate([[0], np.cumsum(begins)])[at]
        self.size = np.diff(self.at)

    def __len__(self) -> int:
        return len(self.size)

    def text(self, i: int) -> str:
        return self.codes[self.at[i] : self.at[i + 1]].astype("<u4").tobytes().decode("utf-32-le")

    def square(self, rows: np.ndarray, most: int) -> np.ndarray:
        """(most, rows) of codes, places past a text's end at 0 counted as whatever lies there."""
        if not len(self.codes):
            return np.zeros((most, len(rows)), self.codes.dtype)
        return self.codes[np.minimum(self.at[rows] + np.arange(most)[:, None], len(self.codes) - 1)]


def _equal_texts(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """Which pairs are the same text."""
    same = a.size[i] == b.size[j]
    at = np.flatnonzero(same)
    size = a.size[i[at]]
    filled = at[size > 0]
    size = size[size > 0]
    if len(filled):
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        inner = np.arange(size.sum()) - np.repeat(start, size)
        equal = a.codes[np.repeat(a.at[i[filled]], size) + inner] == b.codes[np.repeat(b.at[j[filled]], size) + inner]
        same[filled] = np.logical_and.reduceat(equal, start)
    return same


class Tables:
    """For each of some texts and each character of a batch the places at which it stands, as bits of ``words`` words."""

    def __init__(self, ref: Texts, rows: np.ndarray, kinds: int, dense: np.ndarray, words: int):
        n = len(rows)
        self.kinds, self.words = kinds, words
        self.bits = np.zeros((words, n * kinds), np.uint64)
        own = np.arange(n) * kinds
        size = ref.size[rows]
        codes = ref.square(rows, int(size.max(initial=0)))
        for p in range(len(codes)):
            in_ = size > p
            at = own[in_] + dense[codes[p, in_]]
            self.bits[p >> 6, at] |= ONE << np.uint64(p & 63)


def _dense(*used: tuple[Texts, np.ndarray]) -> tuple[np.ndarray, int]:
    """(code point -> number, how many) of the characters of some texts."""
    found = []
    for texts, rows in used:
        size = texts.size[rows]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        found.append(np.unique(texts.codes[np.repeat(texts.at[rows] - start, size) + np.arange(size.sum())]))
    every = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)
    dense = np.zeros(int(every.max(initial=0)) + 1, np.int64)
    dense[every] = np.arange(len(every))
    return dense, max(1, len(every))


def step(up: np.ndarray, down: np.ndarray, same: np.ndarray, flats: np.ndarray | None = None) -> None:
    """Advance columns (words, pairs) by a character whose places are ``same``; ``flats`` takes the rows equal to their diagonal neighbours."""
    grew = fell = None  # what a word hands to the one above: whether its last row grew or fell against the column before
    for w in range(len(up)):
        u, d, s = up[w], down[w], same[w]
        if grew is None:
            first, low = ONE, None
            flat = s | d
            across = (((s & u) + u) ^ u) | s | d
        else:
            first, low = grew, fell
            flat = s | d
            t = s | fell
            across = (((t & u) + u) ^ u) | t | d
        right = d | ~(across | u)
        left = u & across
        grew, fell = right >> TOP, left >> TOP
        right = (right << ONE) | first
        left = left << ONE if low is None else (left << ONE) | low
        if flats is not None:
            flats[w] = across
        up[w] = left | ~(flat | right)
        down[w] = right & flat


def _masks(size: np.ndarray, words: int) -> np.ndarray:
    """(words, pairs): bits of the rows that a text has."""
    left = np.clip(size - 64 * np.arange(words)[:, None], 0, 64)
    return np.where(left >= 64, ~np.uint64(0), (ONE << np.minimum(left, 63).astype(np.uint64)) - ONE)


def _batches(ref: Texts, i: np.ndarray, hyp: Texts, j: np.ndarray, rows: np.ndarray, extra: int = 1):
    """Pairs of like size with their alphabet: (rows, those with longer hypotheses first; words; code numbers; kinds)."""
    words = (ref.size[i[rows]] + 63) // 64
    order = rows[np.lexsort((-hyp.size[j[rows]], words))]
    words = (ref.size[i[order]] + 63) // 64
    edges = np.flatnonzero(np.diff(words)) + 1
    for part in np.split(order, edges) if len(order) else []:
        w = max(1, int((ref.size[i[part[0]]] + 63) // 64))
        dense, kinds = _dense((ref, np.unique(i[part])), (hyp, np.unique(j[part])))
        most = max(16, min(4096, TABLE // (kinds * w * extra)))
        for a in range(0, len(part), most):
            yield part[a : a + most], w, dense, kinds


def distances(ref: Texts, i: np.ndarray, hyp: Texts, j: np.ndarray) -> np.ndarray:
    """Levenshtein distances, by code points, of the texts numbered i to those numbered j."""
    out = np.where(_equal_texts(ref, i, hyp, j), 0, -1)
    short = (ref.size[i] == 0) | (hyp.size[j] == 0)
    out[short] = np.maximum(ref.size[i], hyp.size[j])[short]
    todo = np.flatnonzero(out < 0)
    long = np.maximum(ref.size[i[todo]], hyp.size[j[todo]]) > LONG
    for k in todo[long]:
        out[k] = A.edit_distance(ref.text(i[k]), hyp.text(j[k]))
    for rows, words, dense, kinds in _batches(ref, i, hyp, j, todo[~long]):
        refs, at = np.unique(i[rows], return_inverse=True)
        table = Tables(ref, refs, kinds, dense, words)
        size = hyp.size[j[rows]]
        codes = dense[hyp.square(j[rows], int(size[0])).clip(max=len(dense) - 1)] + at * kinds
        up, down = np.full((words, len(rows)), ~np.uint64(0)), np.zeros((words, len(rows)), np.uint64)
        live = np.searchsorted(-size, -np.arange(len(codes)), "left")
        for p, n in enumerate(live):
            step(up[:, :n], down[:, :n], np.take(table.bits, codes[p, :n], axis=1))
        full = _masks(ref.size[i[rows]], words)
        out[rows] = size + (np.bitwise_count(up & full).astype(np.int64) - np.bitwise_count(down & full)).sum(axis=0)
    return out


def counts(ref: Texts, hyp: Texts) -> np.ndarray:
    """(pairs, 5): matches, substitutions, deletions, insertions and distance as ``alignment.edit_counts`` has them."""
    n = len(ref)
    both = np.arange(n)
    out = np.zeros((n, 5), np.int64)
    same = _equal_texts(ref, both, hyp, both)
    out[same, 0] = ref.size[same]
    empty = ~same & ((ref.size == 0) | (hyp.size == 0))
    out[empty, 2], out[empty, 3] = ref.size[empty], hyp.size[empty]
    todo = np.flatnonzero(~same & ~empty)
    long = np.maximum(ref.size[todo], hyp.size[todo]) > LONG // 4
    for k in todo[long]:
        out[k, :4] = A.edit_counts(ref.text(k), hyp.text(k))[:4]
    for rows, words, dense, kinds in _batches(ref, both, hyp, both, todo[~long], 4):
        table = Tables(ref, rows, kinds, dense, words)
        size, lanes = hyp.size[rows], np.arange(len(rows))
        r, h = ref.square(rows, int(ref.size[rows].max())), hyp.square(rows, int(size[0]))
        codes = dense[h.clip(max=len(dense) - 1)] + lanes * kinds
        up, down = np.full((words, len(rows)), ~np.uint64(0)), np.zeros((words, len(rows)), np.uint64)
        ups, flats = np.zeros((len(codes), words, len(rows)), np.uint64), np.zeros((len(codes), words, len(rows)), np.uint64)
        for p, m in enumerate(np.searchsorted(-size, -np.arange(len(codes)), "left")):
            step(up[:, :m], down[:, :m], np.take(table.bits, codes[p, :m], axis=1), flats[p, :, :m])
            ups[p] = up
        row, column = ref.size[rows] - 1, size - 1
        got = np.zeros((4, len(rows)), np.int64)
        while len(lanes):
            word, bit = row >> 6, (row & 63).astype(np.uint64)
            match = r[row, lanes] == h[column, lanes]
            flat = (flats[column, word, lanes] >> bit) & ONE == ONE
            grown = (ups[column, word, lanes] >> bit) & ONE == ONE
            kind = np.where(match, 0, np.where(~flat, 1, np.where(grown, 2, 3)))
            got[kind, lanes] += 1
            row, column = row - (kind != 3), column - (kind != 2)
            over = (row < 0) | (column < 0)
            if over.any():
                got[2, lanes[over]] += row[over] + 1
                got[3, lanes[over]] += column[over] + 1
                row, column, lanes = row[~over], column[~over], lanes[~over]
        out[rows, :4] = got.T
    out[:, 4] = out[:, 1:4].sum(axis=1)
    return out


def assignments(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, speakers, texts) of costs: the least sums, and the columns chosen, of equal choices the first in order.

    Over sets of columns taken for the last rows: 2^m of them for m columns, so many columns go one by one.
    """
    n, k, m = cost.shape
    if m > 10:
        chosen = np.array([A.assignment(c) for c in cost.tolist()], np.int64).reshape(n, k)
        return np.take_along_axis(cost, chosen[:, :, None], 2)[:, :, 0].sum(axis=1), chosen
    far = np.iinfo(np.int64).max // 4
    best = np.full((1 << m, n), far)  # for a set of taken columns the least cost of the rows left
    sets = sorted(range(1 << m), key=int.bit_count, reverse=True)
    for s in sets:
        row = s.bit_count()
        if row == k:
            best[s] = 0
        elif row < k:
            for c in range(m):
                if not s >> c & 1:
                    np.minimum(best[s], cost[:, row, c] + best[s | 1 << c], out=best[s])
    chosen, taken, lane = np.empty((n, k), np.int64), np.zeros(n, np.int64), np.arange(n)
    for row in range(k):
        now, pick = best[taken, lane], np.full(n, -1)
        for c in range(m - 1, -1, -1):
            free = taken >> c & 1 == 0
            to = taken | 1 << c
            pick[free & (cost[:, row, c] + best[to, lane] == now)] = c
        chosen[:, row] = pick
        taken |= 1 << pick
    return best[0], chosen


def _least(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of two columns (words, pairs) that begin alike, the lesser value in each row."""
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").view(np.int8)
    whole = lambda x: np.ascontiguousarray(np.packbits(x, axis=1, bitorder="little").view(np.uint64).T)
    sums = [np.cumsum(bits(x[0]) - bits(x[1]), axis=1, dtype=np.int16) for x in (a, b)]
    change = np.diff(np.minimum(*sums), axis=1, prepend=np.int16(0))
    return whole(change > 0), whole(change < 0)


def concatenated(refs: Texts, groups: np.ndarray, hyp: Texts) -> np.ndarray:
    """Least distances of the hypotheses to their references (texts groups[g] up to groups[g + 1]) joined in any order, as
    ``alignment.concatenated_distance`` has them."""
    n, many = len(hyp), np.diff(groups)
    out = np.zeros(n, np.int64)
    total = refs.at[groups[1:]] - refs.at[groups[:-1]]
    one_by_one = (many > 5) | (hyp.size > LONG) | (total > LONG)
    for g in np.flatnonzero(one_by_one):
        out[g] = A.concatenated_distance([refs.text(r) for r in range(groups[g], groups[g + 1])], hyp.text(g))
    for k in np.unique(many[~one_by_one]).tolist():
        these = np.flatnonzero(~one_by_one & (many == k))
        for rows, words, dense, kinds in _joins(refs, groups, hyp, these, k):
            out[rows] = _joined(refs, groups, hyp, rows, k, words, dense, kinds)
    return out


def _joins(refs: Texts, groups: np.ndarray, hyp: Texts, rows: np.ndarray, k: int):
    words = np.maximum(1, (hyp.size[rows] + 63) // 64)
    rows = rows[np.argsort(words, kind="stable")]
    words = np.sort(words)
    for part in np.split(rows, np.flatnonzero(np.diff(words)) + 1) if len(rows) else []:
        w = max(1, int((hyp.size[part[0]] + 63) // 64))
        dense, kinds = _dense((hyp, part), *((refs, groups[part] + r) for r in range(k)))
        most = max(16, min(2048, TABLE // (kinds * w)))
        for a in range(0, len(part), most):
            yield part[a : a + most], w, dense, kinds


def _joined(refs: Texts, groups: np.ndarray, hyp: Texts, rows: np.ndarray, k: int, words: int, dense: np.ndarray, kinds: int) -> np.ndarray:
    table = Tables(hyp, rows, kinds, dense, words)
    lanes, n = np.arange(len(rows)) * kinds, len(rows)
    full = _masks(hyp.size[rows], words)
    marks = []
    for r in range(k):
        own = groups[rows] + r
        order = np.argsort(-refs.size[own], kind="stable")
        size = refs.size[own][order]
        codes = dense[refs.square(own[order], int(size[0])).clip(max=len(dense) - 1)] + lanes[order]
        marks.append((order, codes, np.searchsorted(-size, -np.arange(len(codes)), "left")))
    states = {0: (np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64))}
    best = None
    for count in range(k):
        following: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for done, state in states.items():
            for r, (order, codes, live) in enumerate(marks):
                if done >> r & 1:
                    continue
                up, down = np.ascontiguousarray(state[0][:, order]), np.ascontiguousarray(state[1][:, order])
                for p, m in enumerate(live):
                    step(up[:, :m], down[:, :m], np.take(table.bits, codes[p, :m], axis=1))
                back = np.empty(n, np.int64)
                back[order] = np.arange(n)
                now = up[:, back] & full, down[:, back] & full
                if count == k - 1:
                    d = (np.bitwise_count(now[0]).astype(np.int64) - np.bitwise_count(now[1])).sum(axis=0)
                    best = d if best is None else np.minimum(best, d)
                    continue
                to = done | 1 << r
                following[to] = _least(following[to], now) if to in following else now
        states = following
    if best is None:
        best = hyp.size[rows].copy()
    return refs.at[groups[rows + 1]] - refs.at[groups[rows]] + best


def shared(ref: Texts, hyp: Texts) -> np.ndarray:
    """Sizes of the multiset intersections of the texts' characters."""
    n = len(ref)
    out = np.zeros(n, np.int64)
    both = np.arange(n)
    dense, kinds = _dense((ref, both), (hyp, both))
    most = max(1, TABLE // kinds)

    def often(t: Texts, a: int, b: int) -> np.ndarray:
        own = np.repeat(np.arange(b - a) * kinds, t.size[a:b])
        return np.bincount(own + dense[t.codes[t.at[a] : t.at[b]]], minlength=(b - a) * kinds).reshape(b - a, kinds)

    for a in range(0, n, most):
        b = min(n, a + most)
        out[a:b] = np.minimum(often(ref, a, b), often(hyp, a, b)).sum(axis=1)
    return out


def parts(*columns: pa.Array) -> list[tuple[pa.Array, ...]]:
    """Columns of texts, or of lists of texts, in stretches of about ``PART`` bytes, so that what is held for a batch stays small."""
    n = len(columns[0])
    held = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            edges = np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths().fill_null(0), np.int64))])
            each = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(c.flatten()).fill_null(0), np.int64))])
            held += np.diff(each[edges]) * np.maximum(1, np.diff(edges))
        else:
            held += np.asarray(pc.binary_length(c).fill_null(0), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(held + 16) // PART)) + 1).tolist(), n] if n else [0]
    return [tuple(c.slice(a, b - a) for c in columns) for a, b in pairwise(cuts) if b > a]


def of_lists(lists: pa.Array) -> tuple[Texts, np.ndarray]:
    """(texts, edges) of an array of lists of texts; nulls count as empty lists."""
    many = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return Texts(lists.flatten()), np.concatenate([[0], np.cumsum(many)])


def permuted(refs: pa.Array, hyps: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
    """(distances, assignments) of lists of texts to each other; missing hypotheses are empty texts."""
    r, rows = of_lists(refs)
    # one more text, an empty one, stands for every missing hypothesis
    h, at = of_lists(hyps)
    h.at, h.size = np.append(h.at, h.at[-1]), np.append(h.size, 0)
    n, k, have = len(rows) - 1, np.diff(rows), np.diff(at)
    m = np.maximum(k, have)
    out, chosen = np.zeros(n, np.int64), [[] for _ in range(n)]
    for rk, mk in sorted(set(zip(k.tolist(), m.tolist(), strict=True))):
        these = np.flatnonzero((k == rk) & (m == mk))
        if not rk:
            continue
        i = np.broadcast_to(rows[these][:, None, None] + np.arange(rk)[None, :, None], (len(these), rk, mk))
        place = np.arange(mk)[None, None, :]
        j = np.where(place < have[these][:, None, None], at[these][:, None, None] + place, len(h) - 1)
        cost = distances(r, i.ravel(), h, np.broadcast_to(j, i.shape).ravel()).reshape(i.shape)
        out[these], picked = assignments(cost)
        for g, c in zip(these.tolist(), picked.tolist(), strict=True):
            chosen[g] = c
    return out, chosen


def likeness_sums(texts: pa.Array) -> list[list[float]]:
    """For each text of a list the sum of its edit similarities to all of them, itself included, in their order."""
    t, at = of_lists(texts)
    k = np.diff(at)
    out: list[list[float]] = [[] for _ in k]
    for size in np.unique(k[k > 0]).tolist():
        these = np.flatnonzero(k == size)
        total = np.ones((len(these), size))
        a, b = np.triu_indices(size, 1)
        if len(a):
            i, j = at[these][:, None] + a, at[these][:, None] + b
            most = np.maximum(1, np.maximum(t.size[i], t.size[j]))
            like = np.ones((len(these), size, size))
            like[:, a, b] = like[:, b, a] = 1 - distances(t, i.ravel(), t, j.ravel()).reshape(i.shape) / most
            for x in range(size):
                for y in range(size):
                    if x != y:
                        total[:, x] += like[:, x, y]
        for g, s in zip(these.tolist(), total.tolist(), strict=True):
            out[g] = s
    return out
