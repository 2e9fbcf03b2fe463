"""Edit alignment of texts of any length, and assignments of texts to each other (TX-05, TX-08, TX-09).

Distances run bit-parallel: a column of the edit matrix is held as the differences between its rows, one bit each in a long integer
(Myers 1999, in the form of Hyyro 2003), so a column of n rows takes a dozen operations on n bits. Only some columns are kept on the way; the
traceback computes the ones between again, part by part from the end, so memory stays bounded while texts grow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD = 32 << 20  # bytes of columns held by one traceback


def _places(text: str) -> Callable[[str], int]:
    """For a character the bits at which ``text`` has it; those of long texts are kept within 64 MB."""
    if len(text) < 1024:
        found: dict[str, int] = {}
        for i, c in enumerate(text):
            found[c] = found.get(c, 0) | 1 << i
        return lambda c: found.get(c, 0)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)

    @lru_cache(maxsize=max(8, (64 << 20) // (len(text) // 8)))
    def places(c: str) -> int:
        return int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")

    return places


def _column(up: int, down: int, same: int, full: int) -> tuple[int, int, int]:
    """The next column: bits of rows where the matrix grows by one from the row above, where it shrinks, and where it equals its diagonal neighbour."""
    flat = ((((same & up) + up) ^ up) | same | down) & full
    right = (down | (full ^ ((flat | up) & full))) << 1 | 1
    left = (flat & up) << 1
    return (left | (full ^ ((flat | right) & full))) & full, right & flat & full, flat


class _Trace:
    """Steps back from the end of an edit matrix: an equal pair, else a substitution, a deletion, an insertion, whichever reaches the least distance first."""

    def __init__(self, ref: str, hyp: str):
        self.ref, self.hyp, self.places = ref, hyp, _places(ref)
        self.row, self.column, self.counts = len(ref), len(hyp), [0, 0, 0, 0]

    def run(self) -> list[int]:
        self.part(0, len(self.hyp), (1 << len(self.ref)) - 1, 0)
        self.counts[2] += self.row
        self.counts[3] += self.column
        return self.counts

    def part(self, a: int, b: int, up: int, down: int) -> None:
        """Go back from column b to a (or the first row), given the state of column a. Rows below the present one no longer count."""
        if self.row == 0:
            return
        full = (1 << self.row) - 1
        up, down = up & full, down & full
        width = max(64, self.row // 4)
        if (b - a) * width <= HELD or b - a == 1:
            columns = []
            for c in self.hyp[a:b]:
                up, down, flat = _column(up, down, self.places(c) & full, full)
                columns.append((up, flat))
            self.walk(a, columns)
            return
        step = -(-(b - a) // max(2, min(b - a, HELD // (2 * width))))
        kept = []
        for at in range(a, b, step):
            kept.append((at, up, down))
            for c in self.hyp[at : min(b, at + step)] if at + step < b else ():
                up, down, _ = _column(up, down, self.places(c) & full, full)
        while kept:
            at, up, down = kept.pop()
            self.part(at, min(b, at + step), up, down)

    def walk(self, a: int, columns: list[tuple[int, int]]) -> None:
        while self.row and self.column > a:
            up, flat = columns[self.column - 1 - a]
            if self.ref[self.row - 1] == self.hyp[self.column - 1]:
                kind = 0
            elif not flat >> (self.row - 1) & 1:
                kind = 1
            else:
                kind = 2 if up >> (self.row - 1) & 1 else 3
            self.counts[kind] += 1
            self.row -= kind != 3
            self.column -= kind != 2


def _differing(ref: str, hyp: str) -> tuple[int, int]:
    """How many characters two texts begin with and end on alike; halves are compared whole, not character by character."""

    def alike(most: int, part: Callable[[str, int, int], str]) -> int:
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if part(ref, low, mid) == part(hyp, low, mid):
                low = mid
            else:
                high = mid - 1
        return low

    end = alike(min(len(ref), len(hyp)), lambda t, a, b: t[len(t) - b : len(t) - a])
    return alike(min(len(ref), len(hyp)) - end, lambda t, a, b: t[a:b]), end


def edit_distance(ref: str, hyp: str) -> int:
    """Levenshtein distance by code points."""
    begin, end = _differing(ref, hyp)
    ref, hyp = ref[begin : len(ref) - end], hyp[begin : len(hyp) - end]
    places, full = _places(ref), (1 << len(ref)) - 1
    up, down = full, 0
    for c in hyp:
        up, down, _ = _column(up, down, places(c), full)
    return len(hyp) + up.bit_count() - down.bit_count()


def edit_counts(ref: str, hyp: str) -> tuple[int, int, int, int, int]:
    """Matches, substitutions, deletions, insertions and distance of two texts, by code points.

    Equal ends match in every such alignment, and an equal beginning leaves the numbers as they are, so neither enters the matrix.
    """
    begin, end = _differing(ref, hyp)
    m, s, d, i = _Trace(ref[begin : len(ref) - end], hyp[begin : len(hyp) - end]).run()
    return m + begin + end, s, d, i, s + d + i


COUNTS = ("matches", "substitutions", "deletions", "insertions", "distance")


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in COUNTS]))
def edit_stats_udf(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """TX-05 as a column function; null counts as empty."""
    from . import batches as B

    out = np.concatenate([np.empty((0, len(COUNTS)), np.int64), *(B.counts(B.Texts(r), B.Texts(h)) for r, h in B.parts(ref, hyp))])
    return pa.StructArray.from_arrays([pa.array(out[:, i], pa.int32()) for i in range(len(COUNTS))], names=list(COUNTS))


@F.arrow_udf(T.LongType())
def distance_udf(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Levenshtein distance as a column function; null where either is."""
    from . import batches as B

    found = [np.empty(0, np.int64)]
    for r, h in B.parts(ref, hyp):
        both = np.arange(len(r))
        found.append(B.distances(B.Texts(r), both, B.Texts(h), both))
    return pc.if_else(pc.and_(ref.is_valid(), hyp.is_valid()), pa.array(np.concatenate(found), pa.int64()), pa.scalar(None, pa.int64()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def distances_udf(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """Levenshtein distances of the texts of one array to those at their places in another of its length; null texts count as empty."""
    from . import batches as B

    found, many = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r, h in B.parts(refs, hyps):
        (a, at), (b, other) = B.of_lists(r), B.of_lists(h)
        if not np.array_equal(at, other):
            raise ValueError("arrays of different lengths")
        found.append(B.distances(a, np.arange(len(a)), b, np.arange(len(b))))
        many.append(np.diff(at))
    at = np.concatenate([[0], np.cumsum(np.concatenate(many))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found), pa.int64()))


@F.arrow_udf(T.LongType())
def shared_chars_udf(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """SO-03 as a column function; null counts as empty."""
    from . import batches as B

    return pa.array(np.concatenate([np.empty(0, np.int64), *(B.shared(B.Texts(r), B.Texts(h)) for r, h in B.parts(ref, hyp))]), pa.int64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def likeness_udf(texts: pa.Array) -> pa.Array:
    """For each text of an array the sum of its edit similarities (CN-04) to all of them, itself included."""
    from . import batches as B

    return pa.array([s for (t,) in B.parts(texts) for s in B.likeness_sums(t)], pa.list_(pa.float64()))


# assignments


def _potentials(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row, row potentials, column potentials) of a least-cost assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    far = np.iinfo(np.int64).max // 4
    for i in range(n):
        row_of[n], at = i, n
        least, via, seen = np.full(n, far), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            seen[at] = True
            open_ = ~seen[:n]
            reach = cost[row_of[at]] - u[row_of[at]] - v[:n]
            better = open_ & (reach < least)
            least[better], via[better] = reach[better], at
            to = int(np.argmin(np.where(open_, least, far)))
            delta = least[to]
            u[row_of[seen]] += delta
            v[seen] -= delta
            least[open_] -= delta
            at = to
        while at != n:
            row_of[at] = row_of[via[at]]
            at = int(via[at])
    column = np.empty(n, np.int64)
    column[row_of[:n]] = np.arange(n)
    return column, u[:n], v[:n]


def assignment(cost: Sequence[Sequence[int]]) -> list[int]:
    """The least-cost choice of a column of its own for each row (at least as many columns); of equal ones the first in order.

    Best assignments are those over pairs without reduced cost. Row by row the smallest such column is taken that the rows after it can
    still be matched around.
    """
    rows = len(cost)
    if not rows:
        return []
    n = len(cost[0])
    square = np.zeros((n, n), np.int64)
    square[:rows] = cost
    column, u, v = _potentials(square)
    tight = square - u[:, None] - v[None] == 0
    row_of = np.empty(n, np.int64)
    row_of[column] = np.arange(n)
    fixed = np.zeros(n, bool)

    def moved(row: int, seen: np.ndarray) -> bool:
        for c in np.flatnonzero(tight[row] & ~fixed & ~seen):
            seen[c] = True
            if row_of[c] < 0 or moved(int(row_of[c]), seen):
                row_of[c], column[row] = row, c
                return True
        return False

    for i in range(rows):
        for c in np.flatnonzero(tight[i] & ~fixed):
            if column[i] == c:
                break
            before = row_of.copy(), column.copy()
            other, free = int(row_of[c]), int(column[i])
            row_of[free], row_of[c], column[i] = -1, i, c
            fixed[c] = True
            if moved(other, np.zeros(n, bool)):
                break
            fixed[c] = False
            row_of[:], column[:] = before
        fixed[column[i]] = True
    return column[:rows].tolist()


PIT = T.StructType([T.StructField("distance", T.LongType()), T.StructField("assignment", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(PIT)
def assign_udf(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """TX-08 over arrays of texts: the distance under the best assignment, and the assignment. Missing hypotheses are empty texts, as are nulls."""
    from . import batches as B

    found = [B.permuted(r, h) for r, h in B.parts(refs, hyps)]
    distance = np.concatenate([np.empty(0, np.int64), *(d for d, _ in found)])
    return pa.StructArray.from_arrays([pa.array(distance, pa.int64()), pa.array([c for _, chosen in found for c in chosen], pa.list_(pa.int32()))], names=["distance", "assignment"])


def _lower(a: tuple[int, int], b: tuple[int, int], n: int) -> tuple[int, int]:
    """Of two columns of n rows that begin alike, the lesser value in each row; neighbours in it differ by at most one too."""
    size = -(-n // 8)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=n, bitorder="little").astype(np.int32)
    whole = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
    least = np.minimum(np.cumsum(bits(a[0]) - bits(a[1])), np.cumsum(bits(b[0]) - bits(b[1])))
    step = np.diff(least, prepend=0)
    return whole(step > 0), whole(step < 0)


def concatenated_distance(refs: Sequence[str], hyp: str) -> int:
    """Least edit distance of ``hyp`` to the references joined in any order (TX-09).

    For a set of references the least distances of its joins to every beginning of ``hyp`` are one column; appending a reference advances
    it by its characters, and of the ways to a set the lesser value of each row stays. So n references take 2^n columns in place of n!
    orders. Empty references don't count, and equal ones are exchangeable: of these the sets that hold the first ones are enough.
    """
    refs = sorted(r for r in refs if r)
    n, total = len(hyp), sum(map(len, refs))
    places, full = _places(hyp), (1 << n) - 1
    marks = [[places(c) for c in r] for r in refs]
    earlier = [1 << (k - 1) if k and refs[k - 1] == r else 0 for k, r in enumerate(refs)]
    layer = {0: (full, 0)}
    for last in range(len(refs), 0, -1):
        following: dict[int, tuple[int, int]] = {}
        for done, state in layer.items():
            for k, mark in enumerate(marks):
                if done >> k & 1 or done & earlier[k] != earlier[k]:
                    continue
                up, down = state
                for same in mark:
                    up, down, _ = _column(up, down, same, full)
                to, other = done | 1 << k, following.get(done | 1 << k)
                if other is None or last == 1 and up.bit_count() - down.bit_count() < other[0].bit_count() - other[1].bit_count():
                    following[to] = up, down
                elif last > 1 and other != (up, down):
                    following[to] = _lower(other, (up, down), n)
        layer = following
    up, down = layer[(1 << len(refs)) - 1]
    return total + up.bit_count() - down.bit_count()


@F.arrow_udf(T.LongType())
def concatenated_udf(refs: pa.Array, hyp: pa.Array) -> pa.Array:
    """TX-09 as a column function; nulls count as empty."""
    from . import batches as B

    return pa.array(np.concatenate([np.empty(0, np.int64), *(B.concatenated(*B.of_lists(r), B.Texts(h)) for r, h in B.parts(refs, hyp))]), pa.int64())
