"""Operator 5: word-shingle Jaccard self-join by universe partition and pigeonhole.

Method. Sets are banded by size; the universe of shingles is hashed into the m segments of a band, so two sets whose
symmetric difference is at most H agree on all but H segments. The first ``a`` segments of a band are *deletion*
segments: their subset and all subsets less one shingle are signatures, so they still meet after one difference and
count twice. The others are *exact*: their subset is the signature, and each set indexes only its best H - 2a + 1 of
them in an order that depends on a segment's content alone (most shingles first, then the signature). That is enough:
if no deletion segment meets, they have used up 2a differences, so at least (m - a) - (H - 2a) exact segments are
equal, and the best of these cannot be among the few that a set leaves out. ``a`` is chosen per band by cost:
signatures against the chance that a small subset is shared by unrelated texts. Size bands grow by 5/4, so that a set
meets its own band and, as the larger of a pair, the one below.

Scale. A task packs its signatures as (signature, document) pairs in blocks, reduced to one document per signature
and task, so a signature in a third of all documents reaches its reducer once per map task. Reducers emit a spanning
forest, not pairs. Clusters of documents that share signatures are then cut into blocks of bounded size, and each pair of
blocks is verified as one job of its own: parity sketches bound the symmetric difference from below, what passes is intersected
exactly unless both are already linked through others. Only forest links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plan_bytes
from .components import connected_components
from .shingles import GOLD, U, mix, shingle_sets, slices

SLACK = 1.25  # exact segments for each that is indexed: room to leave the smallest out
SHARED = 0.35  # chance that one shingle of a short text is boilerplate; weighs small subsets in the cost
CANDIDATE = 80.0  # cost of one chance meeting, in signatures: both texts are read again and compared
FLUSH = 3_000_000  # signatures that a map task holds before it packs them
SALTS = 32
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20  # most documents, and shingles on average, of one block of a cluster


@lru_cache(maxsize=4096)
def band_of(n: int) -> tuple[int, int, int]:
    """(number, smallest size, largest size) of the size band that holds n >= 1."""
    low, k = 1, 0
    while (5 * low + 3) // 4 <= n:
        low, k = (5 * low + 3) // 4, k + 1
    return k, low, (5 * low + 3) // 4 - 1


@lru_cache(maxsize=4096)
def allocation(top: int) -> tuple[int, int]:
    """(m segments, first a of them with deletions) of the band whose largest size is ``top``, at the least cost."""
    most = (top + 5 * top // 4) // 9
    best = None
    for a in range(min(most // 2 + 1, 32) + 1):
        exact = max(0, most - 2 * a + 1)
        m = a + int(np.ceil(SLACK * exact))
        size = top / m
        cost = a * (1 + size) + exact + CANDIDATE * (a * (1 + size) * SHARED ** max(0.0, size - 1) + exact * SHARED**size)
        if best is None or cost < best[0]:
            best = cost, m, a
    return best[1], best[2]


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, index of the set of each) for sorted sets of shingle hashes; empty sets have none."""
    own, below = [], []
    for i, s in enumerate(sets):
        if n := len(s):
            k, low, top = band_of(n)
            own.append((i, n, k, top, (n + 5 * n // 4) // 9))
            if low > 1 and 5 * (low - 1) >= 4 * n:  # partners of at least 4/5 its size may lie one band down
                below.append((i, n, k - 1, low - 1, (n + low - 1) // 9))
    out_sig, out_set = [], []
    for rows in (own, below):
        if not rows:
            continue
        which, size, band, top, most = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        m, a = (np.array(x, np.int64) for x in zip(*(allocation(t) for t in top.tolist()), strict=True))
        flat = np.concatenate([sets[i] for i in which.tolist()])
        row = np.repeat(np.arange(len(which)), size)
        base = np.cumsum(m) - m
        local = ((flat >> U(20)) % m.astype(U)[row]).astype(np.int64)
        seg = base[row] + local
        value = mix(flat, 77)
        total = np.zeros(int(m.sum()), U)
        np.add.at(total, seg, value)
        count = np.bincount(seg, minlength=len(total))
        seg_row = np.repeat(np.arange(len(which)), m)
        seg_no = _spread(m)
        space = mix(band.astype(U)[seg_row] * GOLD + seg_no.astype(U), 3)  # a band's segment: subsets meet only within it
        sig = mix(total + space, 5)
        delete = seg_no < a[seg_row]
        exact = np.flatnonzero(~delete)
        # the best exact segments of each set
        order = exact[np.lexsort((sig[exact], -count[exact], seg_row[exact]))]
        rank = _spread(np.bincount(seg_row[order], minlength=len(which)))
        kept = order[rank < np.maximum(0, most - 2 * a + 1)[seg_row[order]]]
        out_sig += [sig[kept], sig[delete]]
        out_set += [which[seg_row[kept]], which[seg_row[delete]]]
        gone = delete[seg]
        out_sig.append(mix(total[seg[gone]] - value[gone] + space[seg[gone]], 5))
        out_set.append(which[row[gone]])
    if not out_sig:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes that are not the smallest, for edges u-v."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        while not np.array_equal(new, short := new[new]):
            new = short
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _meet(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, smallest document of each, forest edges from the others)."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    least = doc[first][np.cumsum(first) - 1]
    other = doc != least
    return sig[first], doc[first], *forest(doc[other], least[other])


PACKED = pa.schema([("part", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
PACKED_DDL = "part long, u long, v long, n long, blob binary"
#: Rows of the indexing pass. n >= 0: document u has n shingles and the set of document v. n = -1: u and v share a signature.
MET = "u long, v long, n long"


def _rows(part, u, v, n, blob=None) -> pa.RecordBatch:
    k = len(u)
    full = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), k))
    return pa.record_batch([full(part), full(u), full(v), full(n), pa.nulls(k, pa.binary()) if blob is None else blob], PACKED)


def _index(parts: int, width: int, doc: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        docs: list[tuple[int, int, int]] = []  # (document, its set's number, shingles)
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if docs:
                ids, sets, size = (np.array(x, np.int64) for x in zip(*docs, strict=True))
                rep = np.full(len(seen), np.iinfo(np.int64).max)
                np.minimum.at(rep, sets, ids)
                yield _rows(ids % parts, ids, np.where(size > 0, rep[sets], ids), size)
                if sigs:
                    sig, least, u, v = _meet(np.concatenate(sigs), rep[np.concatenate(owners)])
                    if len(u):
                        yield _rows(u % parts, u, v, -1)
                    to = (sig % U(parts)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    cut = np.searchsorted(to[order], np.arange(parts + 1))
                    pairs = np.stack([sig.view(np.int64), least], 1)[order]
                    full = np.flatnonzero(np.diff(cut))
                    blobs = pa.array([pairs[cut[p] : cut[p + 1]].tobytes() for p in full.tolist()], pa.binary())
                    yield _rows(full, np.zeros(len(full)), 0, -2, blobs)
            seen.clear(), docs.clear(), sigs.clear(), owners.clear()

        held = 0
        for batch in slices(batches, text):
            sets = shingle_sets(batch.column(text), width)
            new, number = [], []
            for i, s in zip(batch.column(doc).to_pylist(), sets, strict=True):
                key = s.tobytes() if len(s) < 16 else _digest(s)
                if key not in seen:
                    number.append(seen.setdefault(key, len(seen)))
                    new.append(s)
                docs.append((i, seen[key], len(s)))
            sig, owner = signatures(new)
            sigs.append(sig)
            owners.append(np.array(number, np.int64)[owner] if len(owner) else owner)
            held += len(sig)
            if held > FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a whole set, for equality within a task."""
    return np.array([len(s), mix(s, 11).sum(dtype=U), np.bitwise_xor.reduce(mix(s, 12)), mix(s, 13).sum(dtype=U)], U).tobytes()


def _gather(table: pa.Table) -> tuple[np.ndarray, ...]:
    n = table.column("n").to_numpy()
    plain = n > -2
    pairs = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.filter(pa.array(~plain)).column("blob").to_pylist()]
    u, v = table.column("u").to_numpy()[plain], table.column("v").to_numpy()[plain]
    n = n[plain]
    near = n == -1
    a, b = u[near], v[near]
    if pairs:
        pairs = np.concatenate(pairs)
        _, _, x, y = _meet(pairs[:, 0].view(U), pairs[:, 1])
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
    a, b = forest(a, b) if len(a) else (a, b)
    return u[~near], v[~near], n[~near], a, b


def _reduce(parts: int):
    """One part's documents, and its edges packed for the part of their node: other parts find most of them again."""

    def run(table: pa.Table) -> pa.Table:
        u, v, n, a, b = _gather(table)
        to = (a.view(U) % U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cut))
        pairs = np.stack([a, b], 1)[order]
        blobs = pa.array([pairs[cut[p] : cut[p + 1]].tobytes() for p in full.tolist()], pa.binary())
        return pa.Table.from_batches([_rows(u % parts, u, v, n), _rows(full, np.zeros(len(full)), 0, -2, blobs)])

    return run


def _distinct(table: pa.Table) -> pa.Table:
    """One part's documents and its distinct edges."""
    n = table.column("n").to_numpy()
    plain = n >= 0
    pairs = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.filter(pa.array(~plain)).column("blob").to_pylist()]
    u, v = table.column("u").to_numpy()[plain], table.column("v").to_numpy()[plain]
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    return pa.table({"u": np.concatenate([u, pairs[:, 0]]), "v": np.concatenate([v, pairs[:, 1]]), "n": np.concatenate([n[plain], np.full(len(pairs), -1)]).astype(np.int64)})


def _sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity of the shingles in each of ``bits`` cells: differing bits never outnumber differing shingles."""
    out = np.zeros((len(sets), bits // 64), U)
    for row, s in zip(out, sets, strict=True):
        cell = np.flatnonzero(np.bincount((mix(s, 21) % U(bits)).astype(np.int64), minlength=bits) & 1)
        np.bitwise_or.at(row, cell >> 6, U(1) << (cell & 63).astype(U))
    return out


def link(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Forest of the pairs with Jaccard >= percent/100, of those with one side in ``left`` and the other in ``right``."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    ids, left, right, size, sets = ids[order], left[order], right[order], size[order], [sets[i] for i in order.tolist()]
    bits = 1 << int(np.ceil(np.log2(min(1 << 16, max(1024, size[-1])))))
    sketch = _sketches(sets, bits)
    part = np.unique(ids, return_inverse=True)[1]  # rows of one document number belong together
    us, vs = [], []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
        if stop <= i + 1:
            continue
        away = np.bitwise_count(sketch[i + 1 : stop] ^ sketch[i]).sum(1, dtype=np.int64)
        # 100 I >= p U with U + I = the sizes' sum gives a difference U - I of at most sum * (100 - p) / (100 + p)
        near = away * (100 + percent) <= (100 - percent) * (size[i] + size[i + 1 : stop])
        near &= (left[i] & right[i + 1 : stop]) | (right[i] & left[i + 1 : stop])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if part[i] != part[j]:
                at = np.searchsorted(sets[j], sets[i])
                both = int((sets[j][np.minimum(at, len(sets[j]) - 1)] == sets[i]).sum())
                if 100 * both >= percent * (size[i] + size[j] - both):
                    part[part == part[j]] = part[i]
                    us.append(int(ids[i]))
                    vs.append(int(ids[j]))
    return us, vs


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            blob = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), width)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), blob], ["node", "label", "block", "blocks", "blob"])

    return run


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        us, vs = [], []
        # within one block, low and high are null: both sides are the block itself
        label, block = (table.column(c).to_numpy() for c in ("label", "block"))
        low, high = (np.broadcast_to(table.column(c)[0].as_py() or 0, len(label)) for c in ("low", "high"))
        node, blobs = table.column("node").to_numpy(), table.column("blob")
        order = np.lexsort((node, label))
        cuts = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0, True]) if len(label) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            sets = [np.frombuffer(blobs[i].as_py(), U) for i in rows.tolist()]
            x, y = link(node[rows], sets, block[rows] == low[rows[0]], block[rows] == high[rows[0]], percent)
            us += x
            vs += y
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n_shingles long, component_id long) per row: classes of the self-join |A n B| / |A u B| >= percent/100.

    A set holds the distinct ``width``-word shingles of the whole lower-cased text, or the whole sequence where it has
    fewer words. A text without words, or null, has an empty set, linked with nothing: its component is itself. Copies
    are a class of their own set and need no pairs. Rows of one document number count as one document; rows without a
    number are returned with a null component. An empty table gives an empty one; other columns are ignored.
    """
    if percent < 80:
        raise ValueError("size bands and differences are laid out for a similarity of 0.8 or more")
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    real = docs.where("doc IS NOT NULL")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * plan_bytes(docs) // (48 << 20))
    packed = real.mapInArrow(_index(parts, width, "doc", "text"), PACKED_DDL)
    merged = packed.groupBy("part").applyInArrow(_reduce(parts), PACKED_DDL)
    met = materialize(merged.groupBy("part").applyInArrow(_distinct, MET), "met")

    clusters = connected_components(met.where("n = -1").select("u", "v"))
    shape = met.where("n >= 0 AND u = v").select(F.col("u").alias("node"), "n")
    nodes = clusters.join(shape.groupBy("node").agg(F.max("n").alias("n")), "node")
    total = nodes.groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    count = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    # only clusters of several blocks are looked up, and each of them under as many keys as SALTS: a large one isn't one task's
    large = total.select("label", count.alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(large, ["label", "salt"], "left")
    nodes = materialize(nodes.select("node", "label", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int").alias("block")), "nodes")
    # the documents in clusters grow with the input: joined by shuffle at any size
    found = real.join(nodes.hint("merge"), real["doc"] == nodes["node"]).select("node", "label", "block", "blocks", "text")
    sets = found.mapInArrow(_sets(width), "node long, label long, block int, blocks int, blob binary")
    # each document goes to the pairs of its block with every block of the cluster, itself included
    placed = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "label", "block", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "blob"
    )
    # a pair of blocks is a job of its own; clusters of one block share jobs of about a block's shingles
    jobs = int(nodes.agg(F.ceil(F.sum("n") / BLOCK_SHINGLES)).first()[0] or 1)
    alone = F.col("blocks") == 1
    links = (
        placed.withColumn("job", F.when(alone, F.pmod(F.xxhash64("label"), F.lit(max(parts, jobs)))).otherwise(F.col("label")))
        .withColumn("low", F.when(~alone, F.col("low"))).withColumn("high", F.when(~alone, F.col("high")))
        .groupBy(alone.alias("alone"), "job", "low", "high").applyInArrow(_verify(percent), "u long, v long")
    )
    # several texts under one number tie their classes together
    whose = met.where("n > 0").groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b")
    same = met.where("n > 0").join(whose, "u").select(F.col("v").alias("u"), F.col("a").alias("v"))
    final = connected_components(links.unionByName(same))
    out = met.where("n >= 0").select(F.col("u").alias("doc"), F.col("v").alias("node"), F.col("n").alias("n_shingles"))
    out = out.join(final, "node", "left").select(
        F.col("doc").alias(doc), "n_shingles", F.coalesce("label", "node").alias("component_id")
    )
    return out.unionByName(_unnumbered(docs, width).withColumnRenamed("doc", doc))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) with one row of each class: the smallest doc_id, null last.

    Every row is a document of its own, whatever its doc_id: rows that share a number, or have none, are grouped by their texts
    alone. Rows without words are in no class and all stay. The rows are numbered once and written with their number, so that
    the number means the same row to every later job.
    """
    cells = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("key"), cells.alias("in")), "keyed")
    classes = jaccard_components(keyed.select("key", F.col("in.text").alias("text")), "key", "text", width, percent)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    named = classes.join(keyed.select("key", F.col("in.doc_id").alias("doc_id")), "key")
    first = named.groupBy("component_id").agg(F.min_by("key", rank).alias("key"))
    stay = keyed.join(first.select("key").hint("merge"), "key", "left_semi")
    return stay.select(*(F.col(f"in.`{c}`").alias(c) for c in docs.columns))


def _unnumbered(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            n = [len(s) for s in shingle_sets(batch.column("text"), width)]
            yield pa.record_batch([pa.array(n, pa.int64())], ["n_shingles"])

    counted = docs.where("doc IS NULL").select("text").mapInArrow(run, "n_shingles long")
    return counted.select(F.lit(None).cast("long").alias("doc"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
