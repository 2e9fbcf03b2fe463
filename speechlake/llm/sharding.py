"""Operator 3: contiguous shards of near-equal bytes from global prefix sums.

Rows get one global order: a hash bucket of the key, then the key. Totals per bucket are summed into each bucket's first
byte and first row; within a bucket a running sum adds the rest. The prefix sum of a row then decides its shard by equal
targets, so no task ever sees more than one bucket, and no shard is gathered anywhere. Buckets hold about
``BUCKET_ROWS`` rows at any size of the input; the totals are one small row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS, LEAST_BUCKETS = 1 << 16, 256


def prefix_sums(rows: DataFrame, by: list[str], key: list[str], size: str, buckets: int) -> DataFrame:
    """Adds ``_start`` (sum of size before the row) and ``_index`` (rows before it) within each ``by`` group, in the order of
    the key's hash bucket and then the key; ``_total`` is the group's sum. Null sizes count as 0. ``by`` may be empty.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    amount = F.coalesce(F.col(size), F.lit(0))
    totals = rows.groupBy(*by, "_bucket").agg(F.sum(amount).alias("_b"), F.count("*").alias("_n"))
    over = Window.partitionBy(*by)
    before = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    nil = F.lit(0)
    firsts = totals.select(
        *by, "_bucket", F.coalesce(F.sum("_b").over(before), nil).alias("_b0"),
        F.coalesce(F.sum("_n").over(before), nil).alias("_n0"), F.sum("_b").over(over).alias("_total"),
    )
    on: Column = F.col("r._bucket") == F.col("f._bucket")
    for c in by:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = rows.alias("r").join(firsts.alias("f"), on).select("r.*", "_b0", "_n0", "_total")
    inside = Window.partitionBy(*by, "_bucket").orderBy(*key, size)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({
        "_start": F.col("_b0") + F.sum(amount).over(upto) - amount,
        "_index": F.col("_n0") + F.row_number().over(inside) - 1,
    }).drop("_bucket", "_b0", "_n0")


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def shard_by_bytes(df: DataFrame, key: list[str], size: str, shards: int) -> DataFrame:
    """All columns of ``df`` plus shard int (0 .. shards - 1) and slot long (gapless from 0 within the shard).

    A row goes to the shard in which the middle of its bytes lies when the total is cut into equal targets: shards are
    contiguous in the global order and differ by at most one row's bytes at either end. Every row is placed, rows with
    null keys or equal keys too; equal rows are interchangeable. Null sizes count as 0 (if all are, all go to shard 0).
    Columns named shard or slot are replaced; columns may have any other names. An empty table stays empty.
    """
    buckets = bucket_count(df.count())
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    keys = [f"key_{i}" for i in range(len(key))]
    narrow = [*(F.col(f"`{c}`").alias(k) for c, k in zip(key, keys, strict=True)), F.coalesce(F.col(f"`{size}`"), F.lit(0)).alias("amount")]

    def placed(rows: DataFrame) -> DataFrame:
        rows = prefix_sums(rows, [], keys, "amount", buckets)
        middle = F.call_function("div", (2 * F.col("_start") + F.col("amount")) * shards, 2 * F.greatest(F.col("_total"), F.lit(1)))
        return rows.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))

    first = placed(df.select(*narrow)).groupBy("shard").agg(F.min("_index").alias("_first"))  # as many rows as shards
    whole = placed(df.select(*narrow, F.struct(*(F.col(f"`{c}`") for c in kept)).alias("in")))
    return whole.join(F.broadcast(first), "shard").select("in.*", "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and 8 more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
