"""What the operators share: word patterns, the shared working folder, materialised intermediates, running sums in a row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space and U+0009..U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (or the session's checkpoint directory), which all machines see.

    Where neither is set, a local master (tests) gets a folder of its own; a cluster has no place that all its machines
    see, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster see")
        found = "file://" + tempfile.mkdtemp(prefix="speechlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver next happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that a later one has taken the place of."""
    spark = df.sparkSession
    jvm, conf, top = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath().rstrip("/") == jvm.org.apache.hadoop.fs.Path(top).toUri().getPath():
            path.getFileSystem(conf).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size on storage. Where a join or a source without figures makes it useless (above 2^50),
    the bytes of the files read, of which all columns count; 256 MB for tables without files."""
    stats = df._jdf.queryExecution().optimizedPlan()
    size = int(str(stats.stats().sizeInBytes()))
    if 0 < size < 1 << 50:
        return size
    leaves = stats.collectLeaves()
    found = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in found if x < 1 << 60) or 1 << 28


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none. Counts the ends of words, without making an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is named, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(amounts: Column) -> Column:
    """For an array of longs, the sum of all elements before each: sums of slices of about the root of its length first,
    so that n elements take n * sqrt(n) additions, and no array is copied n times."""
    sub = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    first = lambda x, n: sub(F.slice(x, 1, n))

    def sums(a: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda c: let(
            F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / c).cast("int") - 1), lambda k: F.slice(a, k * c + 1, c)),
            lambda chunks: let(F.transform(chunks, sub), lambda totals: F.flatten(F.transform(
                chunks, lambda x, k: let(first(totals, k), lambda base: F.transform(x, lambda _, j: base + first(x, j)))))),
        ))

    return F.when(F.size(amounts) > 0, let(amounts, sums)).otherwise(F.array().cast("array<long>"))


def spread(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """A table of fewer files than the cluster has cores, and not more than ``small`` bytes for each core, dealt over all cores: one
    row group is one task, whatever Spark's split size. Larger tables are read as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if files < cores and plan_bytes(df) <= small * cores else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
