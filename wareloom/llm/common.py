"""Shared pieces of the corpus operators: tables, scratch storage that every executor sees, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.scratch import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def with_own_names(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with its columns that are called like one of ``names`` (in any case), or have a dot or an accent in their
    names, renamed, and what gives a table made from it the columns of ``docs`` again, and more columns if they are named."""
    clash, taken, new = {n.lower() for n in names}, {c.lower() for c in docs.columns}, []
    for column in docs.columns:
        name = re.sub("[.`]", "_", column)
        while name.lower() in clash or (name != column and name.lower() in taken):
            name += "_"
        new.append(name)
        taken.add(name.lower())
    return docs.toDF(*new), lambda out, *more: out.select(*[quoted(n).alias(c) for n, c in zip(new, docs.columns, strict=True)], *more)


#: Rows of one Arrow batch at most: texts may be long, and a batch stands in a worker and twice in its executor.
BATCH_ROWS = 500
_HELD: dict[tuple, object] = {}


def bound_batches(spark: SparkSession) -> None:
    """Have the session send Python batches of BATCH_ROWS rows at most, unless it sends smaller ones already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _give_back() -> None:
    """Let the system have the memory that a worker has freed, as far as its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(kind: tuple, make: Callable):
    """What a Python worker keeps from task to task, ``make`` makes it the first time. It keeps one thing: what another kind
    of task left goes, so what the stages of a pipeline remember doesn't add up."""
    if kind not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[kind] = make()
    return _HELD[kind]


def in_slices(batches: Iterable, column: str = "text", size: int = 1 << 20) -> Iterator:
    """Arrow batches in slices of about ``size`` bytes of ``column``, one long row at least: what a task makes of a slice is
    gone before the next, so a worker's memory follows the slice and not the batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


class Scratch:
    """Intermediate tables of one operator run, written as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of executors. ``drop`` removes tables that later steps
    no longer read, so that the peak of disk stays near the largest step.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.base = fresh_path(spark, name)
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Have Spark remove the shuffles that no plan needs any more: it does so when the driver collects its garbage,
        and until then they fill the executors' disks."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a long, b long) for every id on an edge.

    Alternating large-star and small-star steps; each step keeps one minimum per node (combined before the shuffle)
    and joins it back, so no neighbourhood is ever gathered. Null ends and loops are ignored; repeated edges and no
    edges at all are fine.
    """

    def tied(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()

    now = scratch.write(tied(edges), "edges")
    while True:
        up = now.select("u", "v", F.lit(1).alias("above"))
        both = up.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("above")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum("above").alias("above"), F.count("*").alias("n"))
        # written, so that both sides of the join are plain exchanges, of which Spark can split the one of a hot node
        least = scratch.write(least, "least")
        # done when each node is a smallest one, or hangs on one edge
        if least.where("above > 1 or (above > 0 and above < n)").isEmpty():
            scratch.drop(least)
            break
        large = both.join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large")
        lowest = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = scratch.write(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(now, least, large, lowest)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
