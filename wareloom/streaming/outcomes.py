"""Outcomes as a stream: rows arrive as they finish, and readers see each key's latest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def write_outcomes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there to ``path``, a folder per batch; a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_outcomes(spark: SparkSession, path: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``; combined before the shuffle."""
    rows = spark.read.schema(schema).parquet(f"{path}/batch=*")
    cells = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(cells, F.struct(*order)).alias("row")).select("row.*")


#: Width of the parts that rows and intervals are matched by.
_STRIDE = 4096
_STATE = "start long, stop long, batch long"


def _islands(rows: DataFrame, index: str, batch: int) -> DataFrame:
    """The indexes of ``rows`` as intervals (start, stop exclusive, batch), in order within ranges of them; one that a
    range's border cuts is two, which does no harm."""
    dealt = rows.select(F.col(index).alias("i")).repartitionByRange("i").withColumn("range", F.spark_partition_id())
    order = Window.partitionBy("range").orderBy("i")
    step = F.coalesce(F.col("i") - F.lag("i").over(order) > 1, F.lit(True)).cast("int")
    marked = dealt.withColumn("step", step).withColumn("island", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("range", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    return spans.select("start", "stop", F.lit(batch).cast("long").alias("batch"))


def _without_held(rows: DataFrame, index: str, held: DataFrame) -> DataFrame:
    """``rows`` whose index lies in none of the intervals ``held``, matched part by part of the number line."""
    part = F.explode(F.sequence(F.floor(F.col("start") / _STRIDE), F.floor((F.col("stop") - 1) / _STRIDE))).alias("_part")
    spans = held.select("start", "stop", part)
    keyed = rows.withColumn("_part", F.floor(F.col(index) / _STRIDE))
    inside = (keyed["_part"] == spans["_part"]) & (keyed[index] >= spans["start"]) & (keyed[index] < spans["stop"])
    return keyed.join(spans, inside, "left_anti").drop("_part")


def write_prefix(stream: DataFrame, index: str, path: str, checkpoint: str) -> StreamingQuery:
    """Put out rows of ``stream`` as soon as all before them are there: what follows the last row put out without a gap
    goes to ``path``/out, a folder per batch. Indexes start at 0; a row that comes again, or has no index, doesn't count.

    Between batches stands, in ``path``/state, the next index and the intervals of indexes behind the gap, with the batch
    that has their rows; the rows stay in ``path``/in until the gap closes, and are neither read nor written again before.
    So a batch costs what it brings and what it sets free. A batch that runs again replaces its own folders; folders whose
    rows are all out go once a later batch has put its state down.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda kind, k: f"{path}/{kind}/batch={k}"
        state = spark.read.schema(_STATE).parquet(at("state", number - 1)) if number else spark.createDataFrame([(0, 0, -1)], _STATE)
        done = state.where("batch = -1").first()["stop"]
        held = state.where("batch >= 0")
        new = batch.where(F.col(index) >= done).dropDuplicates([index])
        _without_held(new, index, held).sortWithinPartitions(index).write.mode("overwrite").parquet(at("in", number))
        fresh = spark.read.schema(batch.schema).parquet(at("in", number))
        spans = held.unionByName(_islands(fresh, index, number))
        # intervals don't overlap, so the gap opens where the first chain of them that starts at the next index ends
        ends = spans.select(F.col("stop").alias("edge")).unionByName(spark.createDataFrame([(done,)], "edge long"))
        edge = ends.join(spans.select(F.col("start").alias("edge")), "edge", "left_anti").agg(F.min("edge")).first()[0]
        free = spans.where(F.col("stop") <= edge)
        from_ = sorted(r["batch"] for r in free.select("batch").distinct().collect())
        rows = spark.read.schema(batch.schema).parquet(*[at("in", k) for k in from_]) if from_ else fresh.limit(0)
        rows.where((F.col(index) >= done) & (F.col(index) < edge)).write.mode("overwrite").parquet(at("out", number))
        next_ = spark.createDataFrame([(done, edge, -1)], _STATE)
        spans.where(F.col("stop") > edge).unionByName(next_).write.mode("overwrite").parquet(at("state", number))
        _forget(spark, path, number, {r["batch"] for r in state.select("batch").distinct().collect()})

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, path: str, number: int, needed: set[int]) -> None:
    """Remove what no batch needs that may still run: states before the last one, and rows of batches that were all out
    before this one began (``needed``: those that weren't)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, last in (("state", number - 2), ("in", number - 1)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        for entry in files.listStatus(folder):
            k = int(entry.getPath().getName().rpartition("=")[2])
            if k <= last and not (kind == "in" and k in needed):
                files.delete(entry.getPath(), True)


def write_once(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of ``stream`` whose ``key`` hasn't come before, in this run or, by the checkpoint, an earlier one."""
    once = stream.dropDuplicates([key])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
