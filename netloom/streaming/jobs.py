"""Streams: corrections to annotations, reading corrections, newly cropped texts.

What a stream has to remember is one row for each key in the state store of its query, kept by a streaming aggregation.
The store is read back as of a committed batch through the state data source; no log of batches is written or read, so
cost does not grow with the number of batches. A batch that runs again after a failure overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.operators import dataset, ranks


def _run(stream: DataFrame, each, checkpoint: str, continuous: bool, mode: str = "append") -> StreamingQuery:
    w = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    q = (w if continuous else w.trigger(availableNow=True)).start()
    if not continuous:
        q.awaitTermination()
    return q


def _kept(state: DataFrame, checkpoint: str, continuous: bool) -> StreamingQuery:
    """Run a streaming aggregation for its state alone."""
    w = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    q = (w if continuous else w.trigger(availableNow=True)).start()
    if not continuous:
        q.awaitTermination()
    return q


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """Number of the last committed batch of a query; null before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=None)


def _state(spark: SparkSession, checkpoint: str, batch: int) -> DataFrame:
    """Keys and aggregation buffers as of a committed batch."""
    return spark.read.format("statestore").option("batchId", batch).load(checkpoint).select("key.*", F.struct("value.*").alias("value"))


def keep_latest(posts: DataFrame, key: str, seq: str, payload: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Keep the payload with the highest seq of each key of posts(key, seq, payload); late posts change nothing."""
    last = posts.groupBy(key).agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(payload).alias("payload"))).alias("last"))
    return _kept(last, checkpoint, continuous)


def latest_state(spark: SparkSession, key: str, payload: str, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Payload of each key as of a committed batch of `keep_latest`, the last one if none is given."""
    state = _state(spark, checkpoint, last_batch(spark, checkpoint) if batch is None else batch)
    buffer = state.schema["value"].dataType.fieldNames()[0]
    return state.select(F.col(state.columns[0]).alias(key), F.col("value")[buffer]["payload"].alias(payload))


def keep_corrections(posts: DataFrame, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Keep the last replacement and the first place of each pattern of posts(seq, pattern, replacement)."""
    state = posts.groupBy("pattern").agg(F.max(F.struct("seq", "replacement")).alias("last"), F.min("seq").alias("first"))
    return _kept(state, checkpoint, continuous)


def corrections_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(pattern, replacement, first) as of a committed batch of `keep_corrections`, the last one if none is given; no rows
    before the first."""
    batch = last_batch(spark, checkpoint) if batch is None else batch
    if batch is None:
        return spark.createDataFrame([], "pattern string, replacement string, first bigint")
    state = _state(spark, checkpoint, batch)
    last, first = state.schema["value"].dataType.fieldNames()
    return state.select(F.col(state.columns[0]).alias("pattern"), F.col("value")[last]["replacement"].alias("replacement"), F.col("value")[first].alias("first"))


def correct_stream(texts: DataFrame, memory: str, out: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Incoming texts(.., text) with the corrections known when their batch first runs. `memory` is the checkpoint of
    `keep_corrections`; the version a batch uses is noted in `out`_versions, so that a repeated batch uses it again."""
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        dataset.apply_corrections(batch, corrections_state(spark, memory, _version(spark, memory, f"{out}_versions/batch={epoch}"))) \
            .write.mode("overwrite").parquet(f"{out}/batch={epoch}")
    return _run(texts, each, checkpoint, continuous)


def _version(spark: SparkSession, memory: str, note: str) -> int | None:
    if (known := _noted(spark, note)) is None:
        now = last_batch(spark, memory)
        spark.createDataFrame([(-1 if now is None else now,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(note)
        known = _noted(spark, note)
    return None if known < 0 else known


def _noted(spark: SparkSession, path: str) -> int | None:
    """The number in a one-row table that was written whole; null without it."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.parquet(path).first()[0]


def ingest_crops(crops: DataFrame, out: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Append crops(path, text) not seen before, numbered on from the batch before.

    Seen paths are keys of the state store. Every batch notes in `out`_ends the number behind its last row, so the next
    one reads a single row, never earlier output.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        start = 0
        if epoch:
            start = _noted(spark, f"{out}_ends/batch={epoch - 1}")
            if start is None:
                raise RuntimeError(f"batch {epoch - 1} left no note of its end")
        target = f"{out}/batch={epoch}"
        ranks.global_number(batch, ["path"], "seq", start=start).write.mode("overwrite").parquet(target)
        rows = spark.read.schema(batch.schema).parquet(target).count()  # the footers of this batch alone
        spark.createDataFrame([(start + rows,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}_ends/batch={epoch}")
    return _run(crops.dropDuplicates(["path"]), each, checkpoint, continuous)
