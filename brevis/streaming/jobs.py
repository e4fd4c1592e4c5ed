"""Structured Streaming forms: files shortened once as they arrive, running metric means."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from brevis.sources import versions


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Rows of the files in a folder whose names fit ``glob``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Rows of a stored table, be its path one file or a folder of part files.

    The last letter of the path is written as a pattern: Spark takes a plain path for a folder, a pattern for either.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def once(source: DataFrame, keys: tuple, delay: str = "7 days", time: str | None = None) -> DataFrame:
    """Rows that repeat ``keys`` within ``delay`` come once; the watermark lets older keys leave the state.

    ``time`` is an event time column; without it a row's time is the modification time of its file (the source must be a
    file stream then). Null keys equal each other, so name enough columns to tell rows apart.
    """
    if time is None:
        timed = source.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
        return timed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_shorten(
    source: DataFrame, strategy: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, partition_by: tuple = ()
) -> StreamingQuery:
    """Shorten what has arrived and stop; the checkpoint makes the next run start after it.

    ``strategy`` must be row-wise (head, tail, head+tail, stop words); the file sink commits each
    batch exactly once.
    """
    writer = (
        strategy(source).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append")
    )
    return (writer.partitionBy(*partition_by) if partition_by else writer).start(path)


def stream_ranked(source: DataFrame, strategy: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Ranking strategies need within-document grouping, so each batch is shortened as a batch.

    The batch number names a version, so a batch replayed after a failure replaces itself, and readers
    (``versions.read_every_version``) do not see a batch that was not finished.
    """

    def run(batch: DataFrame, number: int) -> None:
        versions.write_version(strategy(batch), path, number, keep=None)

    return (
        source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_means(log: DataFrame) -> DataFrame:
    """Mean value per run and epoch over everything seen so far (complete or update mode)."""
    return log.groupBy("run", "epoch").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_rows"))


def windowed_means(log: DataFrame, time: str = "ts", delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Mean value per run and tumbling window; the watermark lets old windows leave the state."""
    return (
        log.withWatermark(time, delay)
        .groupBy("run", F.window(time, width).alias("w"))
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_rows"))
        .select("run", F.col("w.start").alias("window_start"), "mean_value", "n_rows")
    )


def write_windows(means: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window once the watermark has closed it."""
    return (
        means.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start(path)
    )


def every_window(log: DataFrame, time: str = "ts", delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """``windowed_means`` with window_end and the window's newest event, for ``write_every_window``."""
    return (
        log.withWatermark(time, delay)
        .groupBy("run", F.window(time, width).alias("w"))
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_rows"), F.max(time).alias("newest"))
        .select("run", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean_value", "n_rows", "newest")
    )


def write_every_window(means: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the windows that each batch changed, open ones included; a replayed batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        versions.write_version(batch, path, number, keep=None)

    return (
        means.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_every_window(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """Newest state of every window, and whether the watermark has closed it."""
    rows = versions.read_every_version(spark, path)
    newest = rows.agg(F.max("newest").alias("seen"))  # one row
    last = rows.groupBy("run", "window_start", "window_end").agg(F.max_by(F.struct("mean_value", "n_rows"), "version").alias("m"))
    closed = F.col("window_end") <= F.col("seen") - F.expr(f"INTERVAL {delay}")
    return last.crossJoin(newest).select("run", "window_start", "m.mean_value", "m.n_rows", closed.alias("closed"))


def write_running(means: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest full result: every batch is a new version of the table of running means (``versions.read_version``)."""

    def run(batch: DataFrame, number: int) -> None:
        versions.write_version(batch, path, number)

    return (
        means.writeStream.foreachBatch(run).outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
