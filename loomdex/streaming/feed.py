"""Changes of files as a stream: a feed of events keeps the table of live paths up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "path string, action string, mtime timestamp"


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of change events (path, action add, modify or delete, mtime) from a folder of parquet files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newest(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without the repetitions that come within the delay; later ones are late and dropped with the state."""
    return events.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["path", "action", "mtime"])


def apply_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state (path, mtime, alive) after a batch: of each path the event with the greatest time holds; of two at one
    time deletion does. Events older than the state change nothing."""
    one = events.select("path", "mtime", (F.col("action") != "delete").alias("alive"))
    return state.unionByName(one).groupBy("path").agg(F.max(F.struct("mtime", (~F.col("alive")).alias("gone"))).alias("x")).select("path", "x.mtime", (~F.col("x.gone")).alias("alive"))


def maintain(events: DataFrame, out: str, checkpoint: str, delay: str | None = None) -> StreamingQuery:
    """With ``delay`` repeated events that come within it are dropped first. Writes a version of the state after every batch, each from the one before: ``out/v<batch>``. A batch that is run
    again after a failure overwrites its own version with the same rows."""
    spark = events.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{out}/v{n - 1}") if n else spark.createDataFrame([], "path string, mtime timestamp, alive boolean")
        apply_events(old, df).write.mode("overwrite").parquet(f"{out}/v{n}")

    if delay:
        events = newest(events, delay)
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
