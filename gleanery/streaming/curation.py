"""Curation of arriving data (an extension: the batch operators as streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_arrivals(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Each key once; state older than the watermark is forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def first_seen(stream: DataFrame, keys: list[str], path: str, checkpoint: str, order: str) -> None:
    """Writes each key once, however late it comes again, and ends when all that is there is taken.

    What is known is the table itself: a batch is reduced to the first row of each key by `order`
    and joined against the table; no state is held in memory. Batches have folders of their own,
    so that one taken again after a failure replaces what it wrote.
    """

    def take(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("__row")).select("__row.*")
        earlier = [f"{path}/batch={n}" for n in range(number)]
        known = batch.sparkSession.read.schema(batch.schema).option("basePath", path).parquet(*earlier) if earlier else batch.limit(0)
        first.join(known.select(*keys).distinct(), keys, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def without_held_out(stream: DataFrame, held_out: DataFrame, content: str) -> DataFrame:
    """Rows whose content isn't among the held-out files: a join of the stream with a table."""
    known = held_out.select(F.col("sha256").alias("__sha")).filter("__sha is not null").distinct().withColumn("__hit", F.lit(True))
    return stream.join(known, stream[content] == known["__sha"], "left").filter("__hit is null").drop("__sha", "__hit")


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows in each window of event time."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of `by`, ended by a gap."""
    x = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to parquet, and ends."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
