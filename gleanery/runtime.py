"""What operators need from the running session: lineage cuts and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without it; it then gets a folder of its own.
    """
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    folder = _setting(spark, "spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gleanery-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder so that a lost executor loses nothing.

    A checkpointed frame keeps the size that was estimated for its plan; in loops such estimates
    multiply each other until they alone fill the driver. The result here has the written rows
    and the number of bytes that were written as its size, so small ones can be broadcast.
    """
    spark = df.sparkSession
    shared_dir(spark)
    jvm = spark._jvm
    plan = df.checkpoint(eager=True)._jdf.queryExecution().logical()
    folder = jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    written = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    # A Scala BigInt doesn't pass through Python: a range of 8 bytes a row has the statistics.
    stats = spark.range(max(1, written // 8))._jdf.queryExecution().logical().stats()
    none = jvm.scala.Option.empty()
    sized = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, jvm.scala.Some(stats), none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def written_bytes(df: DataFrame) -> int:
    """The size of a frame that `cut` gave."""
    return int(df._jdf.queryExecution().logical().stats().sizeInBytes())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """The path of a file URL."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not in a file system of this machine: {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that `scratch` gave."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
