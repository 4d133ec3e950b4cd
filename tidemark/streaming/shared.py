"""Folders that streams share with the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir. Only a session on one machine may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, table: str) -> DataFrame:
    """A Parquet file or folder as a stream. A stream's plain path has to be a folder; a pattern may match one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return spark.readStream.schema(spark.read.parquet(table).schema).parquet(table if is_folder else f"{table[:-1]}[{table[-1]}]")


def run_to_end(result: DataFrame, label: str) -> DataFrame:
    """Run an aggregating stream over all that is there, in complete mode, so that open groups and late rows are in it, and read what
    its last batch stored."""
    spark = result.sparkSession
    out = folder(spark, label)
    spark.createDataFrame([], result.schema).write.parquet(out)

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    result.writeStream.outputMode("complete").option("checkpointLocation", folder(spark, f"{label}-state")).trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
