"""Structured Streaming use of the stateless (S) operators.

The reference has no streaming operator; every operator marked S is a pure
projection / filter and runs unchanged on a streaming DataFrame. ``run`` wires
one such transformation between a file stream and a Parquet sink with an
``availableNow`` trigger and a checkpoint in the cluster's shared folder, so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellar.sources.files import scratch_dir


def stream_of(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the Parquet files at ``path`` (schema taken from the files)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not whole.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(whole).isDirectory():
        # a single-file table: stream the folder, keep only that file name; a table of part files is a folder itself
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", re.sub(r"([\\\[\]{}*?])", r"\\\1", name)).parquet(folder)
    return reader.parquet(path)


def run(
    spark: SparkSession,
    path: str,
    transform: Callable[[DataFrame], DataFrame],
    out_dir: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Process everything available at ``path`` through ``transform`` and return the sink as a table."""
    out_dir = out_dir or scratch_dir(spark, "stream-out")
    checkpoint = checkpoint or scratch_dir(spark, "stream-ckpt")
    q = (
        transform(stream_of(spark, path))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out_dir)
    )
    q.awaitTermination()
    return spark.read.parquet(out_dir)
