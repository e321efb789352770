"""New batch files as a stream of index rows, read with the same parser as the batch loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.sources.batches import parse_records


def index_stream(spark: SparkSession, directory: str, loader: str = "search") -> DataFrame:
    """Index rows of batch files as they arrive in a directory. Rows carry file and record number, not `pos`."""
    text = spark.readStream.text(directory, wholetext=True)
    return parse_records(text.select(F.col("_metadata.file_name").alias("source_file"), "value"), loader)
