"""Address lists that arrive as files in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import columns as C


def stream_urls(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """url, list_name of every list file that appears; blank and # lines left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", most_files).text(folder)
    rows = lines.select(C.strip(F.col("value")).alias("url"), F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("list_name"))
    return rows.where((F.col("url") != "") & ~F.col("url").startswith("#"))
