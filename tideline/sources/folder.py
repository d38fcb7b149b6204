"""Folders of media files as rows of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
SUFFIXES = ("mkv", "mp4", "m4v")
MOST_FILES = 32


def media_files(spark: SparkSession, folder: str, most: int = MOST_FILES) -> DataFrame:
    """path, length, content of the folder's own video files; none or more than `most` is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    files = files.filter(F.lower(F.substring_index("path", ".", -1)).isin(*SUFFIXES)).select("path", "length", "content")
    n = files.select("path").limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"{folder}: expected 1 to {most} video files")
    return files.orderBy("path")


def sniff(files: DataFrame) -> DataFrame:
    """files with container: mkv where the bytes begin with an EBML header, else mp4."""
    return files.withColumn("container", F.when(F.startswith("content", F.lit(b"\x1aE\xdf\xa3")), "mkv").otherwise("mp4"))
