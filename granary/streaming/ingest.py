"""Folders watched as streams: new asset files are parsed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import paths
from granary.sources import files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, folder: str, enabled: tuple[str, ...] = paths.SUPPORTED) -> DataFrame:
    """A stream of the files of listed()."""
    df = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return df.where(paths.is_supported(F.col("path"), enabled) & ~paths.leaf(F.col("path")).startswith("."))


def textures(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_textures(watched(spark, folder))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_archives(watched(spark, folder))
