"""File names of exports and saved archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import paths
from granary.operators.dedup import numbered


def export_names(textures: DataFrame, ext: str = ".dds") -> DataFrame:
    """archive, ordinal, file_name: cleaned names, the second of equal ones (whatever their case) within an archive
    with _2, and so on, in load order."""
    rows = textures.select("archive", F.col("ordinal").cast("long").alias("ordinal"), paths.sanitised(F.col("name")).alias("clean")).withColumn("low", F.lower("clean"))
    out = numbered(rows, ["archive", "low"], "ordinal")
    suffix = F.when(F.col("n") == 1, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))
    return out.select("archive", "ordinal", F.concat("clean", suffix, F.lit(ext)).alias("file_name"))


def saved_names(archives: DataFrame) -> DataFrame:
    """archive, position, file_name: the leaf of each path, the second of equal ones with -2 before the extension."""
    leaf = paths.sanitised(paths.leaf(F.col("path")))
    rows = archives.select("archive", "position", leaf.alias("leaf")).withColumn("low", F.lower("leaf"))
    out = numbered(rows, ["low"], "position")
    ext = F.regexp_extract("leaf", r"(\.[^.]*)$", 1)
    suffix = F.when(F.col("n") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    return out.select("archive", "position", F.concat(F.regexp_replace("leaf", r"\.[^.]*$", ""), suffix, F.when(ext == "", F.lit(".ytd")).otherwise(ext)).alias("file_name"))


def relative_path(source: Column, entry: Column) -> Column:
    """Where an entry of a container is saved: <container>/<entry>, cleaned, with forward slashes."""
    return F.concat_ws("/", paths.sanitised(paths.stem(source)), paths.sanitised(paths.slashed(entry)))


def save_route(archives: DataFrame) -> DataFrame:
    """archives (archive, kind, source_path, entry_path, modified, is_preview) with route: skip (groups, previews,
    rows without a change), container (written back into its source), sidecar (nested too deep for that), file."""
    nested = paths.is_nested(F.col("entry_path"))
    skip = F.col("is_preview") | (F.col("kind") == "group") | ~F.col("modified")
    route = F.when(skip, "skip").when(F.col("entry_path").isNull(), "file").when(nested, "sidecar").otherwise("container")
    return archives.withColumn("route", route)


def save_summary(routed: DataFrame) -> DataFrame:
    by = lambda r: F.count_if(F.col("route") == r)
    return routed.agg(by("file").alias("files"), by("container").alias("into_containers"), by("sidecar").alias("sidecars"), by("skip").alias("skipped"))


def rewrites(routed: DataFrame) -> DataFrame:
    """One row per container to be rewritten (whatever the case of its path): source_path, replacements."""
    rows = routed.where(F.col("route") == "container")
    return rows.groupBy(F.lower("source_path").alias("source_key")).agg(F.min("source_path").alias("source_path"), F.count("*").alias("replacements"))
