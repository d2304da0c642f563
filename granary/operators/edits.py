"""Edits as an overlay: base rows never change, so that reverting is leaving rows of the overlay out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = ["archive", "ordinal"]
FIELDS = ("width", "height", "format", "mips")


def latest(edits: DataFrame) -> DataFrame:
    """The edit of greatest seq of each texture."""
    return edits.groupBy(*ID).agg(F.max_by(F.struct(*FIELDS), "seq").alias("e"))


def current(textures: DataFrame, edits: DataFrame) -> DataFrame:
    """The catalogue as edited, with modified and the original fields (orig_*)."""
    rows = textures.join(latest(edits), ID, "left")
    new = {f: F.when(F.col("e").isNotNull(), F.col(f"e.{f}")).otherwise(F.col(f)) for f in FIELDS}
    keep = [c for c in textures.columns if c not in FIELDS]
    return rows.select(*keep, *(new[f].alias(f) for f in FIELDS), *(F.col(f).alias(f"orig_{f}") for f in FIELDS), F.col("e").isNotNull().alias("modified"))


def reverted(edits: DataFrame, which: DataFrame) -> DataFrame:
    """The overlay without the edits of the textures in which (archive, ordinal)."""
    return edits.join(which.select(*ID).distinct(), ID, "left_anti")


def without_textures(textures: DataFrame, which: DataFrame) -> DataFrame:
    return textures.join(which.select(*ID).distinct(), ID, "left_anti")


def without_archives(archives: DataFrame, names: DataFrame) -> DataFrame:
    """archives (archive, parent) without those named and, for groups, without their children."""
    gone = names.select(F.col("archive").alias("gone")).distinct()
    return archives.join(gone, F.col("archive") == F.col("gone"), "left_anti").join(gone, F.col("parent") == F.col("gone"), "left_anti")


def cleared(rows: DataFrame) -> DataFrame:
    """No rows, same schema."""
    return rows.limit(0)
