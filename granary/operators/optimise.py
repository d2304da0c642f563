"""Planning of resizes and format changes: metadata only, before any pixel is touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import texture as T


@dataclass(frozen=True)
class ResizePolicy:
    max_width: int = 512
    max_height: int = 512
    fmt: int | None = None  # None: keep
    levels: int = -2  # -2 keep, -1 full chain, n


def _with_sizes(rows: DataFrame) -> DataFrame:
    """Adds new_mips (no more than the chain has) and both byte counts."""
    w, h = F.col("new_width"), F.col("new_height")
    rows = rows.withColumn("new_mips", F.least(F.col("new_mips"), T.natural_levels(w, h)))
    before = T.total_mip_bytes(F.col("width"), F.col("height"), F.col("format"), F.col("mips"))
    return rows.withColumn("before_bytes", before).withColumn("after_bytes", T.total_mip_bytes(w, h, F.col("new_format"), F.col("new_mips")))


def resize_plan(textures: DataFrame, policy: ResizePolicy = ResizePolicy()) -> DataFrame:
    """The textures beyond the limits with their new dimensions, format, levels and byte counts."""
    rows = textures.where(T.resize_needed(F.col("width"), F.col("height"), policy.max_width, policy.max_height))
    rows = rows.withColumn("halvings", T.halvings(F.col("width"), F.col("height"), policy.max_width, policy.max_height))
    rows = rows.withColumn("new_width", T.resized(F.col("width"), F.col("halvings"))).withColumn("new_height", T.resized(F.col("height"), F.col("halvings")))
    rows = rows.withColumn("new_format", F.col("format") if policy.fmt is None else F.lit(policy.fmt))
    return _with_sizes(rows.withColumn("new_mips", T.level_policy(F.col("mips"), policy.levels)))


def resize_summary(textures: DataFrame, policy: ResizePolicy = ResizePolicy()) -> DataFrame:
    """Per archive and in total (archive null): textures resized and bytes before and after."""
    plan = resize_plan(textures, policy).select("archive", "before_bytes", "after_bytes")
    return plan.rollup("archive").agg(F.count("*").alias("resized"), F.coalesce(F.sum("before_bytes"), F.lit(0)).alias("before_bytes"), F.coalesce(F.sum("after_bytes"), F.lit(0)).alias("after_bytes"))


def manual_plan(textures: DataFrame, how: str, fmt: int | None = None, levels: int = -1, width: int | None = None, height: int | None = None) -> DataFrame:
    """An unconditional resize of every row given: half, quarter or custom."""
    rows = textures.withColumn("new_width", T.scaled(F.col("width"), how, width)).withColumn("new_height", T.scaled(F.col("height"), how, height))
    rows = rows.withColumn("new_format", F.col("format") if fmt is None else F.lit(fmt))
    return _with_sizes(rows.withColumn("new_mips", T.level_policy(F.col("mips"), levels)))


def recompress_plan(textures: DataFrame) -> DataFrame:
    """Compressed textures of 4 by 4 pixels and more with the format to re-encode them in, by the column alpha_used."""
    rows = textures.where(T.is_compressed(F.col("format")) & (F.col("width") >= 4) & (F.col("height") >= 4))
    target = T.recompress_target(F.col("format"), F.coalesce("alpha_used", F.lit(True)))
    return _with_sizes(rows.withColumns({"new_width": F.col("width"), "new_height": F.col("height"), "new_format": target, "new_mips": F.col("mips")}))


def recompress_summary(textures: DataFrame) -> DataFrame:
    """One row: processed, downgraded, bytes before and after, saved MiB and percent (0 if there was nothing)."""
    plan = recompress_plan(textures)
    one = plan.agg(F.count("*").alias("processed"), F.count_if(F.col("new_format") != F.col("format")).alias("downgraded"), F.coalesce(F.sum("before_bytes"), F.lit(0)).alias("before_bytes"), F.coalesce(F.sum("after_bytes"), F.lit(0)).alias("after_bytes"))
    saved = F.col("before_bytes") - F.col("after_bytes")
    return one.withColumn("saved_mib", saved / float(T.MIB)).withColumn("saved_percent", F.when(F.col("before_bytes") == 0, F.lit(0.0)).otherwise(saved * 100.0 / F.col("before_bytes")))


def same_format_plan(textures: DataFrame) -> DataFrame:
    """Compressed textures of 4 by 4 pixels and more, to be encoded again in their own format, size and levels."""
    rows = textures.where(T.is_compressed(F.col("format")) & (F.col("width") >= 4) & (F.col("height") >= 4))
    return _with_sizes(rows.withColumns({"new_width": F.col("width"), "new_height": F.col("height"), "new_format": F.col("format"), "new_mips": F.col("mips")}))


def same_format_summary(textures: DataFrame) -> DataFrame:
    """One row: textures that would be encoded again in their own format, and those passed over."""
    fit = T.is_compressed(F.col("format")) & (F.col("width") >= 4) & (F.col("height") >= 4)
    return textures.agg(F.count_if(fit).alias("processed"), F.count_if(~fit).alias("skipped"))


def alpha_in_use(fmt: Column, alphas: Column) -> Column:
    """Whether any alpha value is below 250; formats without alpha never, unknown values always. alphas: array column."""
    return F.when(~T.may_have_alpha(fmt), F.lit(False)).otherwise(F.coalesce(F.exists(alphas, lambda a: a < 250), F.lit(True)))
