"""Exact duplicates over a texture catalogue (archive, ordinal, name, sha, data_size), and what to do about them.

Groups are made by group-by with partial aggregation; no group is ever brought together in one task.  The first
member in (archive, ordinal) order is its master.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key length of names in bytes.
KEY_BYTES = 64
POSITION = ("archive", "ordinal")


def name_key(name: Column, size: int = KEY_BYTES) -> Column:
    """The first size bytes of the name with A-Z lower-cased. Where a cut halves a character, its bytes there are shown in
    the key as \\x and two digits, so that the key is text and as many bytes tell names apart."""
    low = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    raw = F.substring(low.cast("binary"), 1, size)
    whole = F.is_valid_utf8(raw.cast("string"))
    # a character has four bytes at most: one to three of them may stand at the end
    end = F.when(F.is_valid_utf8(F.substring(raw, 1, size - 1).cast("string")), 1).when(F.is_valid_utf8(F.substring(raw, 1, size - 2).cast("string")), 2).otherwise(3)
    rest = F.regexp_replace(F.lower(F.hex(F.substring(raw, size + 1 - end, end))), "(..)", "\\\\x$1")
    return F.when(whole, raw.cast("string")).otherwise(F.concat(F.substring(raw, F.lit(1), size - end).cast("string"), rest))


def keyed(textures: DataFrame, criterion: str, key_bytes: int = KEY_BYTES) -> DataFrame:
    """textures with dup_key for the criterion name, hash or name_hash. Rows without data have no hash, so they only
    take part by name."""
    by_name = name_key(F.col("name"), key_bytes)
    key = {"name": by_name, "hash": F.col("sha"), "name_hash": F.when(F.col("sha").isNotNull(), F.concat(by_name, F.lit("|"), F.col("sha")))}[criterion]
    return textures.withColumn("dup_key", key).where(F.col("dup_key").isNotNull())


def groups(textures: DataFrame, criterion: str, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Groups of two members or more: dup_key, members, distinct_payloads, first_archive, first_ordinal (the master),
    master_size, total_bytes, wasted_bytes."""
    rows = keyed(textures, criterion, key_bytes)
    first = F.min(F.struct("archive", "ordinal", "data_size"))
    # distinct payloads: least and greatest hash tell one from several; exact numbers take a second level
    by_payload = rows.groupBy("dup_key", "sha").agg(F.count("*").alias("n"), F.sum("data_size").alias("bytes"), first.alias("first"))
    out = by_payload.groupBy("dup_key").agg(F.sum("n").alias("members"), F.count("sha").alias("distinct_payloads"), F.sum("bytes").alias("total_bytes"), F.min("first").alias("first"))
    return out.where("members > 1").select("dup_key", "members", "distinct_payloads", F.col("first.archive").alias("first_archive"), F.col("first.ordinal").alias("first_ordinal"), F.col("first.data_size").alias("master_size"), "total_bytes", (F.col("total_bytes") - F.col("first.data_size")).alias("wasted_bytes"))


def members(textures: DataFrame, criterion: str, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Members of the groups with is_master."""
    found = groups(textures, criterion, key_bytes).select("dup_key", "members", "first_archive", "first_ordinal")
    rows = keyed(textures, criterion, key_bytes).join(found, "dup_key")
    return rows.withColumn("is_master", (F.col("archive") == F.col("first_archive")) & (F.col("ordinal") == F.col("first_ordinal")))


def copies(textures: DataFrame, criterion: str, strategy: str) -> DataFrame:
    """What goes to consolidated bins: dup_key, archive, ordinal, name, data_size. mixed: the master of each group;
    remove: the first of each distinct name (whatever its case) of a group."""
    rows = members(textures, criterion)
    if strategy == "mixed":
        return rows.where("is_master").select("dup_key", "archive", "ordinal", "name", "data_size")
    first = rows.groupBy("dup_key", F.lower("name").alias("low")).agg(F.min(F.struct("archive", "ordinal", "name", "data_size")).alias("m"))
    return first.select("dup_key", "m.archive", "m.ordinal", "m.name", "m.data_size")


def removals(textures: DataFrame, criterion: str, strategy: str) -> DataFrame:
    """Members to be removed from their archives: dup_key, archive, ordinal. mixed: all but the master; remove: all."""
    rows = members(textures, criterion)
    return (rows.where("NOT is_master") if strategy == "mixed" else rows).select("dup_key", "archive", "ordinal")


def commit(textures: DataFrame, removed: DataFrame) -> DataFrame:
    """The catalogue without the removed rows, by stable ids."""
    return textures.join(removed.select("archive", "ordinal").distinct(), ["archive", "ordinal"], "left_anti")


def committed(textures: DataFrame, removed: DataFrame, binned: DataFrame, name: str = "consolidated_textures_%d.ytd") -> DataFrame:
    """The catalogue after a migration: without the removed rows, and with the copies in their bins' archives. binned: rows
    (archive, ordinal, bin) of textures that are copied. A copy keeps all fields but its place: its archive is the bin's, its
    ordinal its place in it, in the order of the bins' making."""
    kept = commit(textures, removed)
    place = Window.partitionBy("bin").orderBy("group_archive", "group_ordinal", "archive", "ordinal")  # a bin holds few textures: LIMIT bytes
    order = binned.withColumn("__place", (F.row_number().over(place) - 1).cast("long")).select("archive", "ordinal", "bin", "__place")
    moved = textures.join(order, ["archive", "ordinal"])
    new = {"archive": F.format_string(name, F.col("bin")), "ordinal": F.col("__place").cast(textures.schema["ordinal"].dataType)}
    return kept.unionByName(moved.select(*(new.get(c, F.col(c)).alias(c) for c in textures.columns)))


def kept_back(removed: DataFrame, bins: DataFrame, keep_bins: tuple[int, ...]) -> DataFrame:
    """The removals that don't feed a bin whose originals are to be kept. bins: (dup_key, bin)."""
    held = bins.where(F.col("bin").isin(*keep_bins)).select("dup_key").distinct()
    return removed.join(held, "dup_key", "left_anti")


def aliases(blocks: DataFrame) -> DataFrame:
    """Blocks (archive, ordinal, data_off) with aliased: whether another of the archive has the same offset."""
    shared = blocks.groupBy("archive", "data_off").agg(F.count("*").alias("n"))
    return blocks.join(shared, ["archive", "data_off"]).select("archive", "ordinal", "data_off", (F.col("n") > 1).alias("aliased"))


def distinct_sources(paths: DataFrame) -> DataFrame:
    """Distinct source containers, whatever their case: the least spelling of each."""
    return paths.where(F.col("source_path").isNotNull()).groupBy(F.lower("source_path").alias("source_key")).agg(F.min("source_path").alias("source_path"), F.count("*").alias("entries"))


def numbered(rows: DataFrame, keys: list[str], position: str, block: int = 4096) -> DataFrame:
    """rows with n: the place of each within its key by the long column position, from 1. Keys are dealt into blocks
    of positions, so that a hot key is no single task: numbers within blocks, plus the rows of the blocks before."""
    dealt = rows.withColumn("__block", F.floor(F.col(position) / block))
    sizes = dealt.groupBy(*keys, "__block").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    inside = Window.partitionBy(*keys, "__block").orderBy(position)
    return dealt.withColumn("__n", F.row_number().over(inside)).join(offsets, [*keys, "__block"]).withColumn("n", F.col("__before") + F.col("__n")).drop("__block", "__before", "__n")
