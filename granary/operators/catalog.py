"""Search, sorts and roll-ups of a texture catalogue (archive, ordinal, name, format, width, height, mips, data_size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import texture as T


def contains(name: Column, query: str) -> Column:
    """Case-insensitive substring, without wildcards; an empty query matches all, null names match only that."""
    return F.lit(True) if not query else F.coalesce(F.lower(name).contains(query.lower()), F.lit(False))


def search_textures(textures: DataFrame, query: str) -> DataFrame:
    return textures.where(contains(F.col("name"), query))


def search_archives(archives: DataFrame, textures: DataFrame, query: str) -> DataFrame:
    """Archives (archive, parent) whose own name matches, that hold a matching texture, or of which a child does."""
    hit = archives.where(contains(F.col("archive"), query)).select("archive", "parent").unionByName(textures.where(contains(F.col("name"), query)).select("archive").distinct().join(archives.select("archive", "parent"), "archive"))
    found = hit.select("archive").unionByName(hit.where(F.col("parent").isNotNull()).select(F.col("parent").alias("archive"))).distinct()
    return archives.join(found, "archive", "left_semi")


def visible_rows(archives: DataFrame, textures: DataFrame, expanded: tuple[str, ...], query: str = "") -> DataFrame:
    """Header rows of archives and, below those that are expanded (all, in a search), their matching textures:
    archive, ordinal (null for a header), name."""
    shown = search_archives(archives, textures, query)
    rows = search_textures(textures, query)
    rows = rows.join(shown.select("archive"), "archive", "left_semi")
    if not query:
        rows = rows.where(F.col("archive").isin(*expanded))
    headers = shown.select("archive", F.lit(None).cast("long").alias("ordinal"), F.col("archive").alias("name"))
    return headers.unionByName(rows.select("archive", F.col("ordinal").cast("long"), "name"))


def importable(files: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """files (path) whose extension is among the enabled import types and whose names don't start with a dot."""
    from granary.functions import paths

    return files.where(paths.is_supported(F.col("path"), enabled) & ~paths.leaf(F.col("path")).startswith("."))


def archive_rollup(textures: DataFrame) -> DataFrame:
    """Per archive: textures, total_bytes, max_pixels, max_mips, largest texture (the first of the largest) and the
    primary format, which is that texture's."""
    pixels = F.col("width").cast("long") * F.col("height")
    best = F.max_by(F.struct("ordinal", "name", "format"), F.struct(pixels, -F.col("ordinal")))
    out = textures.groupBy("archive").agg(F.count("*").alias("textures"), F.sum("data_size").alias("total_bytes"), F.coalesce(F.max(pixels), F.lit(0)).alias("max_pixels"), F.max("mips").alias("max_mips"), best.alias("best"))
    return out.select("archive", "textures", "total_bytes", "max_pixels", "max_mips", F.col("best.ordinal").alias("largest_ordinal"), F.col("best.name").alias("largest_name"), F.col("best.format").alias("primary_format"))


def group_rollup(archives: DataFrame, rolled: DataFrame) -> DataFrame:
    """Per parent: its children and the sum of their bytes."""
    rows = archives.where(F.col("parent").isNotNull()).join(rolled.select("archive", "total_bytes"), "archive", "left")
    return rows.groupBy("parent").agg(F.count("*").alias("children"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"))


def workspace_totals(archives: DataFrame, rolled: DataFrame) -> DataFrame:
    """One row: files (archives without a parent; groups count), resources (textures outside group rows), bytes."""
    rows = archives.join(rolled.select("archive", "textures", "total_bytes"), "archive", "left")
    return rows.agg(
        F.count_if(F.col("parent").isNull()).alias("files"),
        F.coalesce(F.sum(F.when(~F.col("is_group"), F.col("textures"))), F.lit(0)).alias("resources"),
        F.coalesce(F.sum(F.when(~F.col("is_group"), F.col("total_bytes"))), F.lit(0)).alias("bytes"),
    )


def scan_counters(archives: DataFrame) -> DataFrame:
    """One row of counts by status: candidates, loaded, rejected, unavailable, encrypted."""
    by = lambda s: F.count_if(F.col("status") == s)
    return archives.agg(F.count("*").alias("candidates"), by("ok").alias("loaded"), by("rejected").alias("rejected"), by("unavailable").alias("unavailable"), by("encrypted").alias("encrypted"))


#: Sort keys of archives: (column or expression name, descending); the name, then the id, make the order total.
ARCHIVE_MODES = {
    "name": [("name", False)],
    "type": [("ext", False)],
    "size": [("total_bytes", True)],
    "count": [("textures", True)],
    "resolution": [("max_pixels", True), ("name", False)],
    "mipmaps": [("max_mips", True), ("name", False)],
    "compression": [("format_name", False), ("name", False)],
    "modified": [("modified", True)],
}
TEXTURE_MODES = {
    "size": [("data_size", True), ("name", False)],
    "resolution": [("pixels", True), ("width", True), ("height", True), ("name", False)],
    "mipmaps": [("mips", True), ("name", False)],
    "compression": [("format_name", False), ("name", False)],
    "type": [("format_name", False), ("name", False)],
    "name": [("name", False)],
}


def _order(keys: list[tuple[str, bool]], last: list[str]) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in keys] + [F.asc(c) for c in last]


def sort_archives(archives: DataFrame, mode: str) -> DataFrame:
    """archives with the columns of the mode, in its order (a range sort over all tasks)."""
    return archives.orderBy(*_order(ARCHIVE_MODES[mode], ["archive"]))


def sort_textures(textures: DataFrame, mode: str) -> DataFrame:
    """Textures within their archives; modes that only sort archives leave them in load order."""
    keys = TEXTURE_MODES.get(mode)
    rows = textures.withColumn("pixels", F.col("width").cast("long") * F.col("height")).withColumn("format_name", T.format_name(F.col("format")))
    return rows.orderBy("archive", *_order(keys or [], ["ordinal"]))




#: Textures of an archive, archives of a workspace and replacements of a container at most.
LIMITS = {"textures": 4096, "archives": 8192, "replacements": 4096, "sources": 512}


def beyond_limits(counts: DataFrame, limit: str = "textures") -> DataFrame:
    """counts (with the column named as the limit) with within_limit: nothing is dropped, excess is told."""
    return counts.withColumn("within_limit", F.col(limit) <= LIMITS[limit])


def savable(textures: DataFrame, kind: str = "ytd") -> DataFrame:
    """Per archive: invalid textures (no data, no name, or a format that the kind of file can't hold), savable."""
    code = T.wtd_code(F.col("format")) if kind == "wtd" else T.dx9_code(F.col("format"))
    bad = F.coalesce(F.col("data_size"), F.lit(0)) <= 0
    bad = bad | (F.coalesce(F.col("name"), F.lit("")) == "") | (code == 0)
    return textures.groupBy("archive").agg(F.count_if(bad).alias("invalid"), F.bool_and(~bad).alias("savable"))


def labelled(keys: DataFrame, translations: DataFrame, language: str, fallback: str = "en") -> DataFrame:
    """keys (key) with label: that of the language, else of the fallback, else the key. translations: (language, key,
    label), of which there may be any number."""
    of = lambda lang, name: translations.where(F.col("language") == lang).groupBy("key").agg(F.min("label").alias(name))
    out = keys.join(of(language, "__own"), "key", "left").join(of(fallback, "__else"), "key", "left")
    return out.withColumn("label", F.coalesce("__own", "__else", "key")).drop("__own", "__else")
