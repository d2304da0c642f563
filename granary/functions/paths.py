"""Column expressions over file and entry paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that file names may not hold.
ILLEGAL = ':*?"<>|'
SUPPORTED = (".ytd", ".wtd", ".ydr", ".yft", ".ydd", ".rpf")
#: Inside containers, nested containers are walked, not listed.
SUPPORTED_INSIDE = SUPPORTED[:-1]


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def leaf(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows it in the leaf, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(leaf(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(leaf(path), r"\.[^.]*$", "")


def renamed(path: Column, ext: str) -> Column:
    """path with another extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(ext))


def sanitised(name: Column) -> Column:
    return F.translate(name, ILLEGAL, "_" * len(ILLEGAL))


def is_supported(path: Column, enabled: tuple[str, ...] = SUPPORTED) -> Column:
    return extension(path).isin(*enabled)


def is_nested(path: Column) -> Column:
    """Whether a logical path lies inside a container within a container."""
    return F.lower(slashed(path)).contains(".rpf/")


def loader(path: Column) -> Column:
    """The reader for a file, by extension; anything unknown is read as a dictionary."""
    ext = extension(path)
    return F.when(ext == ".wtd", "wtd").when(ext.isin(".ydr", ".yft", ".ydd"), "model").when(ext == ".rpf", "rpf").otherwise("ytd")
