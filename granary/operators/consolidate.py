"""Consolidation bins: next-fit over the copies in order of their groups.

Where a bin ends depends on all rows before it, but on little of them: the bytes in the open bin.  The rows are sorted
into ranges; for each range a task works out, for every fill with which the range may be entered, the fill at its end and
the bins opened in it.  That is a step function, as only the place of the first new bin matters, and its steps fall
together soon.  The functions of the ranges, one row each, are chained from range to range, and the ranges are then numbered
side by side, each from the fill and bin that it is entered with.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.tables import settled

#: Bytes of a bin.
LIMIT = 16 * 1024 * 1024


def next_fit(sizes, limit: int, fill: int = 0, number: int = 0):
    """(bin, fill after) for each size: a new bin opens when the open one would pass the limit; the first row opens
    bin 1; a row larger than the limit has a bin of its own."""
    for size in sizes:
        if number == 0 or fill + size > limit:
            number, fill = number + 1, 0
        fill += size
        yield number, fill


def passage(sizes: list[int], limit: int) -> list[tuple[int, int, int, bool]]:
    """What next-fit does to a range of sizes, by the fill on entering it, in an open bin: (least fill, bins opened, fill
    after, whether the fill on entering is in it) in falling order of the least fill."""
    n = len(sizes)
    before = [0]
    for s in sizes:
        before.append(before[-1] + s)
    # from each place that a bin may start at: the bins opened from there on, and the fill at the end
    ends: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = max(i + 1, bisect_right(before, before[i] + limit) - 1)  # the first place beyond the bin
        ends[i] = (1, before[n] - before[i]) if j >= n else (1 + ends[j][0], ends[j][1])
    out = []
    for i in range(n):  # entered with more than limit - before[i + 1], and no more than limit - before[i]: a bin starts at i
        least = max(0, limit - before[i + 1] + 1)
        if i == 0 or before[i] <= limit:
            if out and out[-1][1:] == (*ends[i], False):
                out[-1] = (least, *out[-1][1:])
            elif not out or least < out[-1][0]:
                out.append((least, *ends[i], False))
    if before[n] <= limit:
        out.append((0, 0, before[n], True))
    return out


def entered(passages: list[list[tuple[int, int, int, bool]]]) -> list[tuple[int, int]]:
    """(bin, fill) with which each range is entered; the very first row opens bin 1."""
    number, fill, out = 0, 0, []
    for steps in passages:
        out.append((number, fill))
        if not steps:
            continue
        # before the first row no bin is open, as if the last one were full
        _, opened, after, stays = next(s for s in steps if number == 0 or fill >= s[0])
        number, fill = number + opened, after + (fill if stays else 0)
    return out


def bins(copies: DataFrame, limit: int = LIMIT) -> DataFrame:
    """copies (dup_key, archive, ordinal, data_size) with bin, from 1, in (first archive, first ordinal of the group,
    archive, ordinal) order, and with that order's group_archive and group_ordinal."""
    order = ["group_archive", "group_ordinal", "archive", "ordinal"]
    first = copies.groupBy("dup_key").agg(F.min(F.struct("archive", "ordinal")).alias("g"))
    rows = copies.join(first, "dup_key").select("dup_key", "archive", F.col("ordinal").cast("long").alias("ordinal"), F.col("data_size").cast("long").alias("data_size"), F.col("g.archive").alias("group_archive"), F.col("g.ordinal").cast("long").alias("group_ordinal"))
    # ranges are fixed by writing them once: range, then place in it
    ranged = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    kinds = pa.schema([("range", pa.int32()), ("least", pa.list_(pa.int64())), ("opened", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("stays", pa.list_(pa.bool_()))])

    def passing(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        steps = passage(table.column("data_size").to_pylist(), limit)
        return pa.Table.from_pylist([{"range": table.column("range")[0].as_py(), **{k: [s[i] for s in steps] for i, k in enumerate(("least", "opened", "after", "stays"))}}], schema=kinds)

    found = ranged.groupBy("range").applyInArrow(passing, "range int, least array<long>, opened array<long>, after array<long>, stays array<boolean>")
    steps = sorted(found.collect(), key=lambda r: r["range"])  # one row a range, of few steps
    starts = entered([list(zip(r["least"], r["opened"], r["after"], r["stays"])) for r in steps])
    begin = {r["range"]: s for r, s in zip(steps, starts)}
    names = ["dup_key", "archive", "ordinal", "data_size", "group_archive", "group_ordinal"]
    ddl = "dup_key string, archive string, ordinal long, data_size long, group_archive string, group_ordinal long, bin long"

    def numbered(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        number, fill = begin[table.column("range")[0].as_py()]
        got = [b for b, _ in next_fit(table.column("data_size").to_pylist(), limit, fill, number)]
        return table.select(names).append_column("bin", pa.array(got, pa.int64()))

    return ranged.groupBy("range").applyInArrow(numbered, ddl)


def summary(binned: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """bin, textures, bytes, file_name; in the folder of the first archive (archive, path) that has a path, if given."""
    out = binned.groupBy("bin").agg(F.count("*").alias("textures"), F.sum("data_size").alias("bytes"))
    name = F.format_string("consolidated_textures_%d.ytd", F.col("bin"))
    if archives is None:
        return out.withColumn("file_name", name)
    first = archives.where(F.col("path").isNotNull()).agg(F.min_by("path", "archive").alias("path"))  # one row
    folder = F.coalesce(F.regexp_extract("path", r"^(.*[/\\\\])", 1), F.lit(""))
    return out.join(F.broadcast(first.select(folder.alias("folder"))), F.lit(True), "left").withColumn("file_name", F.concat(F.coalesce("folder", F.lit("")), name)).drop("folder")
