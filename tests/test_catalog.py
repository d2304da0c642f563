from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import paths
from granary.functions import texture as T
from granary.operators import catalog, consolidate, dedup, edits, naming, optimise, tables
from granary.plans.standins import sized_parts, tex_docs

DATA = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_sizes_by_hand(spark):
    i = F.lit
    row = one(spark, T.mip_bytes(i(5), i(5), i(0)), T.total_mip_bytes(i(8), i(8), i(5), i(4)), T.total_mip_bytes(i(8), i(8), i(1), i(0)), T.stride(i(256), i(256), i(4)), T.stride(i(100), i(3), i(20)), T.natural_levels(i(1024), i(2)), T.natural_levels(i(1), i(1)))
    assert tuple(row) == (32, 4 * (64 + 16 + 4 + 1), 0, 256, 100, 11, 1)


def test_resize_by_loop(spark):
    cases = [(w, h, m) for w in (1, 3, 16, 100, 513, 4096) for h in (1, 7, 512, 2048) for m in (1, 64, 512)]
    df = spark.createDataFrame(cases, "w int, h int, m int").withColumn("k", T.halvings(F.col("w"), F.col("h"), F.col("m"), F.col("m")))
    for r in df.withColumn("nw", T.resized(F.col("w"), F.col("k"))).withColumn("nh", T.resized(F.col("h"), F.col("k"))).collect():
        w, h = r.w, r.h
        while w > r.m or h > r.m:
            w, h = max(1, w // 2), max(1, h // 2)
        assert (r.nw, r.nh) == (max(4, w), max(4, h))


def test_hash_of_names(spark):
    from granary.sources.resource import name_hash

    names = ["", "a", "Prop_01", "VEHICLE.dds", "ñandú É", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.name_hash(F.col("n"))).collect()] == [name_hash(n.encode()) for n in names]
    raw = [bytes([0, 255, 128, 7]), b"", b"AbC"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    assert [r[0] for r in df.select(T.data_hash(F.col("b"))).collect()] == [name_hash(b, lower=False) for b in raw]


def test_grades_and_text(spark):
    mib = 1024 * 1024
    sizes = [0, int(0.7 * mib), mib, mib + 1, int(3.5 * mib), int(4.5 * mib) - 1, int(4.5 * mib)]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    assert [r[0] for r in df.select(T.grade(F.col("s"), T.TEXTURE_GRADES)).collect()] == [0, 0, 1, 2, 5, 6, 7]
    assert one(spark, T.mib_text(F.lit(131072)), T.grouped_text(F.lit(1234567))) == ("0.12", "1,234,567")


def test_paths(spark):
    rows = [("C:\\a\\B.YTD",), ("x.rpf/y/z.wtd",), ("a/b.Rpf\\c.ydr",), ("noext",), (".hidden.ytd",)]
    df = spark.createDataFrame(rows, "p string")
    got = [tuple(r) for r in df.select(paths.leaf(F.col("p")), paths.extension(F.col("p")), paths.is_nested(F.col("p")), paths.loader(F.col("p"))).collect()]
    assert got == [("B.YTD", ".ytd", False, "ytd"), ("z.wtd", ".wtd", True, "wtd"), ("c.ydr", ".ydr", True, "model"), ("noext", "", False, "ytd"), (".hidden.ytd", ".ytd", False, "ytd")]


def test_next_fit_limits():
    limit = 16
    assert [b for b, _ in consolidate.next_fit([16, 1, 15, 1, 40, 1], limit)] == [1, 2, 2, 3, 4, 5]
    assert list(consolidate.next_fit([], limit)) == []


def test_duplicates_do_not_depend_on_partitioning(spark):
    t = tex_docs(spark, DATA)
    a = sorted(map(tuple, dedup.groups(t, "hash").collect()))
    assert a == sorted(map(tuple, dedup.groups(t.repartition(7), "hash").collect()))
    kept = dedup.commit(t, dedup.removals(t, "hash", "mixed"))
    assert dedup.groups(kept, "hash").count() == 0


def test_long_and_null_names(spark):
    rows = [("a", 1, "N" * 70, "s1", 1), ("a", 2, "n" * 64 + "zz", "s2", 1), ("a", 3, None, None, 0), ("b", 1, None, "s1", 1)]
    t = spark.createDataFrame(rows, "archive string, ordinal long, name string, sha string, data_size long")
    assert [r.members for r in dedup.groups(t, "name").collect()] == [2]
    assert [r.members for r in dedup.groups(t, "hash").collect()] == [2]
    assert dedup.groups(t.limit(0), "name_hash").count() == 0


def test_numbered_beyond_blocks(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("pos"))
    got = dedup.numbered(df, ["k"], "pos", block=16).orderBy("pos").collect()
    assert [r.n for r in got] == list(range(1, 101))


def test_orders(spark):
    t = sized_parts(spark, DATA)
    rows = catalog.sort_textures(t, "resolution").collect()
    keys = [(r.archive, -r.pixels, -r.width, -r.height, r["name"], r.ordinal) for r in rows]
    assert keys == sorted(keys)
    rolled = catalog.archive_rollup(t).withColumn("name", F.col("archive")).withColumn("modified", F.lit(0)).withColumn("ext", F.lit(".ytd")).withColumn("format_name", F.lit("x"))
    for mode in catalog.ARCHIVE_MODES:
        assert catalog.sort_archives(rolled, mode).count() == rolled.count()


def test_edit_then_revert_is_identity(spark):
    t = sized_parts(spark, DATA)
    e = t.limit(5).select("archive", "ordinal", F.lit(1).alias("seq"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(0).alias("format"), F.lit(1).alias("mips"))
    now = edits.current(t, e)
    assert now.where("modified").count() == 5
    back = edits.current(t, edits.reverted(e, t)).select(*t.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


def test_empty_tables(spark):
    t = sized_parts(spark, DATA).limit(0)
    assert catalog.archive_rollup(t).count() == 0
    assert optimise.resize_summary(t).collect() in ([], [(None, 0, 0, 0)])
    assert tuple(optimise.recompress_summary(t.withColumn("alpha_used", F.lit(True))).first())[-1] == 0.0
    assert naming.export_names(t).count() == 0


def test_export_name_clash(spark):
    t = spark.createDataFrame([("a", 1, "x?"), ("a", 2, "X*"), ("b", 3, "x?")], "archive string, ordinal long, name string")
    assert sorted(r.file_name for r in naming.export_names(t).collect()) == ["X__2.dds", "x_.dds", "x_.dds"]


def test_name_keys_by_bytes(spark):
    """The first 64 bytes count, with A-Z lower-cased; a cut character's bytes still tell names apart."""
    names = ["Plain", "PLAIN", "x" * 63 + "\u00e9", "x" * 63 + "\u00e8", "x" * 63 + "\u0100", "\u00c9" + "a" * 70, "\u00e9" + "a" * 70, "x" * 62 + "\u4e2d", "x" * 61 + "\U0001d4b3", "x" * 64 + "tail", "x" * 64, "", None]

    def plain(name):
        return None if name is None else "".join(c.lower() if c.isascii() else c for c in name).encode()[:64]

    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string").select("i", dedup.name_key(F.col("name")).alias("k")).collect()
    got = {r.i: r.k for r in rows}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert (got[i] == got[j]) == (plain(a) == plain(b)), (a, b)
    assert got[0] == "plain" and got[9] == "x" * 64 and got[12] is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 3, 5, 9, 12, 30]), max_size=40), st.lists(st.integers(0, 40), max_size=5), st.sampled_from([1, 5, 10, 20]))
def test_bins_of_ranges_are_those_of_one_pass(sizes, cuts, limit):
    edges = [0, *sorted(min(c, len(sizes)) for c in cuts), len(sizes)]
    ranges = [sizes[a:b] for a, b in zip(edges, edges[1:])]
    starts = consolidate.entered([consolidate.passage(r, limit) for r in ranges])
    got = [n for r, (number, fill) in zip(ranges, starts) for n, _ in consolidate.next_fit(r, limit, fill, number)]
    assert got == [n for n, _ in consolidate.next_fit(sizes, limit)]


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(None if rng.random() < 0.1 else f"k{int(rng.integers(0, 3)) ** 2}", int(rng.integers(0, 50)), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, v int, i long").withColumn("name", F.lit("clash"))
    got = {r.i: r.place for r in tables.ranked(df, ["k"], [F.desc("v"), F.asc("i")], "place").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    whole = tables.ranked(df, [], [F.desc("v"), F.asc("i")]).collect()
    assert [r.i for r in sorted(whole, key=lambda r: r["rank"])] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert tables.ranked(df.limit(0), ["k"], [F.asc("v")]).count() == 0


def test_commit_brings_copies_in(spark):
    rows = [("a", 0, "x", 5, "s1"), ("b", 0, "X", 5, "s1"), ("b", 1, "y", 5, "s1"), ("c", 0, "z", 9, "s2"), ("c", 1, "z", 9, "s2"), ("d", 0, "alone", 1, "s3")]
    t = spark.createDataFrame(rows, "archive string, ordinal int, name string, data_size long, sha string")
    run = lambda how: sorted(tuple(r)[:3] for r in dedup.committed(t, dedup.removals(t, "hash", how), consolidate.bins(dedup.copies(t, "hash", how), 12)).collect())
    name = "consolidated_textures_%d.ytd"
    assert run("mixed") == sorted([("a", 0, "x"), ("c", 0, "z"), ("d", 0, "alone"), (name % 1, 0, "x"), (name % 2, 0, "z")])
    assert run("remove") == sorted([("d", 0, "alone"), (name % 1, 0, "x"), (name % 1, 1, "y"), (name % 2, 0, "z")])
