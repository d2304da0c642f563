"""Round trips and damage of asset files, and pixels."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions.formats import BY_CODE, FORMATS, total_bytes
from granary.operators import pixels
from granary.pixels import codec
from granary.sinks import archives as sink
from granary.sinks import images
from granary.sources import container, dictionary, files, resource


def texture(name: str, w: int = 8, h: int = 8, fmt: int = 0, mips: int = 1, seed: int = 0) -> dict:
    n = total_bytes(w, h, fmt, mips)
    return {"name": name, "width": w, "height": h, "format": fmt, "mip_count": mips, "stride": 0, "data": np.random.default_rng(seed).integers(0, 256, n, np.uint8).tobytes(), "data_size": n}


DX9 = [f.code for f in FORMATS if f.dx9]
FIELDS = ("name", "width", "height", "format", "mip_count", "data")


def same(a: list[dict], b: list[dict]) -> None:
    key = lambda t: (t["name"], t["data"])
    assert [[t[f] for f in FIELDS] for t in sorted(a, key=key)] == [[t[f] for f in FIELDS] for t in sorted(b, key=key)]


def test_ytd_round_trip():
    rows = [texture(f"tex_{i}", 16, 8 << i % 3, f, 1 + i % 4, i) for i, f in enumerate(DX9)]
    fields, back = dictionary.read_ytd(dictionary.write_ytd(rows))
    assert fields["version"] == 13
    same(rows, back)
    assert [t["name_hash"] for t in back] == sorted(t["name_hash"] for t in back)


def test_wtd_round_trip():
    rows = [texture(f"t{i}", 8, 8, f.code, 2, i) for i, f in enumerate(FORMATS) if f.wtd]
    fields, back = dictionary.read_wtd(dictionary.write_wtd({"usage_count": 3}, rows))
    assert fields["usage_count"] == 3
    same(rows, back)
    again = dictionary.read_wtd(dictionary.write_wtd(fields, back))[1]
    assert [t["meta"] for t in again] == [t["meta"] for t in back]
    assert dictionary.clean_wtd_name("PACK:/foo.DDS") == "foo"


def test_gen9_is_read():
    system, graphics = bytearray(0x200), bytes(64)
    struct.pack_into("<H", system, 0x28, 1)
    struct.pack_into("<Q", system, 0x30, resource.VIRTUAL + 0x40)
    struct.pack_into("<Q", system, 0x40, resource.VIRTUAL + 0x50)
    e = 0x50
    struct.pack_into("<Q", system, e + 0x28, resource.VIRTUAL + 0x100)
    struct.pack_into("<HH", system, e + 0x40, 4, 4)
    struct.pack_into("<I", system, e + 0x48, 99)
    system[e + 0x4D] = 1
    struct.pack_into("<Q", system, e + 0x60, resource.PHYSICAL)
    system[0x100:0x104] = b"nine"
    raw = resource.write_rsc7(5, resource.single_page(len(system)), resource.single_page(64), bytes(system), graphics)
    (t,) = dictionary.read_ytd(raw)[1]
    assert (t["name"], t["format"], t["data_size"]) == ("nine", 4, 16)


@pytest.mark.parametrize("damage", ["empty", "magic", "short", "count0", "count5000", "pointer"])
def test_damaged_dictionaries_are_refused(damage):
    raw = dictionary.write_ytd([texture("a", 64, 64, 5)])
    r = resource.read_rsc7(raw)
    system = bytearray(r.system)
    if damage == "empty":
        raw = b""
    elif damage == "magic":
        raw = b"XXXX" + raw[4:]
    elif damage == "short":
        raw = raw[:100]
    else:
        at, fmt, value = {"count0": (0x28, "<H", 0), "count5000": (0x28, "<H", 5000), "pointer": (0x30, "<Q", resource.VIRTUAL + 10**6)}[damage]
        struct.pack_into(fmt, system, at, value)
        raw = resource.write_rsc7(13, r.system_flags, r.graphics_flags, bytes(system), r.graphics)
    with pytest.raises(resource.Rejected):
        dictionary.read_ytd(raw)


def test_unsavable_textures():
    with pytest.raises(ValueError):
        dictionary.write_ytd([texture("a", fmt=10)])
    with pytest.raises(ValueError):
        dictionary.write_wtd({}, [texture("a", fmt=4)])
    with pytest.raises(ValueError):
        dictionary.write_ytd([])


def model(ext: str, shared: bool = False) -> bytes:
    """A model file around dictionaries of one texture each (one for .ydr and .yft, two for .ydd)."""
    n = 2 if ext == ".ydd" else 1
    system, graphics = bytearray(0x1000), bytes(range(256)) * 2
    drawables = [0] if ext == ".ydr" else [0x100 + 0x400 * i for i in range(n)]
    if ext == ".yft":
        struct.pack_into("<Q", system, 0x30, resource.VIRTUAL + drawables[0])
    if ext == ".ydd":
        struct.pack_into("<QH", system, 0x30, resource.VIRTUAL + 0x80, n)
        struct.pack_into("<2Q", system, 0x80, *(resource.VIRTUAL + d for d in drawables))
    for i, d in enumerate(drawables):
        base = 0x180 + 0x400 * i
        struct.pack_into("<Q", system, d + 0x10, resource.VIRTUAL + base)
        struct.pack_into("<Q", system, base + 8, resource.VIRTUAL + base + 0x20)
        at = base + 0x20
        struct.pack_into("<H", system, at + 0x28, 1)
        struct.pack_into("<Q", system, at + 0x30, resource.VIRTUAL + at + 0x40)
        e = at + 0x50
        struct.pack_into("<Q", system, at + 0x40, resource.VIRTUAL + e)
        struct.pack_into("<Q", system, e + 0x28, resource.VIRTUAL + e + 0xA0)
        system[e + 0xA0 : e + 0xA3] = b"m%d\0" % i
        struct.pack_into("<HH", system, e + 0x50, 8, 8)
        struct.pack_into("<I", system, e + 0x58, BY_CODE[0].dx9)
        system[e + 0x5D] = 1
        struct.pack_into("<Q", system, e + 0x70, resource.PHYSICAL + (0 if shared else 64 * i))
    return resource.write_rsc7(165, resource.single_page(len(system), 10), resource.single_page(512, 5), bytes(system), graphics)


@pytest.mark.parametrize("ext", [".ydr", ".yft", ".ydd"])
def test_models(ext):
    raw = model(ext)
    _, rows = dictionary.read_model(raw, ext)
    assert [t["name"] for t in rows] == ["m0", "m1"][: len(rows)] and len(rows) == (2 if ext == ".ydd" else 1)
    small, big = texture("m0", 4, 4, 0, 1, 1), texture("m0", 32, 32, 5, 1, 2)
    out = dictionary.recompose_model(raw, ext, {0: small})
    assert resource.read_rsc7(out).graphics_flags == resource.read_rsc7(raw).graphics_flags
    assert dictionary.read_model(out, ext)[1][0]["data"] == small["data"]
    assert dictionary.read_model(dictionary.recompose_model(raw, ext, {0: big}), ext)[1][0]["data"] == big["data"]


def test_shared_blocks_are_not_overwritten():
    raw = model(".ydd", shared=True)
    before = dictionary.read_model(raw, ".ydd")[1]
    after = dictionary.read_model(dictionary.recompose_model(raw, ".ydd", {0: texture("m0", 4, 4, 0, 1, 9)}), ".ydd")[1]
    assert after[1]["data"] == before[1]["data"] and after[0]["data"] != before[0]["data"][:8]


def rpf(inside: list[tuple[str, bytes]], mode: int = 0) -> bytes:
    """A flat container of binaries and resources."""
    names, table, body = b"\0", [], b""
    first = -(-(16 + 16 * (len(inside) + 1) + sum(len(n) + 1 for n, _ in inside) + 1) // 512)
    for name, data in inside:
        at = len(names)
        names += name.encode() + b"\0"
        block = first + len(body) // 512
        body += data + bytes(-len(data) % 512)
        if data[:4] == b"RSC7":
            low = at | len(data) << 16 | (block | 1 << 23) << 40
            table.append(struct.pack("<Q", low) + data[8:16])
        else:
            table.append(struct.pack("<QII", at | len(data) << 16 | block << 40, len(data), 0))
    head = struct.pack("<4I", container.MAGIC, len(inside) + 1, len(names), mode) + struct.pack("<4I", 0, container.DIRECTORY, 1, len(inside)) + b"".join(table) + names
    return head + bytes(first * 512 - len(head)) + body


def test_container_walk_and_rewrite():
    ytd = dictionary.write_ytd([texture("a")])
    inner = rpf([("deep.ytd", ytd)])
    raw = rpf([("One.ytd", ytd), ("nested.rpf", inner), ("fake.rpf", b"not a container"), ("note.txt", b"hi")])
    assert [(e["logical_path"], e["depth"]) for e in container.walk(raw)] == [("One.ytd", 0), ("nested.rpf/deep.ytd", 1), ("note.txt", 0)]
    assert container.rewritten(raw, {"absent.ytd": b"x"}) == (raw, 0)
    new = dictionary.write_ytd([texture("b", 16, 16)])
    out, n = container.rewritten(raw, {"one.YTD": new, "note.txt": b"longer text"})
    assert n == 2
    toc = 16 + 16 * 5
    assert out[toc : len(raw)] == raw[toc:] and out[:16] == raw[:16]  # only entries changed
    found = {e["logical_path"]: container.payload(out, e) for e in container.walk(out)}
    assert found["One.ytd"] == new and found["note.txt"] == b"longer text" and found["nested.rpf/deep.ytd"] == ytd
    with pytest.raises(ValueError):
        container.rewritten(raw, {"One.ytd": b"no resource"})
    with pytest.raises(container.Encrypted):
        container.entries(rpf([("a.ytd", ytd)], 0x0FFFFFF9))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300_000), max_size=60))
def test_pages_never_straddle(sizes):
    offsets, flags, total = resource.pack_pages(sizes, 127)
    assert resource.page_bytes(flags) == total and resource.page_count(flags) <= 127
    taken = sorted((o, o + s) for o, s in zip(offsets, sizes) if s)
    assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:])) and all(o % 16 == 0 and e <= total for o, e in taken)
    if any(sizes):
        assert offsets[sizes.index(max(sizes))] == 0


def test_scan_of_a_folder(spark, tmp_path):
    ytd = dictionary.write_ytd([texture("a", 16, 16, 5, 2, 3), texture("b", seed=4)])
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.ytd").write_bytes(ytd)
    (tmp_path / "sub" / "bad.YTD").write_bytes(b"RSC7" + bytes(20))
    (tmp_path / "w.wtd").write_bytes(dictionary.write_wtd({}, [texture("w")]))
    (tmp_path / "m.ydd").write_bytes(model(".ydd"))
    (tmp_path / "c.rpf").write_bytes(rpf([("in.ytd", ytd), ("broken.ytd", b"zzzz")]))
    (tmp_path / "enc.rpf").write_bytes(rpf([("in.ytd", ytd)], 0x0FEFFFFF))
    (tmp_path / ".hidden.ytd").write_bytes(ytd)
    (tmp_path / "x.txt").write_bytes(b"no")
    found = files.listed(spark, str(tmp_path))
    rows = {r.archive_id.rsplit("/", 1)[-1] if "!" not in r.archive_id else r.entry_path: r for r in files.read_archives(found).collect()}
    assert {k: (r.status, r.textures) for k, r in rows.items()} == {"good.ytd": ("ok", 2), "bad.YTD": ("rejected", 0), "w.wtd": ("ok", 1), "m.ydd": ("ok", 2), "c.rpf": ("ok", 0), "in.ytd": ("ok", 2), "broken.ytd": ("unavailable", 0), "enc.rpf": ("encrypted", 0)}
    textures = files.read_textures(found)
    assert textures.count() == 7 and textures.select("texture_id").distinct().count() == 7
    assert files.read_entries(found).count() == 2
    saved = sink.save_dictionaries(textures.where(F.col("archive_id").endswith("good.ytd"))).first()
    assert saved.status == "ok"
    same(dictionary.read_ytd(bytes(saved.content))[1], dictionary.read_ytd(ytd)[1])
    out = images.export(textures.where(F.col("archive_id").endswith("good.ytd"))).orderBy("ordinal").collect()
    assert sorted(r.file_name for r in out) == ["a.dds", "b.dds"] and all(bytes(r.dds)[:4] == b"DDS " for r in out)
    new = dictionary.write_ytd([texture("n")])
    rep = spark.createDataFrame([(rows["c.rpf"].archive_id, "in.ytd", bytearray(new))], "source_path string, entry_path string, content binary")
    row = sink.rewrite_containers(found, rep).first()
    assert container.payload(bytes(row.content), next(container.walk(bytes(row.content)))) == new
    edit = spark.createDataFrame([(rows["m.ydd"].archive_id, 0, 4, 4, 0, 1, bytearray(texture("m0", 4, 4)["data"]))], "archive_id string, ordinal int, width int, height int, format int, mip_count int, data binary")
    assert sink.save_models(found, edit).first().status == "ok"
    files.register(spark)
    source = spark.read.format("texture_assets").load(str(tmp_path))
    assert source.count() == 7 and source.where("wtd_meta IS NOT NULL").count() == 1
    assert sorted(map(str, source.drop("texture_id", "archive_id").collect())) == sorted(map(str, textures.drop("texture_id", "archive_id").collect()))
    archives, both = files.load(found)
    assert archives.count() == len(rows) and sorted(map(str, both.collect())) == sorted(map(str, textures.collect()))


def test_names_with_underscores_and_large_files(spark, tmp_path):
    ytd = dictionary.write_ytd([texture("a")])
    (tmp_path / "_sub").mkdir()
    for name in ("_a.ytd", "_sub/b.YTD", "c.ytd", "_sub/.d.ytd", "._e.ytd", "_x.txt"):
        (tmp_path / name).write_bytes(ytd)
    found = files.listed(spark, str(tmp_path))
    assert sorted(r.path.rsplit(str(tmp_path), 1)[1] for r in found.collect()) == ["/_a.ytd", "/_sub/b.YTD", "/c.ytd"]
    assert files.read_textures(found).count() == 3
    assert "_sub" not in str([r.path for r in files.listed(spark, str(tmp_path), (".rpf",)).collect()])
    # files beyond the limit: containers are read by ranges, others are refused with a reason
    raw = rpf([("in.ytd", ytd), ("other.ytd", ytd)])
    (tmp_path / "big.rpf").write_bytes(raw)
    (tmp_path / "_big.rpf").write_bytes(raw)
    found = files.listed(spark, str(tmp_path), largest=len(ytd) - 1)
    assert found.where("content IS NOT NULL").count() == 0
    rows = files.read_archives(found).collect()
    assert sorted(r.status for r in rows) == ["ok"] * 6 + ["rejected"] * 3 and all("too many" in r.error for r in rows if r.status == "rejected")
    assert files.read_textures(found).count() == 4 and files.read_entries(found).count() == 4


def test_files_are_written_with_backups(spark, tmp_path):
    from granary.sinks import files as out

    ytd, src = dictionary.write_ytd([texture("a"), texture("b/c", seed=1)]), tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "one.ytd").write_bytes(ytd)
    (src / "sub" / "ONE.ytd").write_bytes(ytd)
    (src / "w.wtd").write_bytes(dictionary.write_wtd({}, [texture("w")]))
    nested = rpf([("deep.ytd", ytd)])
    (src / "c.rpf").write_bytes(rpf([("in.ytd", ytd), ("inner.rpf", nested)]))
    found = files.listed(spark, str(src))
    archives, textures = files.load(found)
    report = {r.path: r for r in out.export_images(textures.where("archive_id LIKE '%src/one.ytd'"), str(tmp_path / "dds")).collect()}
    assert sorted(p[len(str(tmp_path)) :] for p in report) == ["/dds/one/a.dds", "/dds/one/b_c.dds"] or len(report) == 2
    assert all(r.status == "written" and open(p, "rb").read()[:4] == b"DDS " for p, r in report.items())
    saved = out.natives(archives, textures)
    listed = archives.withColumn("is_preview", F.lit(False)).withColumn("position", F.xxhash64("archive_id")).withColumn("modified", F.lit(True))
    folder, report = out.snapshot(saved, listed, str(tmp_path / "projects"))
    rows = report.collect()
    assert len(rows) == 5 and all(r.status == "written" and r.path.startswith(folder) for r in rows) and len({r.path.lower() for r in rows}) == 5
    before = {p: p.read_bytes() for p in src.rglob("*") if p.is_file()}
    new = spark.createDataFrame([(r.archive_id, "ok", None, bytearray(dictionary.write_ytd([texture("new", seed=9)]))) for r in archives.where("kind = 'archive' AND type = 'YTD'").collect()], "archive_id string, status string, error string, content binary")
    rows = {r.path.rsplit("src/", 1)[1]: r for r in out.replaced_originals(listed, new, found).collect()}
    assert sorted(rows) == ["c.rpf", "c_exports/inner.rpf/deep.ytd", "one.ytd", "sub/ONE.ytd"] and {r.status for r in rows.values()} == {"written"}
    assert rows["c.rpf"].backup.endswith("c.rpf.bak1") and (src / "c.rpf.bak1").read_bytes() == before[src / "c.rpf"]
    assert [t["name"] for t in dictionary.read_ytd((src / "one.ytd").read_bytes())[1]] == ["new"]
    inside = {e["logical_path"]: e for e in container.walk((src / "c.rpf").read_bytes())}
    assert dictionary.read_ytd(container.payload((src / "c.rpf").read_bytes(), inside["in.ytd"]))[1][0]["name"] == "new"
    assert (src / "w.wtd").read_bytes() == before[src / "w.wtd"]
    # the same bytes again change nothing, other bytes make the next backup, and a bad place is a row
    assert out.put(str(src / "one.ytd"), (src / "one.ytd").read_bytes(), True)["status"] == "same"
    assert out.put(str(src / "c.rpf"), b"other", True)["backup"].endswith("c.rpf.bak2")
    assert out.put(str(src / "one.ytd" / "x"), b"x")["status"] == "failed" and out.written(spark.createDataFrame([("x", None)], "path string, content binary")).first().status == "failed"
    assert not list(src.rglob("*.part-*"))


def test_watched_folder(spark, tmp_path):
    from granary.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ytd").write_bytes(dictionary.write_ytd([texture("a")]))
    q = ingest.textures(spark, str(tmp_path / "in")).select("name", "width").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "b.ytd").write_bytes(dictionary.write_ytd([texture("b")]))
        q.processAllAvailable()
        assert sorted(r.name for r in spark.table("seen").collect()) == ["a", "b"]
    finally:
        q.stop()


def smooth(h: int = 32, w: int = 48) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 5, y * 7, (x + y) * 3, 255 - x * 2], axis=-1).clip(0, 255).astype(np.uint8)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b.astype(float)) ** 2).mean()))


@pytest.mark.parametrize("f", FORMATS, ids=lambda f: f.key)
def test_encode_decode(f):
    image = smooth()
    if f.key == "BC1":
        image[..., 3] = 255
    back = codec.decode(codec.encode(image, f.code), 48, 32, f.code)
    channels = {"BC4": [2], "R8": [2], "BC5": [1, 2], "A8": [3], "B5G6R5": [0, 1, 2], "BC1": [0, 1, 2]}.get(f.key, [0, 1, 2, 3])
    if f.key == "B5G5R5A1":
        channels = [0, 1, 2]
    least = 99 if f.key in ("A8R8G8B8", "R8G8B8A8", "A8", "R8") else 26
    assert psnr(back[..., channels], image[..., channels]) > least


def test_blocks_by_hand():
    red, blue = 31 << 11, 31
    block = struct.pack("<HHI", red, blue, 0b11100100)
    px = codec.decode(block, 4, 4, 0)
    assert px[0].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255], [85, 0, 170, 255], [170, 0, 85, 255]]
    px = codec.decode(struct.pack("<HHI", blue, red, 0b11100100), 4, 4, 0)
    assert px[0, 3].tolist() == [0, 0, 0, 0]
    assert codec.decode(bytes([255, 0, 0b010001000 & 255, 0, 0, 0, 0, 0]), 4, 4, 2)[0, 0, 0] == 255
    assert codec.decode(bytes(16), 4, 4, 4)[0, 0].tolist() == [0, 0, 0, 255]
    assert codec.decode(struct.pack("<H", 0xFFFF), 1, 1, 11)[0, 0].tolist() == [255] * 4


def test_levels_and_resampling():
    image = smooth(20, 12)
    data, n = codec.with_levels(image, 5, 13)
    assert n == 5 and len(data) == total_bytes(12, 20, 5, 5)
    assert codec.decode(data, 12, 20, 5, 4).shape == (1, 1, 4)
    flat = np.full((16, 16, 4), 77, np.uint8)
    flat[..., 3] = 255
    assert np.abs(codec.resized(flat, 5, 3).astype(int) - flat[0, 0]).max() <= 1
    with pytest.raises(ValueError):
        codec.decode(b"", 4, 4, 0)


def test_alpha_and_plans(spark):
    image = smooth(8, 8)
    opaque = image.copy()
    opaque[..., 3] = 255
    rows = [("a", i, 8, 8, f, bytearray(codec.encode(px, f)), 4, 4, 0, 3) for i, (f, px) in enumerate([(1, image), (1, opaque), (0, image), (5, opaque)])]
    rows.append(("a", 9, 8, 8, 1, None, 4, 4, 0, 3))
    df = spark.createDataFrame(rows, "archive_id string, ordinal int, width int, height int, format int, data binary, new_width int, new_height int, new_format int, new_mips int")
    used = {r.ordinal: r.alpha_used for r in pixels.with_alpha_used(df).collect()}
    assert used == {0: True, 1: False, 2: False, 3: False, 9: True}
    out = {r.ordinal: r for r in pixels.applied(df).collect()}
    assert [out[i].status for i in (0, 1, 2, 3, 9)] == ["ok"] * 4 + ["failed"]
    assert out[0].mip_count == 3 and out[0].data_size == 24
    seen = pixels.previews(df.withColumn("mip_count", F.lit(1)), 4).collect()
    assert sum(r.bgra is not None for r in seen) == 4


def test_bc7_modes():
    from granary.pixels import bc7

    rng = np.random.default_rng(0)
    shapes = bc7.Partitions(rng.integers(0, 2, (64, 16)), rng.integers(0, 3, (64, 16)), np.full((64, 1), 15), np.tile([3, 15], (64, 1)))
    for mode in range(8):
        raw = bytearray(rng.integers(0, 256, 16, np.uint8).tobytes())
        raw[0] = raw[0] >> mode + 1 << mode + 1 & 255 | 1 << mode
        px = bc7.decode_block(bytes(raw), shapes)
        assert px.shape == (16, 4) and px.min() >= 0 and px.max() <= 255
        alone = bc7.decode_block(bytes(raw))
        assert (alone == px).all() if mode in (4, 5, 6) else (alone == [0, 0, 0, 255]).all()
    # a mode 6 block of one colour: both ends 127 << 1 | 1, indices 0
    block = 1 << 6 | sum(127 << 7 + 7 * k for k in range(8)) | 3 << 63
    assert (bc7.decode_block(block.to_bytes(16, "little")) == 255).all()


@pytest.mark.parametrize("mode", (0, 1, 2, 3, 7))
def test_bc7_of_several_subsets_is_left_alone(mode):
    """Without partition tables such textures fail, and count as using alpha; no pixels are made up."""
    from granary.pixels import codec

    raw = (1 << mode | 0x5A << 40).to_bytes(16, "little")
    with pytest.raises(ValueError, match="several subsets"):
        codec.decode(raw, 4, 4, codec.BC7)
    assert codec.alpha_in_use(raw, 4, 4, codec.BC7)
    for other in (1 << 6, 1 << 4, 1 << 5, 0):
        assert codec.decode(other.to_bytes(16, "little"), 4, 4, codec.BC7).shape == (4, 4, 4)


def test_blocks_of_a_mode_at_once():
    from granary.pixels import bc7

    rng = np.random.default_rng(6)
    held = bc7.Partitions(rng.integers(0, 2, (64, 16)), rng.integers(0, 3, (64, 16)), rng.integers(1, 16, (64, 1)), np.stack([rng.permutation(np.arange(1, 16))[:2] for _ in range(64)]))
    blocks = rng.integers(0, 256, (900, 16), np.uint8)
    for i, mode in enumerate(np.arange(900) % 9):
        blocks[i, 0] = blocks[i, 0] >> mode + 1 << mode + 1 & 255 | 1 << mode if mode < 8 else 0
    assert (bc7.decode_blocks(blocks, held) == np.stack([bc7.decode_block(b.tobytes(), held) for b in blocks])).all()


def test_partitions_reach_all_that_decodes(spark, tmp_path):
    import json

    from granary.pixels import bc7

    rng = np.random.default_rng(4)
    shapes = {"two": rng.integers(0, 2, (64, 16)).tolist(), "three": rng.integers(0, 3, (64, 16)).tolist(), "anchors_two": [[15]] * 64, "anchors_three": [[3, 15]] * 64}
    (tmp_path / "shapes.json").write_text(json.dumps(shapes))
    held = bc7.Partitions.read(str(tmp_path / "shapes.json"))
    blocks = []
    for mode in range(8):
        raw = bytearray(rng.integers(0, 256, 16, np.uint8).tobytes())
        raw[0] = raw[0] >> mode + 1 << mode + 1 & 255 | 1 << mode
        blocks.append(bytes(raw))
    rows = [("a", i, 4, 4, codec.BC7, bytearray(b), 1, 4, 4, 5, 1) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "archive_id string, ordinal int, width int, height int, format int, data binary, mip_count int, new_width int, new_height int, new_format int, new_mips int")
    out = {r.ordinal: r for r in pixels.applied(df, held).collect()}
    for i, b in enumerate(blocks):
        want = bc7.decode_block(b, held).reshape(4, 4, 4)[..., [2, 1, 0, 3]]
        assert out[i].status == "ok" and bytes(out[i].data) == want.astype(np.uint8).tobytes()
    assert {r.ordinal: r.status for r in pixels.applied(df).collect()} == {i: "ok" if i in (4, 5, 6) else "failed" for i in range(8)}
    assert pixels.previews(df, 4, held).where("bgra IS NULL").count() == 0 and pixels.previews(df, 4).where("bgra IS NULL").count() == 5
    used = {r.ordinal: r.alpha_used for r in pixels.with_alpha_used(df, held).collect()}
    assert used == {i: bool((bc7.decode_block(b, held)[:, 3] < 250).any()) for i, b in enumerate(blocks)}
    with pytest.raises(ValueError):
        bc7.Partitions(np.zeros((1, 16)), np.zeros((64, 16)), np.zeros((64, 1)), np.zeros((64, 2)))
