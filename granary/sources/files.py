"""Asset files as DataFrames: archives, textures and container entries.

Files come through Spark's binaryFile source, so any store that Spark reads will do; names are filtered before a byte
is read.  Spark hides names that start with an underscore, and can't hold files of some size in a row: these are found and
read by the workers' own file systems (local folders, mounted shares and what Arrow opens), large containers by ranges.
Parsing is a map over files: a bad file becomes a row with a status and a reason, never a failed job.
Containers become one archive row of their own and one for each asset inside, tied to it by parent_archive_id.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from granary.functions import paths
from granary.operators.tables import settled
from granary.sources import container, dictionary, stores
from granary.sources.resource import Rejected

META = "struct<" + ",".join(f"{n}:{'double' if n[7:].isdigit() and 7 <= int(n[7:]) <= 12 else 'long'}" for n in dictionary.WTD_META) + ",original_hash:long>"
ARCHIVES = "archive_id string, parent_archive_id string, kind string, type string, name string, file_path string, ext string, source_path string, entry_path string, depth int, version long, sys_flags long, gfx_flags long, status string, error string, textures int"
TEXTURES = f"texture_id string, archive_id string, ordinal int, name string, name_hash long, width int, height int, format int, mip_count int, stride int, data_size long, data_off long, data binary, wtd_meta {META}"
ENTRIES = "source_path string, depth int, idx int, kind string, name string, logical_path string, base_offset long, file_offset long, file_size long, uncompressed_size long, system_flags long, graphics_flags long, encryption long"
#: One file of a task at a time: payloads may be large.
BATCH = 16


#: Files of more bytes have a null content here, and are read by ranges.
LARGEST = 256 << 20


def _glob(enabled: tuple[str, ...]) -> str:
    """Names with one of the extensions, in whatever case, for Spark's listing."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in enabled) + "}"


def _underscored(where: list[str], enabled: tuple[str, ...]) -> list[tuple]:
    """(path, modified, length) of the files that Spark passes over: with an underscore before their own name or a folder's."""
    out = []
    for root in where:
        try:
            found = stores.below(root)
        except Exception as e:  # a store that only Spark opens
            warnings.warn(f"names that start with an underscore are not seen below {root}: {e}", stacklevel=3)
            continue
        base = stores.opened(root)[1].rstrip("/")
        for x in found:
            names = x.path[len(base) :].strip("/").split("/") if x.path != base else [x.path.rsplit("/", 1)[-1]]
            if any(n.startswith("_") for n in names) and not names[-1].startswith(".") and _ext(names[-1]) in enabled:
                scheme = root.split("://")[0] + "://" if "://" in root and not root.startswith("file:") else "file:"
                out.append((scheme + x.path, x.mtime, x.size))
    return out


def listed(spark: SparkSession, where: str | list[str], enabled: tuple[str, ...] = paths.SUPPORTED, largest: int = LARGEST) -> DataFrame:
    """path, modificationTime, length, content of the files below one or several folders whose extension is enabled;
    names that start with a dot are passed over. Files of more than largest bytes have no content here."""
    roots = [where] if isinstance(where, str) else list(where)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(enabled)).load(roots)
    df = df.where(~paths.leaf(F.col("path")).startswith("."))
    small = df.where(F.col("length") <= largest)  # both are pushed down: content is read of small files alone
    large = df.where(F.col("length") > largest).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    out = small.select("path", "modificationTime", "length", "content").unionByName(large)
    hidden = _underscored(roots, enabled)
    if not hidden:
        return out
    more = spark.createDataFrame(hidden, "path string, modificationTime timestamp, length long")
    kind = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([{"path": path, "content": stores.whole(path)}], schema=kind)

    contents = more.where(F.col("length") <= largest).select("path").mapInArrow(read, "path string, content binary")
    return out.unionByName(more.join(contents, "path", "left").select("path", "modificationTime", "length", "content"))


def parse(raw: bytes, ext: str) -> tuple[dict, list[dict]]:
    """(file fields, textures) by the reader for the extension."""
    if ext == ".wtd":
        return dictionary.read_wtd(raw)
    if ext in (".ydr", ".yft", ".ydd"):
        return dictionary.read_model(raw, ext)
    return dictionary.read_ytd(raw)


def _row(path: str, name: str, ext: str, **more) -> dict:
    kind = "group" if ext == ".rpf" else "archive"
    type_ = "RPF" if ext == ".rpf" else "WTD" if ext == ".wtd" else "MODEL" if ext in (".ydr", ".yft", ".ydd") else "YTD"
    return {"archive_id": path, "parent_archive_id": None, "kind": kind, "type": type_, "name": name, "file_path": path, "ext": ext, "source_path": None, "entry_path": None, "depth": 0, "status": "ok", "error": None, "textures": 0} | more


def _loaded(row: dict, raw: bytes) -> tuple[dict, list[dict]]:
    try:
        fields, textures = parse(raw, row["ext"])
    except Exception as e:  # whatever is wrong with a file is told in its row
        return row | {"status": "unavailable" if row["parent_archive_id"] else "rejected", "error": str(e)[:500] or type(e).__name__}, []
    return row | {k: fields.get(k) for k in ("version", "sys_flags", "gfx_flags")} | {"textures": len(textures)}, textures


def _ext(name: str) -> str:
    leaf = name.replace("\\", "/").rsplit("/", 1)[-1]
    return ("." + leaf.rsplit(".", 1)[1]).lower() if "." in leaf else ""


def archives_in(path: str, raw: bytes | None) -> Iterator[tuple[dict, list[dict]]]:
    """The archives that a file holds, with their textures. raw: null for large files."""
    ext, leaf = _ext(path), path.rsplit("/", 1)[-1]
    if raw is None:
        try:
            raw = stores.Ranged(path)
            if ext != ".rpf":
                raise Rejected(f"{len(raw)} bytes are too many for a file that is no container")
        except Exception as e:
            yield _row(path, leaf, ext, status="rejected", error=str(e)[:500]), []
            return
    if ext != ".rpf":
        yield _loaded(_row(path, leaf, ext), raw)
        return
    try:
        inside = [e for e in container.walk(raw) if container.supported(e)]
    except Exception as e:
        yield _row(path, leaf, ext, status="encrypted" if isinstance(e, container.Encrypted) else "rejected", error=str(e)[:500]), []
        return
    yield _row(path, leaf, ext), []
    for e in inside:
        row = _row(f"{path}!/{e['logical_path']}", e["name"], _ext(e["name"]), parent_archive_id=path, file_path=None, source_path=path, entry_path=e["logical_path"], depth=e["depth"] + 1)
        try:
            body = container.payload(raw, e)
        except (Rejected, IndexError) as err:
            yield row | {"status": "unavailable", "error": str(err)[:500]}, []
            continue
        yield _loaded(row, body)


def _schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ST._parse_datatype_string(ddl))


def _mapped(files: DataFrame, ddl: str, rows) -> DataFrame:
    schema = _schema(files.sparkSession, ddl)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found: list[dict] = []
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    found.append(row)
                    if len(found) == BATCH:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def _textures_of(row: dict, textures: list[dict]) -> Iterator[dict]:
    for i, t in enumerate(textures):
        yield {k: t.get(k) for k in ("name", "name_hash", "width", "height", "format", "mip_count", "stride", "data_size", "data_off", "data")} | {"texture_id": f"{row['archive_id']}#{i}", "archive_id": row["archive_id"], "ordinal": i, "wtd_meta": t.get("meta")}


def read_archives(files: DataFrame) -> DataFrame:
    """One row per archive, containers and what they hold included. files: from listed()."""
    return _mapped(files, ARCHIVES, lambda path, raw: (row for row, _ in archives_in(path, raw)))


def read_textures(files: DataFrame) -> DataFrame:
    """One row per texture with its payload. archive_id and ordinal, fixed at load, identify it."""
    return _mapped(files, TEXTURES, lambda path, raw: (t for row, textures in archives_in(path, raw) for t in _textures_of(row, textures)))


def load(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read_archives(), read_textures()) of one parse: files are read and parsed once, and both are parts of one table in
    the shared folder."""

    def rows(path: str, raw: bytes | None):
        for row, textures in archives_in(path, raw):
            yield {"archive": row, "texture": None}
            for t in _textures_of(row, textures):
                yield {"archive": None, "texture": t}

    both = settled(_mapped(files, f"archive struct<{_struct(ARCHIVES)}>, texture struct<{_struct(TEXTURES)}>", rows))
    return both.where("archive IS NOT NULL").select("archive.*"), both.where("texture IS NOT NULL").select("texture.*")


def _struct(ddl: str) -> str:
    """Columns of a DDL string as fields of a struct."""
    return ",".join(c.strip().replace(" ", ":", 1) for c in ddl.split(", "))


def read_entries(files: DataFrame) -> DataFrame:
    """One row per file in plain containers, nested ones included; encrypted or broken containers give no rows here
    and a status in read_archives()."""

    def rows(path: str, raw: bytes):
        try:
            for e in container.walk(stores.Ranged(path) if raw is None else raw):
                yield {"source_path": path, **{k: e.get(k) for k in ("depth", "idx", "kind", "name", "logical_path", "base_offset", "file_offset", "file_size", "uncompressed_size", "system_flags", "graphics_flags", "encryption")}}
        except (Rejected, OSError):
            return

    return _mapped(files.where(paths.extension(F.col("path")) == ".rpf"), ENTRIES, rows)


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("texture_assets").load(path) give the textures of a folder or file that workers can open."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    arrow = _schema(spark, TEXTURES)

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.where = options["path"]

        def partitions(self):
            names = [x.path for x in stores.below(self.where)]
            scheme = self.where.split("://")[0] + "://" if "://" in self.where and not self.where.startswith("file:") else ""
            return [InputPartition(scheme + n) for n in names if _ext(n) in paths.SUPPORTED and not n.rsplit("/", 1)[-1].startswith(".")]

        def read(self, partition):
            raw = stores.Ranged(partition.value)
            for row, textures in archives_in(partition.value, raw.all() if len(raw) <= LARGEST else None):
                for t in _textures_of(row, textures):
                    yield pa.RecordBatch.from_pylist([t], schema=arrow)

    class Textures(DataSource):
        @classmethod
        def name(cls) -> str:
            return "texture_assets"

        def schema(self) -> str:
            return TEXTURES

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Textures)
