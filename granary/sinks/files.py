"""Files written from workers: exports, saved archives, snapshots, originals replaced with backups.

Each file is written under another name and then moved, so that no reader sees half of it.  A task that is run again finds
its own files there, sees that they hold what it is to write, and leaves them and the backups alone.  Failures are rows
with a reason.  All functions write at once and return a report that is fixed: path, status (written, same, failed), error,
backup, size.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import paths
from granary.operators import naming
from granary.operators.tables import settled
from granary.sinks import archives as saving
from granary.sinks import images
from granary.sources import stores

REPORT = "path string, status string, error string, backup string, size long"


def _free(fs, at: str, form: str, first: int) -> str:
    """The first name that isn't taken, with numbers from first."""
    n = first
    while stores.exists(fs, form.format(at, n)):
        n += 1
    return form.format(at, n)


def put(path: str, content: bytes, backup: bool = False) -> dict:
    """Writes one file; with backup, one that is there goes to the first free .bak1, .bak2 and so on before."""
    row = {"path": path, "status": "written", "error": None, "backup": None, "size": len(content)}
    try:
        fs, at = stores.opened(path)
        info = fs.get_file_info(at)
        if info.type == stores.pfs.FileType.File and info.size == len(content) and stores.whole(path) == content:
            return row | {"status": "same"}
        if "/" in at:
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        part = f"{at}.part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(content)
        if backup and info.type == stores.pfs.FileType.File:
            row["backup"] = _free(fs, at, "{}.bak{}", 1)
            fs.copy_file(at, row["backup"])
        fs.move(part, at)
        return row
    except Exception as e:  # whatever is wrong with a file is told in its row
        return row | {"status": "failed", "error": str(e)[:500] or type(e).__name__}


def written(rows: DataFrame) -> DataFrame:
    """Writes rows (path, content, and backup if wanted), each path once; null contents are failures."""
    schema = pa.schema([("path", pa.string()), ("status", pa.string()), ("error", pa.string()), ("backup", pa.string()), ("size", pa.int64())])
    if "backup" not in rows.columns:
        rows = rows.withColumn("backup", F.lit(False))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, backup = (batch.column(k)[i].as_py() for k in range(3))
                done = put(path, content, bool(backup)) if content is not None else {"path": path, "status": "failed", "error": "nothing to write", "backup": None, "size": None}
                yield pa.RecordBatch.from_pylist([done], schema=schema)

    return settled(rows.select("path", "content", "backup").mapInArrow(run, REPORT))


def _under(folder: str, name: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), name)


def export_images(textures: DataFrame, folder: str) -> DataFrame:
    """Every texture with data as a DDS file, in a folder of its archive's name, under names that don't clash."""
    rows = images.export(textures)
    return written(rows.select(_under(folder, F.concat(paths.sanitised(paths.stem(F.col("archive_id"))), F.lit("/"), F.col("file_name"))).alias("path"), F.col("dds").alias("content")))


def natives(archives: DataFrame, textures: DataFrame, files: DataFrame | None = None, edited: DataFrame | None = None) -> DataFrame:
    """archive_id, status, error, content of archives in their own format: dictionaries by type, and models of files
    (path, content) recomposed with edited textures."""
    of = lambda kind: textures.join(archives.where(F.col("type") == kind).select("archive_id"), "archive_id", "left_semi")
    out = saving.save_dictionaries(of("YTD"), "ytd").unionByName(saving.save_dictionaries(of("WTD"), "wtd"))
    return out if files is None or edited is None else out.unionByName(saving.save_models(files, edited))


def saved_all(saved: DataFrame, archives: DataFrame, folder: str) -> DataFrame:
    """Saved archives (archive_id, content) as files of a folder; groups and previews are left out; the second of equal
    names has -2, and so on. archives: (archive_id, kind, is_preview, file_path or entry_path, position)."""
    rows = archives.where((F.col("kind") != "group") & ~F.col("is_preview"))
    where = F.coalesce("entry_path", "file_path", "archive_id")
    names = naming.saved_names(rows.select(F.col("archive_id").alias("archive"), "position", where.alias("path"))).select(F.col("archive").alias("archive_id"), "file_name")
    return written(saved.join(names, "archive_id").select(_under(folder, F.col("file_name")).alias("path"), "content"))


def snapshot(saved: DataFrame, archives: DataFrame, folder: str) -> tuple[str, DataFrame]:
    """saved_all() into a new folder below, originals untouched: (its path, report)."""
    out = f"{folder.rstrip('/')}/project-{uuid.uuid4().hex}"
    return out, saved_all(saved, archives, out)


def replaced_originals(archives: DataFrame, saved: DataFrame, containers: DataFrame) -> DataFrame:
    """Saved archives (archive_id, status, error, content) put where they came from, by their route: files in place; entries
    of containers (path, content) by one rewrite of each container, of which a backup is kept; nested entries as files
    beside their container, in a folder named after it with _exports. archives: as for naming.save_route(), with archive_id
    and file_path."""
    rows = naming.save_route(archives).join(saved.where("status = 'ok'").select("archive_id", "content"), "archive_id")
    in_place = rows.where("route = 'file'").select(F.col("file_path").alias("path"), "content", F.lit(False).alias("backup"))
    beside = F.concat(paths.renamed(F.col("source_path"), "_exports/"), paths.sanitised(paths.slashed(F.col("entry_path"))))
    sidecars = rows.where("route = 'sidecar'").select(beside.alias("path"), "content", F.lit(False).alias("backup"))
    rewritten = saving.rewrite_containers(containers, rows.where("route = 'container'").select("source_path", "entry_path", "content"))
    whole = rewritten.select(F.col("archive_id").alias("path"), "content", F.lit(True).alias("backup"), "error")
    report = written(in_place.unionByName(sidecars).unionByName(whole.where("content IS NOT NULL").drop("error")))
    failed = whole.where("content IS NULL").select("path", F.lit("failed").alias("status"), "error", F.lit(None).cast("string").alias("backup"), F.lit(None).cast("long").alias("size"))
    return report.unionByName(failed)
