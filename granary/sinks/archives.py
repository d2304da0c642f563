"""Archives in their own formats: dictionaries, models and containers, as bytes that the sink of files writes.

An archive holds 4096 textures at most, so bringing one together in a task is bounded; containers are rewritten one
to a task, from their own bytes and the replacements for them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.sources import container, dictionary

SAVED = "archive_id string, status string, error string, content binary"
SAVED_ARROW = pa.schema([("archive_id", pa.string()), ("status", pa.string()), ("error", pa.string()), ("content", pa.binary())])


def _saved(archive_id: str, make) -> pa.Table:
    try:
        row = {"archive_id": archive_id, "status": "ok", "error": None, "content": make()}
    except Exception as e:  # a failed archive is a row with the reason
        row = {"archive_id": archive_id, "status": "failed", "error": str(e)[:500], "content": None}
    return pa.Table.from_pylist([row], schema=SAVED_ARROW)


def _texture(r: dict) -> dict:
    return r | {"meta": r.get("wtd_meta") or {}}


def save_dictionaries(textures: DataFrame, kind: str = "ytd") -> DataFrame:
    """archive_id, status, error, content: each archive's textures (as from read_textures()) as a YTD or WTD file."""

    def make(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ordinal"])
        if kind == "wtd":
            return _saved(rows[0]["archive_id"], lambda: dictionary.write_wtd({}, [_texture(r) for r in rows]))
        return _saved(rows[0]["archive_id"], lambda: dictionary.write_ytd(rows))

    return textures.groupBy("archive_id").applyInArrow(make, SAVED)


def save_models(files: DataFrame, edited: DataFrame) -> DataFrame:
    """Models (path, content) recomposed with edited textures (archive_id, ordinal, width, height, format, mip_count,
    data): archive_id, status, error, content. Models without edits don't come out."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SAVED_ARROW.empty_table()
        path, raw = left.column("path")[0].as_py(), left.column("content")[0].as_py()
        ext = "." + path.rsplit(".", 1)[-1].lower()
        return _saved(path, lambda: dictionary.recompose_model(raw, ext, {r["ordinal"]: r for r in right.to_pylist()}))

    return files.select("path", "content").groupBy("path").cogroup(edited.withColumnRenamed("archive_id", "path").groupBy("path")).applyInArrow(make, SAVED)


def rewrite_containers(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """Containers (path, content) with entries replaced (source_path, entry_path, content), one rewrite each:
    archive_id, status, error, content."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SAVED_ARROW.empty_table()
        new = {r["entry_path"]: r["content"] for r in right.select(["entry_path", "content"]).to_pylist()}
        return _saved(left.column("path")[0].as_py(), lambda: container.rewritten(left.column("content")[0].as_py(), new)[0])

    wanted = replacements.withColumnRenamed("source_path", "path").select("path", "entry_path", "content")
    return files.select("path", "content").groupBy("path").cogroup(wanted.groupBy("path")).applyInArrow(make, SAVED)
