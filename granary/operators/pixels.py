"""Pixel work over texture rows: one Arrow map over payloads, planned by metadata before.

partitions: tables for BC7 blocks of several subsets (pixels.bc7); without them such textures come out as failed, without
preview, and count as using alpha.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.pixels.bc7 import Partitions

#: Payload rows of one batch: they may be megabytes each.
BATCH = 8


def with_alpha_used(textures: DataFrame, partitions: Partitions | None = None) -> DataFrame:
    """textures (archive_id, ordinal, width, height, format, data) with alpha_used; formats without alpha are settled
    before any payload reaches Python."""
    from granary.functions import texture as T
    from granary.pixels.codec import alpha_in_use

    ids = ["archive_id", "ordinal"]
    schema = pa.schema([("archive_id", pa.string()), ("ordinal", pa.int32()), ("alpha_used", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"archive_id": r["archive_id"], "ordinal": r["ordinal"], "alpha_used": alpha_in_use(r["data"], r["width"], r["height"], r["format"], partitions)} for r in rows], schema=schema)

    looked = textures.where(T.may_have_alpha(F.col("format"))).select(*ids, "width", "height", "format", "data").mapInArrow(run, "archive_id string, ordinal int, alpha_used boolean")
    return textures.join(looked, ids, "left").withColumn("alpha_used", F.coalesce("alpha_used", F.lit(False)))


def applied(plan: DataFrame, partitions: Partitions | None = None) -> DataFrame:
    """A plan's rows (archive_id, ordinal, width, height, format, data, new_width, new_height, new_format, new_mips)
    carried out: archive_id, ordinal, status, error, width, height, format, mip_count, data_size, data."""
    from granary.pixels import codec

    ddl = "archive_id string, ordinal int, status string, error string, width int, height int, format int, mip_count int, data_size long, data binary"
    schema = pa.schema([("archive_id", pa.string()), ("ordinal", pa.int32()), ("status", pa.string()), ("error", pa.string()), *((n, pa.int32()) for n in ("width", "height", "format", "mip_count")), ("data_size", pa.int64()), ("data", pa.binary())])

    def one(r: dict) -> dict:
        out = {"archive_id": r["archive_id"], "ordinal": r["ordinal"]}
        try:
            image = codec.resized(codec.decode(r["data"], r["width"], r["height"], r["format"], 0, partitions), r["new_width"], r["new_height"])
            data, n = codec.with_levels(image, r["new_format"], r["new_mips"])
        except Exception as e:  # the texture stays as it was, with the reason
            return out | {"status": "failed", "error": str(e)[:500]}
        return out | {"status": "ok", "width": r["new_width"], "height": r["new_height"], "format": r["new_format"], "mip_count": n, "data_size": len(data), "data": data}

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(k, BATCH).to_pylist()], schema=schema)

    return plan.select("archive_id", "ordinal", "width", "height", "format", "data", "new_width", "new_height", "new_format", "new_mips").mapInArrow(run, ddl)


def previews(textures: DataFrame, target: int = 256, partitions: Partitions | None = None) -> DataFrame:
    """archive_id, ordinal, level, width, height, bgra: the least level that covers target pixels, decoded."""
    from granary.functions import texture as T
    from granary.pixels import codec

    rows = textures.withColumn("level", T.preview_level(F.col("width"), F.col("height"), F.col("mip_count"), target).cast("int"))
    schema = pa.schema([("archive_id", pa.string()), ("ordinal", pa.int32()), ("level", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("bgra", pa.binary())])

    def one(r: dict) -> dict:
        out = {"archive_id": r["archive_id"], "ordinal": r["ordinal"], "level": r["level"]}
        try:
            image = codec.decode(r["data"], r["width"], r["height"], r["format"], r["level"], partitions)
        except (ValueError, KeyError, TypeError):
            return out
        return out | {"width": image.shape[1], "height": image.shape[0], "bgra": image.tobytes()}

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(k, BATCH).to_pylist()], schema=schema)

    return rows.select("archive_id", "ordinal", "width", "height", "format", "level", "data").mapInArrow(run, "archive_id string, ordinal int, level int, width int, height int, bgra binary")
