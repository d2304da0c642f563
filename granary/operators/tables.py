"""Tables that are written once, so that what was made of them stays as it was."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir, which a cluster must name; a local session gets a temporary
    one. Ranges, partition numbers and orders don't change in later uses, whatever executors are lost."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="granary-"))
    return df.checkpoint(eager=True)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, within each key (in all without keys) in a total order. Rows are sorted into ranges
    of key and order, so that a large key is in many tasks; the rows before a range come from one count a range."""
    at = settled(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33).alias("__part")
    pieces = at.groupBy(*keys, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first") + 1
    offsets = pieces.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), F.col("__part").alias("__piece"), offset.alias("__offset"))
    # keys may be null, and every row has its piece
    on = F.shiftrightunsigned("__at", 33) == F.col("__piece")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return at.join(offsets, on).select(*rows.columns, (F.col("__at") + F.col("__offset")).cast("int").alias(name))
