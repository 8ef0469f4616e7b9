"""Checkpoints in the folder that all executors share, row numbers without a one-task sort, and names that no column has."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: rows go to the shared checkpoint folder and outlive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``cut`` after dealing the rows anew: a join on the key that a table was grouped by can then be split at a hot key."""
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Adds ``name``, the place of each row in the order, from 1.

    A range-partitioned sort gives the order; what is summed up over all is one count a partition.
    """
    at, part, before = unused(df, "__at", "__part", "__before")
    ordered = cut(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    counts = ordered.groupBy(part).agg(F.count("*").alias(before))
    earlier = F.sum(before).over(Window.partitionBy().orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    placed = ordered.join(F.broadcast(offsets), part)
    return placed.select(*df.columns, (F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
