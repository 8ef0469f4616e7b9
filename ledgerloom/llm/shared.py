"""Helpers that several training-data operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_dir, spread

__all__ = ["cut", "held_out", "lower_ascii", "shared_dir", "shuffle_partitions", "spread", "table"]

#: Share of labelled documents that is kept out of training: crc32(doc_id) mod 4 == 2.
HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> Column:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    return F.coalesce(remainder == HELD_OUT_REMAINDER, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the faster built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
