"""Reads of the message source: keyset pages, bounded ranges, high-water mark, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_since(messages: DataFrame, cursor: int, limit: int, id_column: str = "provider_id") -> DataFrame:
    """The next page after the cursor, in order of id."""
    return messages.where(F.col(id_column) > cursor).orderBy(id_column).limit(limit)


def read_range(messages: DataFrame, since, cursor: int, limit: int, id_column: str = "provider_id", time_column: str = "received_at") -> DataFrame:
    return messages.where((F.col(time_column) >= F.lit(since)) & (F.col(id_column) > cursor)).orderBy(id_column).limit(limit)


def high_water_mark(messages: DataFrame, id_column: str = "provider_id", time_column: str = "received_at") -> DataFrame:
    """(last_id, last_date) of the newest message; both null for an empty source."""
    return messages.agg(F.max(id_column).alias("last_id"), F.max_by(time_column, id_column).alias("last_date"))


def count_range(messages: DataFrame, since, time_column: str = "received_at") -> DataFrame:
    return messages.where(F.col(time_column) >= F.lit(since)).agg(F.count("*").alias("n"))
