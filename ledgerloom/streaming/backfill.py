"""Bounded replays beside the running ingestion: the historical import, and rescans.

Both go through the same ``Ingest.write``, so what is there already is not written again, and
neither moves the offset of the running stream: each has a checkpoint of its own. An import that is
stopped goes on where it was; its state is read from the checkpoint and the files it has written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.money import month_window
from ..plans.reports import merged_totals
from ..schema import RAW_MESSAGE
from ..sources.rule_pack import bank_of
from .ingest import COUNTERS, Ingest

STATES = ("idle", "running", "paused", "completed")


def start_import(spark: SparkSession, source: str, ingest: Ingest, checkpoint: str, since: datetime, files_per_trigger: int = 100) -> StreamingQuery:
    """Ingests messages received since a date, in chunks of files; the same checkpoint resumes a stopped import."""
    stream = spark.readStream.schema(RAW_MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    wanted = stream.where(F.col("received_at") >= F.lit(since))
    writer = wanted.writeStream.foreachBatch(ingest.sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def import_state(query: StreamingQuery | None) -> str:
    if query is None:
        return "idle"
    if query.isActive:
        return "running"
    return "paused" if query.exception() is not None or query.status["isDataAvailable"] else "completed"


def rescan_window(now: Column, import_from: Column) -> Column:
    """Where a rescan begins: the date of the import or the start of the month, whichever is earlier."""
    return F.least(import_from, month_window(now)["start"])


def rescan(messages: DataFrame, ingest: Ingest, since: datetime, bank: str | None = None) -> str:
    """Replays messages received since a date, of one bank or of all, and returns the name of the run."""
    rows, run = messages.where(F.col("received_at") >= F.lit(since)), f"rescan-{uuid.uuid4().hex}"
    if bank is not None:
        rows = rows.where(bank_of(ingest.pack, F.col("address")) == bank)
    ingest.write(rows, 0, run)
    return run


def watch(spark: SparkSession, ingest: Ingest, report: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """A live query: whenever batches are committed, the report over all that was ingested is emitted anew."""

    def again(_: DataFrame, batch_id: int) -> None:
        emit(report(ingest.ingested(spark)), batch_id)

    writer = spark.readStream.schema(f"{COUNTERS}, run string, batch bigint").parquet(f"{ingest.folder}/counters").writeStream.foreachBatch(again).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if continuous else writer.trigger(availableNow=True)).start()


def watch_months(spark: SparkSession, ingest: Ingest, emit: Callable[[DataFrame, int], None], checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Live totals: whenever batches are committed, the totals of the months that they changed are emitted.

    They are added up from what each batch has brought; neither messages nor transactions are read again.
    """

    def changed(commits: DataFrame, batch_id: int) -> None:
        parts = ingest.totals(spark)
        months = parts.join(commits.select("run", "batch").distinct(), ["run", "batch"], "left_semi").select("month").distinct()
        emit(merged_totals(parts.join(months, "month", "left_semi")), batch_id)

    writer = spark.readStream.schema(f"{COUNTERS}, run string, batch bigint").parquet(f"{ingest.folder}/counters").writeStream.foreachBatch(changed).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if continuous else writer.trigger(availableNow=True)).start()
