"""Ingestion of messages with Structured Streaming.

The checkpoint keeps the offset. Each micro-batch is sanitised, normalised, parsed, freed of what is
already there, given its bank and instrument, compared with earlier transactions, categorised and appended. A
message and its transaction are one row of one table. A batch has a folder of its own in each table,
named by the query and the batch; its counters are written last and commit it. Readers see the folders
of committed batches only, so a batch is there as a whole or not at all, and a query that is started
again with its checkpoint overwrites what it had begun, leaves what it had committed, and touches no
other query's batch. Content hashes and provider ids are checked against all earlier batches, so a
replay writes nothing twice. A folder has one writer at a time.

A row on which something fails holds up no other: it goes to a folder of its own with the kind of error
and can be tried again. There are no event-time windows: late messages are always accepted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import money
from ..functions.hashing import content_hmac
from ..functions.sanitize import sanitize
from ..functions.text import normalize_message
from ..operators import entities
from ..operators.categorise import categorise
from ..operators.classify import classified
from ..operators.duplicates import batch_decisions, exact_new, flag_pairs
from ..operators.lineage import cut, small
from ..operators.mutations import flag_duplicates
from ..plans import reports
from ..schema import RAW_MESSAGE, TRANSACTION, with_defaults
from ..sources.messages import high_water_mark, read_since
from ..sources.rule_pack import RulePack, bank_of, parse_messages, partial_json, profiles, redactions

#: What becomes of a message; every examined one has exactly one of these.
OUTCOMES = ("transaction", "flagged", "duplicate", "review", "ignored", "not_financial", "failed")
MESSAGE = "sms_provider_id bigint, address string, received_at timestamp, sanitized_body string, content_hmac string, bank_id string, classification string, dismissed_as_not_transaction boolean, pan_redacted boolean, unparsed_reason string, rule_id string, partial_extraction string"
ROW = f"{MESSAGE}, transaction struct<{TRANSACTION.simpleString().removeprefix('struct<')}"
COUNTERS = "outcome string, n bigint, last_id bigint"
#: The run of bounded sweeps; they share one cursor.
SWEEP = "sweep"
#: Names of committed batches (about 60 bytes each) are broadcast up to this number.
MAX_BROADCAST_BATCHES = 100_000
DEAD = "provider_id bigint, address string, body string, received_at timestamp, error string"


def _transaction() -> Column:
    """The transaction of a parsed message: its own time, else that of its receipt; amounts of fees and others beside it."""
    p = lambda k: F.col(f"parsed.{k}")
    at = F.coalesce(p("occurredAt"), F.col("received_at"))
    rate = F.expr("try_cast(parsed.exchangeRate AS decimal(18,8))")
    made = {
        "id": F.col("provider_id"), "amount": p("amount"), "currency": p("currency"), "direction": p("direction"), "type": p("message_type"), "affects_spend": F.coalesce(p("affects_spend"), F.lit(True)),
        "is_deleted": F.lit(False), "occurred_at": at, "time_source": F.when(p("occurredAt").isNull(), "received").otherwise("message"),
        "converted_amount": p("convertedAmount"), "converted_currency": p("convertedCurrency"), "fee_amount": p("fee"), "fee_currency": p("feeCurrency"), "balance_amount": p("remainingBalance"), "balance_currency": p("balanceCurrency"),
        "fx_rate": rate, "reference": p("referenceNumber"), "masked_ref": p("instrumentRef"), "merchant_text": p("merchant"), "counterparty_name": p("counterpartyName"), "counterparty_bank": p("counterpartyBankName"),
        "needs_review": F.lit(False), "provenance": F.lit("sms"), "source_message_id": F.col("content_hmac"),
    }
    return F.struct(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTION))


def _exchange(rows: DataFrame, base: str) -> DataFrame:
    """Rate, its source and date, and whether a conversion is still to come. Only a time that the message states dates a rate."""
    fx = money.fx_recording(base)
    dated = F.when(F.col("time_source") == "message", fx["rate_date"])
    return rows.withColumns({"fx_rate": fx["rate"], "fx_rate_source": fx["source"], "fx_rate_date": dated, "conversion_pending": fx["pending"]})


@dataclass(frozen=True)
class Ingest:
    """Where the tables are, the pack and the key of the content hash.

    ``redact``: patterns for all messages, beside those of the pack. ``candidates``: the known merchants
    (see ``matching.merchant_candidates``); without it transactions get no category. ``base``: the currency
    that amounts of others are to be converted to.
    """

    folder: str
    pack: RulePack
    hmac_key: bytes
    redact: tuple[str, ...] = field(default=())
    candidates: Callable[[SparkSession], DataFrame] | None = None
    base: str = "SAR"

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, run string, batch bigint").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{schema}, run string, batch bigint")

    def commits(self, spark: SparkSession) -> DataFrame:
        """(run, batch) of the batches that were written to their end."""
        return self._read(spark, "counters", COUNTERS).select("run", "batch").distinct()

    def _committed(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return self._read(spark, name, schema).join(small(self.commits(spark), MAX_BROADCAST_BATCHES), ["run", "batch"], "left_semi")

    def ingested(self, spark: SparkSession) -> DataFrame:
        """Messages, each with its transaction if it has one, and the run and batch that brought it."""
        return self._committed(spark, "ingested", ROW)

    def messages(self, spark: SparkSession) -> DataFrame:
        return self.ingested(spark).drop("transaction", "run", "batch")

    def transactions(self, spark: SparkSession) -> DataFrame:
        """The transactions; of a pair of possible duplicates both are flagged."""
        rows = self.ingested(spark).where("transaction IS NOT NULL").select("transaction.*")
        pairs = flag_pairs(rows.where("duplicate_of IS NOT NULL").select("id", "duplicate_of")).withColumnRenamed("duplicate_of", "other_id")
        return flag_duplicates(rows, pairs.join(rows.select("id", F.col("duplicate_of").alias("own")), "id").where("own IS NULL").drop("own"))

    def bank_log(self, spark: SparkSession) -> DataFrame:
        return self._committed(spark, "banks", entities.BANK_LOG).drop("run", "batch")

    def instrument_log(self, spark: SparkSession) -> DataFrame:
        return self._committed(spark, "instruments", entities.INSTRUMENT_LOG).drop("run", "batch")

    def totals(self, spark: SparkSession) -> DataFrame:
        """Sums by month, measure and currency of what each batch brought (see ``reports.TOTALS``), with run and batch.

        Legs of a transfer count as what they are until their state is set; pairing sees the whole ledger.
        """
        return self._committed(spark, "totals", reports.TOTALS)

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return self._committed(spark, "dead_letter", DEAD)

    def counters(self, spark: SparkSession) -> DataFrame:
        """(outcome, n) over all batches; the numbers add up to the messages examined."""
        return self._read(spark, "counters", COUNTERS).where("n > 0").groupBy("outcome").agg(F.sum("n").alias("n"))

    def cleaned(self, batch: DataFrame) -> DataFrame:
        """A batch through sanitising and normalising, with its banks; the hash covers the normalised, sanitised text."""
        clean = batch.withColumn("__s", sanitize(F.col("body"), self.redact, bank_of(self.pack, F.col("address")), redactions(self.pack)))
        rows = clean.select("provider_id", "address", "received_at", normalize_message(F.col("__s.text")).alias("body"), F.col("__s.pan_redacted").alias("pan_redacted"), F.col("__s.error").alias("error"))
        return rows.withColumn("content_hmac", content_hmac(self.hmac_key, F.col("body"), F.col("address"))).withColumn("bank_id", bank_of(self.pack, F.col("address")))

    def parsed(self, rows: DataFrame) -> DataFrame:
        """Cleaned rows with what the pack reads in them. An amount that is missing or negative is no transaction: the message goes to the review queue."""
        parsed = parse_messages(rows, self.pack)
        bad = (F.col("parsed.outcome") == "parsed") & ~F.coalesce(F.col("parsed.amount") >= 0, F.lit(False))
        p = F.col("parsed").withField("outcome", F.lit("unparsed")).withField("reason", F.lit("required_field_missing"))
        return parsed.withColumn("parsed", F.when(bad, p.withField("amount", F.lit(None).cast("decimal(20,4)"))).otherwise(F.col("parsed")))

    def outcomes(self, batch: DataFrame) -> DataFrame:
        """A batch through sanitising, normalising and parsing, in this order."""
        return self.parsed(self.cleaned(batch))

    def entities(self, parsed: DataFrame, bank_log: DataFrame, instrument_log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows for the log of banks, rows for that of instruments, (seen, instrument_id) of the transactions)."""
        new_banks = cut(entities.add_banks(bank_log, parsed, profiles(parsed.sparkSession, self.pack)))
        named = cut(entities.mentions(parsed))
        table = entities.banks(bank_log.unionByName(new_banks))
        new_instruments = cut(entities.add_instruments(instrument_log, named, table))
        after = instrument_log.unionByName(new_instruments).where("ref_key IS NOT NULL")
        return new_banks, new_instruments, entities.instrument_ids(named, after.join(small(named.select("ref_key").distinct(), entities.MAX_BROADCAST_KEYS), "ref_key", "left_semi"))

    def process(self, batch: DataFrame, earlier: DataFrame, bank_log: DataFrame | None = None, instrument_log: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a batch comes to: messages, and what it adds to the logs of banks and instruments.

        Messages have one row each: (provider_id, outcome, error, the columns of a message, transaction).
        ``earlier`` has what was ingested before. Messages of other senders are neither compared nor kept, and
        only messages that are new are parsed: a duplicate has no classification.
        """
        spark = batch.sparkSession
        bank_log = spark.createDataFrame([], entities.BANK_LOG) if bank_log is None else bank_log
        instrument_log = spark.createDataFrame([], entities.INSTRUMENT_LOG) if instrument_log is None else instrument_log
        rows = cut(self.cleaned(batch).withColumn("sms_provider_id", F.col("provider_id")).withColumn("error", F.when(F.col("provider_id").isNull(), "no_provider_id").otherwise(F.col("error"))).withColumn("__row", F.monotonically_increasing_id()))
        relevant = rows.where("error IS NULL AND bank_id IS NOT NULL")
        kept = exact_new(relevant.select("__row", "provider_id", "content_hmac", "sms_provider_id"), earlier.select("content_hmac", "sms_provider_id"))
        fresh = cut(self.parsed(relevant.join(kept.select("__row"), "__row", "left_semi")))
        parsed = fresh.where("parsed.outcome = 'parsed'")
        new_banks, new_instruments, ids = self.entities(parsed, bank_log, instrument_log)
        made = _exchange(parsed.select("__row", _transaction().alias("t")).select("__row", "t.*"), self.base)
        new = cut(with_defaults(made.drop("instrument_id").join(ids.withColumnRenamed("seen", "id"), "id", "left")))
        before = earlier.where("transaction IS NOT NULL").select("transaction.*")
        decided = batch_decisions(new.drop("__row"), before)
        transactions = flag_duplicates(new.drop("__row"), decided.select("id", F.col("duplicate_of").alias("other_id")))
        if self.candidates is not None:
            transactions = categorise(transactions, self.candidates(spark))
        held = transactions.select(F.col("id").alias("provider_id"), F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSACTION)).alias("transaction"))
        made = new.select("__row", F.col("id").alias("provider_id")).join(held, "provider_id").select("__row", "transaction")
        joined = rows.join(fresh.select("__row", "parsed", F.lit(True).alias("__new")), "__row", "left").join(made, "__row", "left")
        kind = F.when(F.col("bank_id").isNull(), "not_financial").otherwise(F.col("parsed.outcome"))
        outcome = (
            F.when(F.col("error").isNotNull(), "failed")
            .when(kind == "not_financial", "not_financial")
            .when(F.col("__new").isNull(), "duplicate")
            .when(kind == "ignored", "ignored")
            .when(kind == "unparsed", "review")
            .when(F.col("transaction.duplicate_of").isNotNull(), "flagged")
            .otherwise("transaction")
        )
        messages = joined.select(
            "provider_id", outcome.alias("outcome"), "error", "sms_provider_id", "address", "received_at", F.when(kind.isin("parsed", "unparsed"), F.col("body")).alias("sanitized_body"), "content_hmac", "bank_id",
            F.when(kind.isin("parsed", "unparsed"), F.concat(F.lit("financial_"), kind)).otherwise(kind).alias("classification"), F.lit(False).alias("dismissed_as_not_transaction"), "pan_redacted", F.col("parsed.reason").alias("unparsed_reason"), F.col("parsed.rule_id").alias("rule_id"), partial_json().alias("partial_extraction"), "transaction",
        )
        return messages, new_banks, new_instruments

    def write(self, batch: DataFrame, batch_id: int, run: str) -> None:
        """Ingests a batch into the folders of (run, batch_id), over what an earlier try has left there.

        The counters come last and commit it; a batch that was committed is left as it is.
        """
        spark = batch.sparkSession
        if not self.commits(spark).where((F.col("run") == run) & (F.col("batch") == batch_id)).isEmpty():
            return
        into = f"run={run}/batch={batch_id}"
        messages, new_banks, new_instruments = self.process(batch, self.ingested(spark), self.bank_log(spark), self.instrument_log(spark))
        done = cut(messages)
        new = done.where("outcome NOT IN ('failed', 'not_financial', 'duplicate')")
        new.select(*(f.split(" ")[0] for f in MESSAGE.split(", ")), "transaction").write.mode("overwrite").parquet(f"{self.folder}/ingested/{into}")
        bad = done.where("outcome = 'failed'").select("provider_id", "error").distinct()
        dead = batch.join(bad.withColumnRenamed("provider_id", "__id"), F.expr("provider_id <=> __id")).drop("__id")
        dead.select("provider_id", "address", "body", "received_at", "error").write.mode("overwrite").parquet(f"{self.folder}/dead_letter/{into}")
        new_banks.write.mode("overwrite").parquet(f"{self.folder}/banks/{into}")
        new_instruments.write.mode("overwrite").parquet(f"{self.folder}/instruments/{into}")
        brought = new.where("transaction IS NOT NULL").select("transaction.*")
        reports.partial_totals(classified(brought), self.base).write.mode("overwrite").parquet(f"{self.folder}/totals/{into}")
        newest = done.agg(F.max("provider_id").alias("last_id"))  # one row
        done.groupBy("outcome").agg(F.count("*").alias("n")).join(F.broadcast(newest)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counters/{into}")

    def cursor(self, spark: SparkSession) -> tuple[int | None, int]:
        """(the last provider id that sweeps have passed, the number of the next batch)."""
        row = self._read(spark, "counters", COUNTERS).where(F.col("run") == SWEEP).agg(F.max("last_id").alias("id"), F.max("batch").alias("batch")).first()
        return row["id"], -1 if row["batch"] is None else row["batch"] + 1

    def sweep(self, spark: SparkSession, messages: DataFrame, batch_rows: int = 100, most_batches: int = 10) -> int:
        """Ingests what came after the last sweep, in order of provider ids, in batches of so many rows and at most so many.

        The first sweep only marks the newest message there is and reads none. Where a sweep stands is part of the
        commit of its batches, so one that was stopped goes on after its last whole batch. Returns the messages read.
        """
        last, number = self.cursor(spark)
        if last is None:
            newest = high_water_mark(messages).first()["last_id"] or 0
            row = spark.createDataFrame([("transaction", 0, newest)], COUNTERS)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counters/run={SWEEP}/batch={max(number, 0)}")
            return 0
        read = 0
        for n in range(number, number + most_batches):
            page = cut(read_since(messages, last, batch_rows))
            size, last = page.agg(F.count("*"), F.max("provider_id")).first()
            if not size:
                break
            self.write(page, n, SWEEP)
            read += size
            if size < batch_rows:
                break
        return read

    def retry(self, spark: SparkSession) -> None:
        """Tries the failed messages that have an id once more, for instance with a mended pack."""
        waiting = self.dead_letters(spark).where("provider_id IS NOT NULL").select(*RAW_MESSAGE.names)
        self.write(cut(waiting), 0, f"retry-{uuid.uuid4().hex}")

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: the run is the query's id, which its checkpoint keeps."""
        self.write(batch, batch_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))


def first_cursor(spark: SparkSession, source: str) -> int:
    """Where a first run begins: after the newest message there is, so that it reads none of the old ones."""
    return high_water_mark(spark.read.schema(RAW_MESSAGE).parquet(source)).first()["last_id"] or 0


def start(spark: SparkSession, source: str, ingest: Ingest, checkpoint: str, files_per_trigger: int = 100, continuous: bool = False, after_id: int | None = None) -> StreamingQuery:
    """Reads new files of messages and ingests them; ends when there are no more, unless ``continuous``.

    ``after_id``: only messages after this provider id, see ``first_cursor``.
    """
    stream = spark.readStream.schema(RAW_MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    if after_id is not None:
        stream = stream.where(F.col("provider_id").isNull() | (F.col("provider_id") > after_id))
    writer = stream.writeStream.foreachBatch(ingest.sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="15 minutes") if continuous else writer.trigger(availableNow=True)).start()
