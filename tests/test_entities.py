"""Banks, instruments and exchange at ingest, and the commit of a batch."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classify, entities
from ledgerloom.plans import reports
from ledgerloom.schema import RAW_MESSAGE
from ledgerloom.sources import rule_pack
from ledgerloom.streaming import backfill, ingest

PAID = {
    "ruleId": "paid", "priority": 1, "messageType": "pos_purchase", "intent": "transaction",
    "regex": r"paid (?<sum>[\d.]+) (?<money>[A-Z]{3})(?: = (?<base>[\d.]+) SAR)? by (?<kind>card|account) (?<tail>\d+)(?: (?<net>visa|mada))?(?: (?<sort>debit|credit))?(?: from (?<account>\d+))?(?: rate (?<rate>[\d.]+))?(?: at (?<at>[\d-]{10} [\d:]{5}))?$",
    "extract": {
        "amount": {"group": "sum"}, "currency": {"group": "money"}, "convertedAmount": {"group": "base"}, "convertedCurrency": {"literal": "SAR"}, "instrumentRef": {"group": "tail", "kind": "card", "maskPolicy": "last4"},
        "instrumentRefNetwork": {"group": "net"}, "instrumentRefType": {"group": "sort"}, "settlementRef": {"group": "account", "kind": "account", "maskPolicy": "last4"}, "exchangeRate": {"group": "rate"},
        "occurredAt": {"group": "at", "format": "yyyy-MM-dd HH:mm", "timezone": "UTC"},
    },
    "sign": "debit", "requiredFields": ["amount"],
}
PACK = rule_pack.load_pack(json.dumps({"schemaVersion": 1, "packId": "t", "packVersion": "1", "banks": [
    {"bankId": "heron", "displayName": {"en": "Heron Bank", "ar": "هيرون"}, "aliases": ["HB"], "senderPatterns": ["^HERON$"], "messageRules": [PAID]},
    {"bankId": "egret", "displayName": {"en": "Egret"}, "senderPatterns": ["^EGRET$"], "messageRules": [PAID]},
]}))
AT = datetime(2026, 3, 1)
FEED = [
    (1, "HERON", "paid 1 SAR by card 1111", AT),
    (2, "EGRET", "paid 2 USD by card 1111 visa", AT),
    (3, "HERON", "paid 3 SAR by card 991111 mada from 7042", AT),
    (4, "HERON", "paid 4 USD by card 2222 visa debit from 7077 rate 3.75 at 2026-02-28 10:00", AT),
    (5, "HERON", "paid 5 USD = 18.75 SAR by card 1111 visa from 7088", AT),
    (6, "HERON", "card 3333 blocked", AT),
    (7, "OTHER", "paid 1 SAR by card 1111", AT),
    (8, "HERON", "paid 1 SAR by card 1111", AT),
    (9, "HERON", "paid 9 EUR by card 4444", AT),
]


@pytest.fixture
def job(tmp_path):
    return ingest.Ingest(f"{tmp_path}/out", PACK, b"k")


def write(spark, job, rows, size, run="r"):
    for n, at in enumerate(range(0, len(rows), size)):
        job.write(spark.createDataFrame(rows[at : at + size], RAW_MESSAGE), n, run)


def tables(spark, job):
    known = entities.instruments(job.instrument_log(spark))
    return (
        sorted(map(tuple, entities.banks(job.bank_log(spark)).select("id", "canonical_key", "name_en", "name_ar", "aliases", "first_seen").collect())),
        sorted(map(tuple, known.select("id", "ref_key", "bank_id", "network", "card_type", "currency", "settlement_account_id", "link_source", "first_seen").collect())),
    )


WANTED = (
    [(1, "heron", "Heron Bank", "هيرون", ["HB"], 1), (2, "egret", "Egret", "egret", [], 2)],
    [
        (1, "heron:card:1111", 1, "mada", None, "SAR", 3, "sms_repayment", 1),
        (2, "egret:card:1111", 2, "visa", None, "USD", None, None, 2),
        (3, "heron:account:7042", 1, None, None, None, None, None, 3),
        (4, "heron:card:2222", 1, "visa", "debit", "USD", 5, "sms_repayment", 4),
        (5, "heron:account:7077", 1, None, None, None, None, None, 4),
        (6, "heron:account:7088", 1, None, None, None, None, None, 5),
        (7, "heron:card:4444", 1, None, None, "EUR", None, None, 9),
    ],
)


@pytest.mark.parametrize("size", [3, 9])
def test_same_tables_in_whatever_batches(spark, job, size):
    write(spark, job, FEED, size)
    assert tables(spark, job) == WANTED
    got = {r["id"]: r for r in job.transactions(spark).collect()}
    assert {i: r["instrument_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 9: 7}
    told = {i: (None if r["fx_rate"] is None else float(r["fx_rate"]), r["fx_rate_source"], r["fx_rate_date"], r["conversion_pending"]) for i, r in got.items()}
    assert told == {1: (None, None, None, False), 2: (None, None, None, True), 3: (None, None, None, False), 4: (3.75, "sms_stated", datetime(2026, 2, 28, 10), False), 5: (3.75, "sms_implied", None, False), 9: (None, None, None, True)}


def test_a_batch_is_there_as_a_whole_or_not_at_all(spark, job, monkeypatch):
    write(spark, job, FEED[:3], 3)
    before = tables(spark, job), job.ingested(spark).count(), job.dead_letters(spark).count()
    batch = spark.createDataFrame([*FEED[3:], (None, "HERON", "x", AT)], RAW_MESSAGE)
    writer = type(batch.write)
    plain, written = writer.parquet, []
    for stop in range(1, 7):  # killed after each of the writes but the last

        def parquet(self, path, *args, stop=stop, **options):
            if len(written) == stop:
                raise InterruptedError(path)
            written.append(path)
            plain(self, path, *args, **options)

        written.clear()
        with monkeypatch.context() as m:
            m.setattr(writer, "parquet", parquet)
            if stop < 6:
                with pytest.raises(InterruptedError):
                    job.write(batch, 1, "r")
                assert (tables(spark, job), job.ingested(spark).count(), job.dead_letters(spark).count()) == before
            else:
                job.write(batch, 1, "r")
    assert tables(spark, job) == WANTED
    assert (job.ingested(spark).count(), job.dead_letters(spark).count()) == (7, 1)
    job.write(batch, 1, "r")  # committed: nothing changes
    assert {r["outcome"]: r["n"] for r in job.counters(spark).collect()} == {"transaction": 6, "review": 1, "not_financial": 1, "duplicate": 1, "failed": 1}


def test_what_stands_is_not_replaced(spark, job):
    write(spark, job, [FEED[4]], 1)
    write(spark, job, [(20, "HERON", "paid 7 SAR by card 1111 mada credit from 7042", AT)], 1, "later")
    (card,) = (r for r in entities.instruments(job.instrument_log(spark)).collect() if r["kind"] == "card")
    assert (card["network"], card["card_type"], card["currency"], card["settlement_account_id"]) == ("visa", "credit", "USD", 2)


def test_no_messages(spark, job):
    job.write(spark.createDataFrame([], RAW_MESSAGE), 0, "r")
    assert tables(spark, job) == ([], [])
    assert job.transactions(spark).count() == 0


def test_history_before_the_window_is_not_read(spark, job):
    old = [(1, "HERON", "paid 3 SAR by card 1111 at 2026-01-01 10:00", AT), (2, "HERON", "paid 3 SAR by card 1111 at 2026-02-01 10:00", AT)]
    write(spark, job, old, 1)
    write(spark, job, [(3, "HERON", "paid 3 SAR by card 1111 mada at 2026-02-01 10:10", AT)], 1, "b")
    assert {r["id"]: r["duplicate_of"] for r in job.transactions(spark).collect()} == {1: None, 2: None, 3: None}
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    seen = job.ingested(spark).where("transaction IS NOT NULL").select("transaction.*").where(F.col("occurred_at") >= datetime(2026, 2, 1))
    assert "GreaterThanOrEqual(transaction.occurred_at" in seen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_live_totals_are_those_of_the_reports(spark, job, tmp_path):
    feed = [(i, "HERON", f"paid {i} {'USD' if i % 3 else 'SAR'} by card 1111{' rate 3.75' if i % 2 else ''} at 2026-0{1 + i % 4}-1{i % 10} 10:00", AT) for i in range(1, 25)]
    seen = []
    for n, at in enumerate((0, 12)):
        rows = [r for r in feed[at : at + 12] if n == 0 or r[0] % 4 < 2]  # the second batch has two months only
        job.write(spark.createDataFrame(rows, RAW_MESSAGE), n, "r")
        backfill.watch_months(spark, job, lambda df, _: seen.append(df.collect()), f"{tmp_path}/watch").awaitTermination()
        rows = classify.classified(job.transactions(spark))
        totals = reports.merged_totals(job.totals(spark))
        for month in range(1, 5):
            start, end = (datetime(2026, m, 1) - timedelta(hours=3) for m in (month, month + 1))
            of_month = totals.where(F.col("month") == datetime(2026, month, 1))
            columns = ["measure", "base", "converted_count", "unconverted_count", "is_incomplete"]
            wanted = reports.period_report(rows, start, end, "SAR").where("converted_count + unconverted_count > 0")
            assert sorted(map(tuple, reports.month_reports(of_month).select(columns).collect())) == sorted(map(tuple, wanted.select(columns).collect()))
            wanted = reports.by_currency(rows, start, end, "SAR")
            assert sorted(map(tuple, reports.months_by_currency(of_month).select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert [len({r["month"] for r in rows}) for rows in seen] == [4, 2]


def test_sweeps_are_bounded_by_rows_and_batches(spark, job):
    text = lambda i: (i, "HERON", f"paid {i} SAR by card 1111", AT)
    old = spark.createDataFrame([text(i) for i in range(1, 4)], RAW_MESSAGE)
    assert job.sweep(spark, old) == 0  # a first sweep reads nothing
    assert job.cursor(spark) == (3, 1)
    more = old.unionByName(spark.createDataFrame([text(i) for i in range(10, 33)], RAW_MESSAGE)).repartition(3)
    assert job.sweep(spark, more, batch_rows=10, most_batches=2) == 20
    assert job.cursor(spark) == (29, 3)
    assert sorted(r["batch"] for r in job.commits(spark).collect()) == [0, 1, 2]
    assert job.sweep(spark, more, batch_rows=10, most_batches=2) == 3
    assert job.sweep(spark, more, batch_rows=10, most_batches=2) == 0
    assert sorted(r["id"] for r in job.transactions(spark).collect()) == list(range(10, 33))
    assert {r["outcome"]: r["n"] for r in job.counters(spark).collect()} == {"transaction": 23}
