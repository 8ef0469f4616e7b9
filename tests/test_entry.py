from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import entry, filters, lineage, mutations

from .test_ledger import frame, tx

AT = datetime(2026, 7, 30, 9)
DRAFT = "draft_id bigint, amount_text string, currency string, occurred_at timestamp, type string, direction string, merchant_text string"


def test_entries_name_what_is_missing(spark):
    rows = [
        (1, " 12.50 ", "sar", AT, "withdrawal", "debit", "  "),
        (2, "", "SAR", AT, "fee", "debit", "A"),
        (3, "-4", "SAR", AT, "fee", "debit", "A"),
        (4, "x", "riyal", None, " ", "sideways", "A"),
        (5, "5", "riyal", AT, "fee", "debit", "A"),
        (6, "0", "SAR", AT, "fee", "credit", " B "),
        (7, None, None, None, None, None, None),
    ]
    drafts = spark.createDataFrame(rows, DRAFT)
    got = {r["draft_id"]: (r["amount_problem"], r["missing"]) for r in entry.check_entries(drafts).collect()}
    assert got == {
        1: (None, []),
        2: ("missing", ["amount"]),
        3: ("negative", ["amount"]),
        4: ("unparsable", ["amount", "currency", "occurred_at", "type", "direction"]),
        5: ("unparsable", ["amount", "currency"]),
        6: (None, []),
        7: ("missing", ["amount", "occurred_at", "type", "direction"]),
    }
    made = [(r["id"], r["draft_id"], str(r["amount"]), r["currency"], r["affects_spend"], r["merchant_text"]) for r in entry.manual_entries(drafts, 100).orderBy("id").collect()]
    assert made == [(101, 1, "12.5000", "SAR", False, None), (102, 6, "0.0000", "SAR", True, "B")]


def test_completion_needs_a_waiting_message(spark):
    messages = spark.createDataFrame([(1, "financial_unparsed", False), (2, "financial_unparsed", True), (3, "financial_parsed", False), (5, "financial_unparsed", False)], "id bigint, classification string, dismissed_as_not_transaction boolean")
    drafts = spark.createDataFrame([(i, "0", "SAR", AT, "fee", "debit", None) for i in (1, 2, 3, 4)] + [(5, "1", "??", AT, "fee", "debit", None)], DRAFT).withColumnRenamed("draft_id", "message_id")
    done = entry.complete_messages(drafts, messages)
    assert {r["message_id"]: (r["status"], r["missing"]) for r in done.collect()} == {1: ("accepted", []), 2: ("unavailable", []), 3: ("unavailable", []), 4: ("unavailable", []), 5: ("rejected", ["currency"])}
    after = {r["id"]: r["classification"] for r in entry.mark_completed(messages, done).collect()}
    assert after == {1: "financial_parsed", 2: "financial_unparsed", 3: "financial_parsed", 5: "financial_unparsed"}


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(9)
    assert [(r["k"], r["n"]) for r in lineage.numbered(rows, "k").orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
    assert lineage.numbered(rows.where("false"), "k").count() == 0


def test_sum_of_money_has_one_currency(spark):
    rows = spark.createDataFrame([("a", "1", "SAR"), ("a", "2", "SAR"), ("b", "1", "SAR"), ("b", "1", "USD"), ("c", None, None)], "k string, x string, cur string").withColumn("x", F.col("x").cast("decimal(20,4)"))
    total = rows.groupBy("k").agg(money.money_sum(F.col("x"), F.col("cur")).alias("s"))
    assert {r["k"]: r["s"] and float(r["s"]) for r in total.where("k <> 'b'").collect()} == {"a": 3.0, "c": None}
    with pytest.raises(PySparkException, match="currency mismatch"):
        rows.where("k = 'b'").groupBy("k").agg(money.money_sum(F.col("x"), F.col("cur")).alias("s")).collect()


def test_duplicate_flags_and_transfer_decisions(spark):
    rows = frame(spark, [tx(1, "10"), tx(2, "10"), tx(3, "10", needs_review=True), tx(4, "10", type="transfer_out", transfer_state="candidate")])
    rows = rows.withColumn("review_reason", F.when(F.col("id") == 3, "low_confidence"))
    flagged = mutations.flag_duplicates(rows, spark.createDataFrame([(1, 9), (1, 2)], "id bigint, other_id bigint"))
    got = {r["id"]: (r["needs_review"], r["review_reason"], r["duplicate_of"]) for r in flagged.collect()}
    assert got[1] == (True, "possible_duplicate", 2)
    back = {r["id"]: (r["needs_review"], r["review_reason"], r["duplicate_of"]) for r in mutations.resolve_duplicates(flagged, rows.select("id")).collect()}
    assert back[1] == (False, None, None)
    assert back[3] == (True, "low_confidence", None)
    said = spark.createDataFrame([(4, "external", "itl:4:5"), (2, "internal", "itl:2:1")], "id bigint, state string, group_id string")
    decided = {r["id"]: (r["transfer_state"], r["transfer_group"]) for r in mutations.decide_transfers(rows, said).collect()}
    assert decided == {1: (None, None), 2: ("internal", "itl:2:1"), 3: (None, None), 4: ("external", None)}


def test_review_cutoff_is_exclusive(spark):
    rows = spark.createDataFrame([(1, AT), (2, datetime(2026, 7, 1))], "id bigint, received_at timestamp").selectExpr("*", "'financial_unparsed' AS classification", "false AS dismissed_as_not_transaction")
    assert [r["id"] for r in filters.review_before(rows, AT).collect()] == [2]
    kept, gone = mutations.discard_review(rows, AT)
    assert ([r["id"] for r in kept.collect()], gone.first()["discarded"]) == ([1], 1)
