"""Transactions that the user enters, and messages that could not be read and the user completes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import amount_problem, currency_code, parse_amount
from ..functions.text import trim
from .filters import PENDING_REVIEW
from .lineage import numbered

# Types that are no spend by what they are; a transfer's pair decides, so transfer_out is not here.
NON_SPEND_TYPES = ("card_repayment", "transfer_in", "salary_income", "withdrawal")
DIRECTIONS = ("debit", "credit")
_TEXTS = ("merchant_text", "category_id", "reference", "counterparty_name")


def _blank(c: Column) -> Column:
    return F.coalesce(trim(c) == "", F.lit(True))


def _names(**missing: Column) -> Column:
    return F.array_compact(F.array(*(F.when(m, F.lit(name)) for name, m in missing.items())))


def check_entries(drafts: DataFrame) -> DataFrame:
    """Drafts (amount_text, currency, occurred_at, type, direction) with ``amount_problem`` and ``missing``, the fields to mend in order.

    An amount that cannot be parsed may have a wrong currency, so that is named too unless it looks
    like one. A negative amount is refused, never turned into a credit; zero is an amount.
    """
    rows = drafts.withColumn("amount_problem", amount_problem(F.col("amount_text")))
    problem = F.col("amount_problem")
    known = F.coalesce(currency_code(F.col("currency")).isNotNull(), F.lit(False))
    rows = rows.withColumn("amount_problem", F.when(problem.isNull() & ~known, "unparsable").otherwise(problem))
    missing = _names(
        amount=problem.isNotNull(),
        currency=F.coalesce(problem == "unparsable", F.lit(False)) & ~known,
        occurred_at=F.col("occurred_at").isNull(),
        type=_blank(F.col("type")),
        direction=~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)),
    )
    return rows.withColumn("missing", missing)


def manual_entries(drafts: DataFrame, last_id: int) -> DataFrame:
    """Transactions from the drafts that lack nothing, numbered after ``last_id`` by draft_id."""
    good = numbered(check_entries(drafts).where(F.size("missing") == 0), "draft_id", name="__n")
    texts = {c: F.when(~_blank(F.col(c)), trim(F.col(c))) for c in _TEXTS if c in drafts.columns}
    spend = ~F.col("type").isin(*NON_SPEND_TYPES)
    rows = good.withColumns({"id": F.lit(last_id) + F.col("__n"), "amount": parse_amount(F.col("amount_text")), "currency": currency_code(F.col("currency")), "affects_spend": spend, "provenance": F.lit("manual"), "is_deleted": F.lit(False), **texts})
    return rows.drop("__n", "amount_text", "amount_problem", "missing")


def complete_messages(drafts: DataFrame, messages: DataFrame) -> DataFrame:
    """Drafts (message_id, amount_text, currency, occurred_at, type) with ``missing`` and ``status``.

    rejected: a field is missing; unavailable: the message is not waiting for review; else accepted.
    """
    waiting = messages.where(PENDING_REVIEW).select(F.col("id").alias("message_id"), F.lit(True).alias("__waits"))
    amount = F.when(currency_code(F.col("currency")).isNotNull(), parse_amount(F.col("amount_text")))
    blank = _blank(F.col("amount_text"))
    missing = _names(amount=amount.isNull() & blank, currency=amount.isNull() & ~blank, occurred_at=F.col("occurred_at").isNull(), type=_blank(F.col("type")))
    rows = drafts.withColumn("missing", missing).join(waiting, "message_id", "left")
    status = F.when(F.size("missing") > 0, "rejected").when(F.col("__waits"), "accepted").otherwise("unavailable")
    return rows.withColumn("status", status).drop("__waits")


def mark_completed(messages: DataFrame, completed: DataFrame) -> DataFrame:
    """Messages whose completion was accepted are parsed from now on."""
    done = completed.where("status = 'accepted'").select(F.col("message_id").alias("id"), F.lit(True).alias("__done")).distinct()
    rows = messages.join(done, "id", "left")
    return rows.withColumn("classification", F.when(F.col("__done"), "financial_parsed").otherwise(F.col("classification"))).select(*messages.columns)
