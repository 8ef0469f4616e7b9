"""What a transaction is in the reports: spend, credit against spend, income, cash, or left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import INCOME_TYPES, SPEND_TYPES


def classification(state: Column | None = None, unpairable: Column | None = None) -> Column:
    """Struct (class, reason, needs_review). A determined internal transfer goes first, whatever else holds."""
    state = F.col("transfer_state") if state is None else state
    doubtful = F.coalesce(state == "candidate", F.lit(False))
    if unpairable is not None:
        doubtful = doubtful | unpairable.isNotNull()
    credit = F.col("direction") == "credit"
    kind = F.coalesce("type", F.lit(""))
    spend = kind.isin(*SPEND_TYPES)
    unknown_direction = ~F.coalesce(F.col("direction").isin("debit", "credit"), F.lit(False))
    refund_debit = (kind == "refund") & ~credit
    unknown_type = ~kind.isin(*SPEND_TYPES, *INCOME_TYPES, "refund", "withdrawal", "card_repayment")

    def row(name: str, reason: str | None = None, review: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("class"), F.lit(reason).cast("string").alias("reason"), (F.lit(False) if review is None else review).alias("needs_review"))

    return (
        F.when(F.coalesce(state == "internal", F.lit(False)), row("excluded", "internal_transfer"))
        .when(unknown_direction | refund_debit | unknown_type, row("excluded", "unclassifiable", F.lit(True)))
        .when(kind == "refund", row("spend_credit"))
        .when(kind.isin(*INCOME_TYPES), row("income", None, doubtful))
        .when(kind == "withdrawal", row("cash_withdrawal"))
        .when(kind == "card_repayment", row("excluded", "card_repayment"))
        .when(spend & ~F.coalesce("affects_spend", F.lit(True)), row("excluded", "pack_declared_non_spend"))
        .when(credit, row("spend_credit", None, doubtful))
        .otherwise(row("spend", None, doubtful))
    )


def classified(transactions: DataFrame) -> DataFrame:
    """Adds ``class``, ``class_reason`` and ``class_review``; uses the results of transfer analysis if they are there."""
    state, unpairable = F.col("transfer_state"), None
    if "derived_state" in transactions.columns:
        state, unpairable = F.coalesce("transfer_state", "derived_state"), F.col("unpairable_reason")
    rows = transactions.withColumn("__c", classification(state, unpairable))
    return rows.withColumns({"class": F.col("__c.class"), "class_reason": F.col("__c.reason"), "class_review": F.col("__c.needs_review")}).drop("__c")
