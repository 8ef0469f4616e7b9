"""Predicates over the ledger, as columns, and the search filter."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import base_amount
from ..functions.text import fold

LIVE = "NOT is_deleted"
#: Messages that wait in the review queue; shared by the stream, the count and the deletion.
PENDING_REVIEW = "classification = 'financial_unparsed' AND NOT dismissed_as_not_transaction"


def in_period(start, end, column: str = "occurred_at") -> Column:
    """Half-open; a row without time is in no period."""
    at = F.col(column)
    return F.coalesce((at >= F.lit(start)) & (at < F.lit(end)), F.lit(False))


@dataclass(frozen=True)
class TransactionFilter:
    """Facets are joined by AND, the values of a facet by OR; an unset facet passes."""

    text: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    categories: tuple[str, ...] = ()
    instruments: tuple[int, ...] = ()
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    base: str = "SAR"

    @property
    def active_facets(self) -> int:
        return sum((bool(self.text and self.text.strip()), self.start is not None or self.end is not None, bool(self.categories), bool(self.instruments), self.has_amount))

    @property
    def is_active(self) -> bool:
        return self.active_facets > 0

    @property
    def has_amount(self) -> bool:
        return self.min_amount is not None or self.max_amount is not None

    def text_facet(self) -> Column:
        if not (self.text and self.text.strip()):
            return F.lit(True)
        wanted = fold(F.lit(self.text))
        hits = [F.coalesce(F.contains(fold(F.col(c)), wanted), F.lit(False)) for c in ("merchant_text", "counterparty_name", "counterparty_bank")]
        return hits[0] | hits[1] | hits[2]

    def date_facet(self) -> Column:
        at, ok = F.col("occurred_at"), F.lit(True)
        if self.start is not None:
            ok = ok & (at >= F.lit(self.start))
        if self.end is not None:
            ok = ok & (at < F.lit(self.end))
        return F.coalesce(ok, F.lit(False))

    def category_facet(self) -> Column:
        return F.coalesce("category_id", F.lit("uncategorized")).isin(*self.categories) if self.categories else F.lit(True)

    def instrument_facet(self) -> Column:
        return F.coalesce(F.col("instrument_id").isin(*self.instruments), F.lit(False)) if self.instruments else F.lit(True)

    def base_value(self) -> Column:
        return F.abs(base_amount(self.base)["value"])

    def amount_facet(self) -> Column:
        ok = F.lit(True)
        if self.min_amount is not None:
            ok = ok & (self.base_value() >= F.lit(abs(self.min_amount)))
        if self.max_amount is not None:
            ok = ok & (self.base_value() <= F.lit(abs(self.max_amount)))
        return F.coalesce(ok, F.lit(False))

    def other_facets(self) -> Column:
        return self.text_facet() & self.date_facet() & self.category_facet() & self.instrument_facet()

    def matches(self) -> Column:
        return self.other_facets() & self.amount_facet()

    def apply(self, transactions: DataFrame) -> DataFrame:
        """Adds ``kept`` and ``not_comparable``: rows that fail for want of a base amount alone."""
        unknown = self.base_value().isNull() & F.lit(self.has_amount)
        return transactions.withColumn("kept", self.matches()).withColumn("not_comparable", self.other_facets() & unknown)


def review_before(messages: DataFrame, cutoff) -> DataFrame:
    """Pending messages received before the cutoff, which itself is not before."""
    return messages.where(F.expr(PENDING_REVIEW) & (F.col("received_at") < F.lit(cutoff)))


def needing_review(transactions: DataFrame) -> DataFrame:
    """Live rows that are flagged, the latest first, rows without time last."""
    return transactions.where(LIVE).where("needs_review").orderBy(F.col("occurred_at").desc_nulls_last(), F.desc("id"))


def split_unreadable(rows: DataFrame, amount_text: str = "amount_text") -> tuple[DataFrame, DataFrame]:
    """(readable rows with ``amount``, unreadable rows): an amount that is no decimal is set apart, not dropped."""
    parsed = rows.withColumn("amount", F.col(amount_text).try_cast("decimal(20,4)"))
    return parsed.where("amount IS NOT NULL"), rows.where(F.col(amount_text).try_cast("decimal(20,4)").isNull())
