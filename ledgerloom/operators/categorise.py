"""Categories for new transactions from what is known of their merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import merchant_key
from .matching import adopted, match_merchants, review_reason
from .mutations import get_or_create, link_merchants, set_category_automatically


def categorise(transactions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows with merchant and category as ``candidates`` (see ``matching.merchant_candidates``) tell.

    A rule that is sure enough sets the category; else the row is flagged with the reason: the merchant is
    unknown, has no rule, or was guessed. A guess names no merchant. Rows whose text names no merchant stay
    as they are, and so does what the user decided.
    """
    keyed = transactions.select("id", merchant_key(F.col("merchant_text")).alias("key")).where("key IS NOT NULL")
    matched = match_merchants(keyed, candidates)
    known = matched.select("id", "tier", "merchant_id", "category_id", "rule_id", "confidence", "auto_apply")
    met = keyed.join(known, "id", "left").withColumns({"tier": F.coalesce("tier", F.lit("none")), "auto_apply": F.coalesce("auto_apply", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0))})
    sure = F.col("auto_apply")
    changes = met.select("id", F.when(sure, F.col("category_id")).alias("category_id"), F.when(sure, F.col("rule_id")).cast("bigint").alias("rule_id"), "confidence", review_reason().alias("reason"))
    linked = link_merchants(transactions, adopted(known).select("id", "merchant_id"))
    return set_category_automatically(linked, changes)


def ensure_merchants(merchants: DataFrame, transactions: DataFrame) -> DataFrame:
    """``merchants`` and, after them, one for each key that transactions without a merchant name."""
    fresh = transactions.where("merchant_id IS NULL").select(merchant_key(F.col("merchant_text")).alias("merchant_key"))
    return get_or_create(merchants, fresh, "merchant_key")
