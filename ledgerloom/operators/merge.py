"""Merging two records of one movement: may they merge, and what does the survivor take over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = ("merchant_text", "reference", "counterparty_name", "occurred_at", "instrument_id")
PAIRS = (("fee_amount", "fee_currency", "fee_differs"), ("converted_amount", "converted_currency", "conversion_differs"), ("balance_amount", "balance_currency", "remaining_balance_differs"))
RATES = ("fx_rate", "fx_rate_date", "fx_rate_source")


def _both_differ(field: str) -> Column:
    s, m = F.col(f"s.{field}"), F.col(f"m.{field}")
    return s.isNotNull() & m.isNotNull() & (s != m)


def refusal() -> Column:
    """Why the pair (s, m) may not merge, the first reason in a fixed order; null if it may."""
    s, m = (lambda f: F.col(f"s.{f}")), (lambda f: F.col(f"m.{f}"))
    empty = F.array().cast("array<string>")
    mine, theirs = F.coalesce(s("user_edited"), empty), F.coalesce(m("user_edited"), empty)
    out = (
        F.when(s("id") == m("id"), "same_transaction")
        .when(s("is_deleted") | m("is_deleted"), "not_live")
        .when((s("amount") != m("amount")) | (s("currency") != m("currency")), "amount_differs")
        .when(~s("direction").eqNullSafe(m("direction")), "direction_differs")
        .when(~s("type").eqNullSafe(m("type")), "type_differs")
        .when(m("merged_from").isNotNull(), "chain_would_form")
    )
    for amount, currency, name in PAIRS:
        out = out.when(s(amount).isNotNull() & m(amount).isNotNull() & ((s(amount) != m(amount)) | (s(currency) != m(currency))), name)
    out = out.when(_both_differ("fx_rate"), "conversion_differs")
    out = out.when(s("affects_spend") != m("affects_spend"), "spend_effect_differs").when(_both_differ("transfer_state"), "spend_effect_differs")
    clash = F.lit(False)
    for f in TEXTS:
        clash = clash | (F.array_contains(theirs, f) & ~s(f).eqNullSafe(m(f)) & (s(f).isNotNull() | F.array_contains(mine, f)))
    # a user's edit of a field that does not carry over must agree
    fixed = F.array_contains(theirs, "category_id") & ~s("category_id").eqNullSafe(m("category_id"))
    return out.when(clash | fixed, "user_edit_differs")


def assess(pairs: DataFrame, transactions: DataFrame) -> DataFrame:
    """(survivor_id, merged_id, refusal) for pairs (survivor_id, merged_id)."""
    p = pairs.select("survivor_id", "merged_id")
    s = transactions.alias("s")
    m = transactions.alias("m")
    return p.join(s, F.col("survivor_id") == F.col("s.id")).join(m, F.col("merged_id") == F.col("m.id")).withColumn("refusal", refusal()).select("survivor_id", "merged_id", "refusal")


def apply_merges(transactions: DataFrame, pairs: DataFrame, at) -> DataFrame:
    """Merges the allowed pairs: the survivor's nulls are filled, unless protected; the other row is soft-deleted and points to it."""
    allowed = assess(pairs, transactions).where("refusal IS NULL").select("survivor_id", "merged_id")
    m = allowed.join(transactions, F.col("merged_id") == F.col("id")).select("survivor_id", "merged_id", *(F.col(c).alias(f"__{c}") for c in transactions.columns))
    gone = allowed.select(F.col("merged_id").alias("id"), F.col("survivor_id").alias("__into"))
    rows = transactions.join(m, F.col("id") == F.col("survivor_id"), "left").join(gone, "id", "left")
    hit, lost = F.col("survivor_id").isNotNull(), F.col("__into").isNotNull()
    empty = F.array().cast("array<string>")
    guarded = lambda f: F.array_contains(F.coalesce("user_edited", empty), f)
    new: dict[str, Column] = {f: F.when(hit & F.col(f).isNull() & ~guarded(f), F.col(f"__{f}")).otherwise(F.col(f)) for f in TEXTS}
    for amount, currency, _ in PAIRS:
        take = hit & F.col(amount).isNull()
        new |= {amount: F.when(take, F.col(f"__{amount}")).otherwise(F.col(amount)), currency: F.when(take, F.col(f"__{currency}")).otherwise(F.col(currency))}
    new |= {f: F.when(hit, F.coalesce(f, f"__{f}")).otherwise(F.col(f)) for f in RATES}
    settled = hit & ((F.col("converted_amount").isNull() & F.col("__converted_amount").isNotNull()) | (F.col("fx_rate").isNull() & F.col("__fx_rate").isNotNull()))
    new["conversion_pending"] = F.col("conversion_pending") & ~F.coalesce(settled, F.lit(False))
    stateless = hit & F.col("transfer_state").isNull()
    new |= {f: F.when(stateless, F.col(f"__{f}")).otherwise(F.col(f)) for f in ("transfer_state", "transfer_group")}
    carried = F.array_compact(F.array(*(F.when(hit & F.array_contains(F.coalesce("__user_edited", empty), f) & F.col(f).isNull() & ~guarded(f) & F.col(f"__{f}").isNotNull(), F.lit(f)) for f in TEXTS)))
    new["user_edited"] = F.when(F.size(carried) > 0, F.array_sort(F.array_union(F.coalesce("user_edited", empty), carried))).otherwise(F.col("user_edited"))
    new["merged_from"] = F.when(hit, F.col("merged_id")).otherwise(F.col("merged_from"))
    new["merged_into"] = F.coalesce("__into", "merged_into")
    new["is_deleted"] = F.col("is_deleted") | lost
    new["deleted_at"] = F.when(lost, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))
    return rows.withColumns(new).select(*transactions.columns)
