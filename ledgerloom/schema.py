"""Schemas of the tables, given explicitly at every read. Money is an exact decimal beside its currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(20, 4)
RATE = T.DecimalType(18, 8)


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "decimal(20,4)": AMOUNT,
    "decimal(18,8)": RATE,
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """Schema of "name type, ..."; needs no session, so schemas exist when modules are imported."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split(" ") for part in text.split(", "))])


RAW_MESSAGE = _struct("provider_id bigint, address string, body string, received_at timestamp")
INSTRUMENT = _struct("id bigint, bank_id bigint, kind string, masked string, network string, friendly_name string, currency string, settlement_account_id bigint, link_source string")
BANK = _struct("id bigint, canonical_key string, name_ar string, name_en string, aliases array<string>, source string")
CATEGORY = _struct("id string, group_key string, name_en string, is_protected boolean, is_archived boolean, sort_order int")
MERCHANT = _struct("id bigint, merchant_key string")
MERCHANT_ALIAS = _struct("merchant_id bigint, alias_key string, script string")
MERCHANT_RULE = _struct("id bigint, merchant_id bigint, category_id string, source string, is_enabled boolean, updated_at timestamp, applied_count bigint")
TRANSACTION = _struct(
    "id bigint, amount decimal(20,4), currency string, direction string, type string, affects_spend boolean, is_deleted boolean, deleted_at timestamp, occurred_at timestamp, "
    "converted_amount decimal(20,4), converted_currency string, fee_amount decimal(20,4), fee_currency string, balance_amount decimal(20,4), balance_currency string, "
    "fx_rate decimal(18,8), fx_rate_date timestamp, fx_rate_source string, conversion_pending boolean, reference string, instrument_id bigint, masked_ref string, transfer_state string, transfer_group string, "
    "merchant_text string, merchant_id bigint, counterparty_name string, counterparty_bank string, category_id string, category_source string, category_confidence double, category_rule_id bigint, "
    "needs_review boolean, review_reason string, duplicate_of bigint, user_edited array<string>, merged_into bigint, merged_from bigint, time_source string, provenance string, source_message_id string"
)
AUDIT_ENTRY = _struct("id bigint, entity_type string, entity_id string, action string, actor string, actor_detail string, changed_at timestamp, field_changes string, prev_hash string, entry_hash string")
WATERMARK = _struct("last_id bigint, last_date timestamp, import_state string, import_cursor bigint, import_from timestamp, total bigint")

# The thirteen categories in their order, (id, group, English name).
CATEGORIES = (
    ("groceries", "spending", "Groceries"),
    ("dining", "spending", "Dining & Cafés"),
    ("transport_fuel", "spending", "Transport & Fuel"),
    ("utilities_bills", "spending", "Utilities & Bills"),
    ("shopping_retail", "spending", "Shopping & Retail"),
    ("entertainment_subscriptions", "spending", "Entertainment & Subscriptions"),
    ("health_pharmacy", "spending", "Health & Pharmacy"),
    ("loan_installments", "spending", "Loan & Installments"),
    ("fees_charges", "spending", "Fees & Charges"),
    ("uncategorized", "spending", "Uncategorized"),
    ("salary_income", "money_movement", "Salary & Income"),
    ("cash_withdrawal", "money_movement", "Cash & ATM Withdrawal"),
    ("internal_transfer", "money_movement", "Internal Transfer"),
)
UNCATEGORIZED = "uncategorized"
#: Tables of categories of up to so many rows are broadcast; users may make their own.
MAX_BROADCAST_CATEGORIES = 100_000

# Transaction types.
SPEND_TYPES = ("pos_purchase", "online_purchase", "bill_payment", "fee", "installment", "account_debit", "transfer_out", "adjustment")
INCOME_TYPES = ("salary_income", "transfer_in")
TRANSFER_TYPES = ("transfer_out", "transfer_in")

# Currencies whose number of decimal places is not 2.
MINOR_DIGITS = {
    0: ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "UYI", "VND", "VUV", "XAF", "XOF", "XPF"),
    3: ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"),
    4: ("CLF",),
}


def minor_digits(currency: str) -> int:
    return next((n for n, codes in MINOR_DIGITS.items() if currency.upper() in codes), 2)


def with_defaults(rows: DataFrame) -> DataFrame:
    """All columns of a transaction; those that are missing are null, or false for flags that are never null."""
    flags = {"is_deleted", "conversion_pending", "needs_review"}
    add = {f.name: F.lit(False if f.name in flags else None).cast(f.dataType) for f in TRANSACTION if f.name not in rows.columns}
    return rows.withColumns(add)
