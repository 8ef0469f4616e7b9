"""A ledger made of the driver's tables, so that every operator has rows to work on.

The view is plain SQL that Spark and an oracle both run; ``with_defaults`` adds the columns that it
leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES, UNCATEGORIZED, with_defaults

BASE = "SAR"
LEDGER_SQL = """
SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(20,4)) AS amount,
    CASE WHEN o_orderkey % 5 = 0 THEN 'USD' WHEN o_orderkey % 11 = 0 THEN 'KWD' ELSE 'SAR' END AS currency,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 13 IN (2, 4, 7) THEN 'credit' WHEN o_orderkey % 37 = 0 THEN 'credit' ELSE 'debit' END AS direction,
    CASE o_orderkey % 13 WHEN 0 THEN 'pos_purchase' WHEN 1 THEN 'online_purchase' WHEN 2 THEN 'refund' WHEN 3 THEN 'bill_payment' WHEN 4 THEN 'salary_income' WHEN 5 THEN 'withdrawal'
        WHEN 6 THEN 'transfer_out' WHEN 7 THEN 'transfer_in' WHEN 8 THEN 'card_repayment' WHEN 9 THEN 'fee' WHEN 10 THEN 'installment' WHEN 11 THEN 'adjustment' ELSE 'loyalty_points' END AS type,
    o_orderkey % 17 <> 0 AS affects_spend, o_orderkey % 23 = 0 AS is_deleted,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderdate END AS occurred_at,
    CASE WHEN o_orderkey % 15 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(20,2)) * CAST(3.75 AS DECIMAL(3,2)) AS DECIMAL(20,4)) END AS converted_amount,
    CASE WHEN o_orderkey % 15 = 0 THEN 'SAR' END AS converted_currency,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(11.25 AS DECIMAL(20,4)) END AS fee_amount,
    CASE WHEN o_orderkey % 14 = 0 THEN 'USD' WHEN o_orderkey % 7 = 0 THEN 'SAR' END AS fee_currency,
    CASE WHEN o_orderkey % 15 = 10 THEN CAST(3.75125 AS DECIMAL(18,8)) END AS fx_rate,
    o_orderkey % 15 = 5 AS conversion_pending,
    CASE WHEN o_orderkey % 6 = 0 THEN 'TRX-' || CAST(o_custkey AS STRING) END AS reference,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey % 100 END AS instrument_id,
    '****' || CAST(1000 + o_custkey % 100 AS STRING) AS masked_ref,
    CASE WHEN o_orderkey % 13 IN (6, 7) AND o_orderkey % 4 = 1 THEN 'internal' WHEN o_orderkey % 13 IN (6, 7) AND o_orderkey % 4 = 2 THEN 'candidate' END AS transfer_state,
    'Shop-' || CAST(o_custkey % 300 AS STRING) || ' Store 0' || CAST(o_custkey % 10 AS STRING) AS merchant_text,
    CASE WHEN o_orderkey % 8 = 3 THEN c_name END AS counterparty_name,
    o_custkey % 300 AS merchant_id,
    CASE o_orderkey % 9 WHEN 0 THEN 'groceries' WHEN 1 THEN 'dining' WHEN 2 THEN 'transport_fuel' WHEN 3 THEN 'fees_charges' WHEN 4 THEN 'salary_income' WHEN 5 THEN 'no_such_category' WHEN 6 THEN 'shopping_retail' END AS category_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 'user' WHEN o_orderkey % 10 < 4 THEN 'rule' END AS category_source,
    CASE WHEN o_orderkey % 10 = 0 THEN CAST(1.0 AS DOUBLE) WHEN o_orderkey % 10 < 4 THEN CAST(0.5 AS DOUBLE) + (o_orderkey % 5) / CAST(10.0 AS DOUBLE) END AS category_confidence,
    o_orderkey % 31 = 0 AS needs_review, CASE WHEN o_orderkey % 62 = 0 THEN 'low_confidence' WHEN o_orderkey % 31 = 0 THEN 'possible_duplicate' END AS review_reason
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
#: Transfer legs out of the events: purchases leave, errors come in, the user is the instrument.
LEGS_SQL = """
SELECT event_id AS id, CAST(value AS DECIMAL(20,4)) AS amount, CASE WHEN event_id % 5 = 0 THEN 'USD' ELSE 'SAR' END AS currency, CASE event_type WHEN 'purchase' THEN 'debit' ELSE 'credit' END AS direction,
    CASE event_type WHEN 'purchase' THEN 'transfer_out' ELSE 'transfer_in' END AS type, TRUE AS affects_spend, event_id % 29 = 0 AS is_deleted, ts AS occurred_at,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS instrument_id, CASE WHEN event_id % 3 = 0 THEN ' ref-' || CAST(user_id % 4 AS STRING) END AS reference
FROM {events} WHERE event_type IN ('purchase', 'error')
"""
INSTRUMENT_SQL = "SELECT s_suppkey AS id, s_nationkey AS bank_id, CASE WHEN s_suppkey % 2 = 0 THEN 'card' ELSE 'account' END AS kind, '****' || CAST(1000 + s_suppkey AS STRING) AS masked, CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 1 THEN s_name END AS friendly_name, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 END AS settlement_account_id FROM {supplier}"
BANK_SQL = "SELECT n_nationkey AS id, n_name AS name_en, n_regionkey FROM {nation}"
MERCHANT_SQL = "SELECT p_partkey AS id, upper(p_name) || ' ' || CAST(p_partkey AS STRING) AS merchant_key, p_size, p_brand FROM {part}"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs one of the statements above on the tables it names."""
    names = [n for n in ("orders", "customer", "events", "supplier", "nation", "part") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(view(spark, sf_dir, LEDGER_SQL))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(view(spark, sf_dir, LEGS_SQL))


def categories(spark: SparkSession) -> DataFrame:
    rows = [(c, g, name, c == UNCATEGORIZED, False, i) for i, (c, g, name) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "id string, group_key string, name_en string, is_protected boolean, is_archived boolean, sort_order int")
