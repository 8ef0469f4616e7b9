"""Queries over the driver's tables, one or more an operator, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, money, sanitize, similarity, text
from ..operators import audit, categorise, classify, duplicates, entities, entry, filters, lineage, matching, merge, mutations, transfers
from ..schema import CATEGORIES, INCOME_TYPES, SPEND_TYPES, TRANSACTION, with_defaults
from ..sources import messages, rule_pack
from . import reports
from .ledger import BANK_SQL, BASE, INSTRUMENT_SQL, LEDGER_SQL, LEGS_SQL, MERCHANT_SQL, categories, ledger, legs, view

Query = Callable[[SparkSession, str], DataFrame]
START, END = datetime(1996, 3, 1), datetime(1996, 9, 1)
_PERIOD = "occurred_at >= TIMESTAMP '1996-03-01' AND occurred_at < TIMESTAMP '1996-09-01'"
_TABLES = {n: n for n in ("orders", "customer", "events", "supplier", "nation", "part")}
_TX = LEDGER_SQL.format(**_TABLES)
_LEGS = LEGS_SQL.format(**_TABLES)
_INST = INSTRUMENT_SQL.format(**_TABLES)
_BANK = BANK_SQL.format(**_TABLES)
_MERCHANT = MERCHANT_SQL.format(**_TABLES)
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_CATEGORY_ROWS = ", ".join(f"('{c}', '{g}', {i})" for i, (c, g, _) in enumerate(CATEGORIES))

# Classified rows with base amounts, as the reports see them.
_CLASSIFIED = f"""
WITH tx AS ({_TX}), classed AS (
    SELECT *, CASE
        WHEN transfer_state = 'internal' THEN 'excluded:internal_transfer'
        WHEN direction IS NULL OR type NOT IN {_in((*SPEND_TYPES, *INCOME_TYPES, "refund", "withdrawal", "card_repayment"))} OR (type = 'refund' AND direction <> 'credit') THEN 'excluded:unclassifiable'
        WHEN type = 'refund' THEN 'spend_credit:'
        WHEN type IN {_in(INCOME_TYPES)} THEN 'income:'
        WHEN type = 'withdrawal' THEN 'cash_withdrawal:'
        WHEN type = 'card_repayment' THEN 'excluded:card_repayment'
        WHEN NOT affects_spend THEN 'excluded:pack_declared_non_spend'
        WHEN direction = 'credit' THEN 'spend_credit:' ELSE 'spend:' END AS cr,
        CASE WHEN currency = '{BASE}' THEN amount WHEN converted_currency = '{BASE}' THEN converted_amount WHEN fx_rate > 0 THEN CAST(round(amount * fx_rate, 2) AS DECIMAL(20,4)) END AS base_value,
        CASE WHEN currency = '{BASE}' THEN 'native' WHEN converted_currency = '{BASE}' THEN 'bank_supplied' WHEN fx_rate > 0 THEN 'stated_rate' ELSE 'unavailable' END AS basis,
        CASE WHEN fee_currency = '{BASE}' THEN fee_amount WHEN fee_amount IS NOT NULL AND fx_rate > 0 THEN CAST(round(fee_amount * fx_rate, 2) AS DECIMAL(20,4)) END AS fee_base
    FROM tx
), c AS (
    SELECT *, split_part(cr, ':', 1) AS class, nullif(split_part(cr, ':', 2), '') AS class_reason,
        cr = 'excluded:unclassifiable' OR (coalesce(transfer_state = 'candidate', FALSE) AND cr IN ('income:', 'spend:', 'spend_credit:')) AS class_review,
        cr IN ('spend:', 'spend_credit:') AS is_spend, CASE WHEN direction = 'credit' THEN -base_value ELSE base_value END AS signed_base
    FROM classed
), live AS (SELECT *, coalesce({_PERIOD}, FALSE) AS inside FROM c WHERE NOT is_deleted)
"""
_MEASURED = (
    _CLASSIFIED
    + """, measured AS (
    SELECT id, inside, CASE WHEN is_spend THEN 'spend' WHEN class = 'income' THEN 'income' WHEN class = 'cash_withdrawal' THEN 'cash_withdrawals' ELSE 'internal_transfers' END AS measure,
        currency, CASE WHEN is_spend AND direction = 'credit' THEN -amount ELSE amount END AS native, CASE WHEN is_spend THEN signed_base ELSE base_value END AS base_value
    FROM live WHERE is_spend OR class IN ('income', 'cash_withdrawal') OR (class_reason = 'internal_transfer' AND direction = 'debit')
    UNION ALL SELECT id, inside, 'fees', fee_currency, fee_amount, fee_base FROM live WHERE fee_amount IS NOT NULL
)
"""
)
_D = "CAST({} AS DOUBLE)"


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _double(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return register


# --- sources -------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def s1_read_since(spark, d):
    return messages.read_since(_tables(spark, d, "events"), 500, 100, "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id > 10 ORDER BY event_id LIMIT 100")
def s2_read_range(spark, d):
    return messages.read_range(_tables(spark, d, "events"), datetime(2024, 1, 15), 10, 100, "event_id", "ts").select("event_id", "user_id")


@query("SELECT max(event_id) AS last_id, max_by(ts, event_id) AS last_date FROM events")
def s3_high_water_mark(spark, d):
    return messages.high_water_mark(_tables(spark, d, "events"), "event_id", "ts")


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def s4_count_range(spark, d):
    return messages.count_range(_tables(spark, d, "events"), datetime(2024, 1, 15), "ts")


@query(f"SELECT id, CAST(amount AS DOUBLE) AS amount, currency, type, occurred_at FROM ({_TX})")
def s5_full_scan(spark, d):
    return view(spark, d, LEDGER_SQL).select("id", *_double("amount"), "currency", "type", "occurred_at")


@query(f"SELECT id, merchant_key FROM ({_MERCHANT}) WHERE merchant_key = 'SMALL RING 0' OR id = 7")
def s7_point_lookup(spark, d):
    return view(spark, d, MERCHANT_SQL).where("merchant_key = 'SMALL RING 0' OR id = 7").select("id", "merchant_key")


# --- filters -------------------------------------------------------------------------------------


@query(f"SELECT type, count(*) AS n FROM ({_TX}) WHERE NOT is_deleted GROUP BY type")
def f1_live_by_type(spark, d):
    return ledger(spark, d).where(filters.LIVE).groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT id, occurred_at FROM ({_TX}) WHERE {_PERIOD}")
def f2_period(spark, d):
    return ledger(spark, d).where(filters.in_period(START, END)).select("id", "occurred_at")


_FILTER = filters.TransactionFilter(text="shop-1", start=START, end=END, categories=("groceries", "uncategorized"), instruments=tuple(range(50)), min_amount=Decimal(20000), max_amount=Decimal(400000))


@query(
    _CLASSIFIED
    + """, f AS (
    SELECT id, (contains(upper(merchant_text), 'SHOP-1') OR coalesce(contains(upper(counterparty_name), 'SHOP-1'), FALSE)) AND inside
        AND coalesce(category_id, 'uncategorized') IN ('groceries', 'uncategorized') AND coalesce(instrument_id < 50, FALSE) AS others, base_value
    FROM live
)
SELECT id, others AND coalesce(abs(base_value) BETWEEN 20000 AND 400000, FALSE) AS kept, others AND base_value IS NULL AS not_comparable FROM f WHERE others
"""
)
def f3_search(spark, d):
    found = _FILTER.apply(ledger(spark, d).where(filters.LIVE))
    return found.where(_FILTER.other_facets()).select("id", "kept", "not_comparable")


@query(
    _CLASSIFIED
    + """SELECT count(*) AS n, CAST(sum(CASE WHEN is_spend THEN signed_base END) AS DOUBLE) AS spend FROM live
    WHERE inside AND contains(upper(merchant_text), 'SHOP-1') AND abs(base_value) BETWEEN 20000 AND 400000"""
)
def f3_search_total(spark, d):
    search = filters.TransactionFilter(text="shop-1", start=START, end=END, min_amount=Decimal(20000), max_amount=Decimal(400000))
    kept = classify.classified(ledger(spark, d)).where(filters.LIVE).where(search.matches())
    value = money.signed_for_spend(money.base_amount(BASE)["value"], F.col("direction"))
    return kept.agg(F.count("*").alias("n"), F.sum(F.when(F.col("class").isin("spend", "spend_credit"), value)).cast("double").alias("spend"))


@query(f"SELECT coalesce(category_id, 'none') AS category, count(*) AS n FROM ({_TX}) GROUP BY 1")
def f7_usage_with_deleted(spark, d):
    return ledger(spark, d).groupBy(F.coalesce("category_id", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS DECIMAL(20,4)) IS NOT NULL AS readable FROM documents")
def f9_unreadable_amounts(spark, d):
    rows = _tables(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")).alias("amount_text"))
    good, bad = filters.split_unreadable(rows)
    return good.select("doc_id", F.lit(True).alias("readable")).unionByName(bad.select("doc_id", F.lit(False).alias("readable")))


# --- joins ---------------------------------------------------------------------------------------


@query(f"SELECT t.id, i.masked, i.bank_id FROM ({_TX}) t LEFT JOIN ({_INST}) i ON t.instrument_id = i.id")
def j1_instruments(spark, d):
    inst = view(spark, d, INSTRUMENT_SQL).select(F.col("id").alias("instrument_id"), "masked", "bank_id")
    return ledger(spark, d).select("id", "instrument_id").join(inst, "instrument_id", "left").select("id", "masked", "bank_id")


@query(f"WITH i AS ({_INST}) SELECT i.id, coalesce(nullif(trim(a.friendly_name), ''), nullif(trim(a.masked), '')) AS settlement_label FROM i LEFT JOIN i a ON i.settlement_account_id = a.id")
def j3_settlement_labels(spark, d):
    return reports.settlement_labels(view(spark, d, INSTRUMENT_SQL))


def _merchant_tables(spark, d):
    m = view(spark, d, MERCHANT_SQL)
    aliases = m.where("id % 4 = 0").select(F.col("id").alias("merchant_id"), F.concat(F.lit("SHOP "), F.col("id").cast("string")).alias("alias_key"))
    rules = m.where("id % 3 = 0").select(F.col("id"), F.col("id").alias("merchant_id"), F.when(F.col("id") % 2 == 0, "groceries").otherwise("gone").alias("category_id"), F.when(F.col("id") % 5 == 0, "user").otherwise("seed").alias("source"), (F.col("id") % 7 != 0).alias("is_enabled"), F.col("p_size").alias("updated_at"))
    return m, aliases, rules


_CANDIDATES = f"""WITH m AS ({_MERCHANT})
SELECT id AS merchant_id, merchant_key, CASE WHEN id % 4 = 0 THEN 'SHOP ' || CAST(id AS STRING) ELSE '' END AS aliases,
    CASE WHEN id % 3 = 0 AND id % 2 = 0 AND id % 7 <> 0 THEN 'groceries' END AS category_id, CASE WHEN id % 3 = 0 AND id % 2 = 0 AND id % 7 <> 0 THEN CASE WHEN id % 5 = 0 THEN 'user' ELSE 'seed' END END AS rule_source FROM m"""


@query(_CANDIDATES)
def j4_merchant_candidates(spark, d):
    c = matching.merchant_candidates(*_merchant_tables(spark, d), categories(spark))
    return c.select("merchant_id", "merchant_key", F.array_join("alias_keys", ",").alias("aliases"), "category_id", "rule_source")


@query(f"SELECT id, merchant_key FROM ({_MERCHANT}) WHERE id % 3 = 0")
def j5_rules_listed(spark, d):
    m, _, rules = _merchant_tables(spark, d)
    return matching.rules_listed(rules, m).select("id", "merchant_key")


@query(f"SELECT id, CASE WHEN category_id = 'no_such_category' OR category_id IS NULL THEN 'uncategorized' ELSE category_id END AS category FROM ({_TX})")
def j6_resolved_category(spark, d):
    return reports.resolved_category(ledger(spark, d), categories(spark)).select("id", "category")


@query(
    f"""WITH t AS (SELECT * FROM ({_TX}) WHERE NOT is_deleted AND occurred_at IS NOT NULL), hits AS (
    SELECT i.id, 1 AS tier, e.id AS dup FROM t i JOIN t e ON i.reference = e.reference AND i.masked_ref = e.masked_ref AND e.id <> i.id AND e.occurred_at >= i.occurred_at - INTERVAL 15 MINUTE
    UNION ALL SELECT i.id, 2, e.id FROM t i JOIN t e ON i.masked_ref = e.masked_ref AND i.currency = e.currency AND i.amount = e.amount AND i.merchant_text = e.merchant_text AND e.id <> i.id
        AND e.occurred_at BETWEEN i.occurred_at - INTERVAL 15 MINUTE AND i.occurred_at + INTERVAL 15 MINUTE
) SELECT id, CASE min(tier) WHEN 1 THEN 'reference' ELSE 'amount_and_time' END AS tier, arg_min(dup, tier * 1000000000000 + dup) AS duplicate_of FROM hits GROUP BY id"""
)
def j7_duplicates(spark, d):
    rows = ledger(spark, d).where("occurred_at IS NOT NULL")
    return duplicates.duplicate_decisions(rows.where(filters.LIVE), rows).select("id", "tier", "duplicate_of")


_TRANSFER_CANDIDATES = f"""WITH l AS (SELECT *, nullif(upper(trim(reference)), '') AS r FROM ({_LEGS}) WHERE NOT is_deleted AND instrument_id IS NOT NULL)
SELECT o.id AS out_id, i.id AS in_id, CASE WHEN o.r = i.r THEN 'reference_match' ELSE 'amount_and_time' END AS evidence
FROM l o JOIN l i ON o.type = 'transfer_out' AND i.type = 'transfer_in' AND o.amount = i.amount AND o.currency = i.currency AND o.instrument_id <> i.instrument_id
    AND abs(epoch_us(o.occurred_at) - epoch_us(i.occurred_at)) <= 86400000000"""


@query(_TRANSFER_CANDIDATES)
def j8_transfer_candidates(spark, d):
    return transfers.transfer_candidates(legs(spark, d)).select("out_id", "in_id", "evidence")


_TRANSFER_PAIRS = f"""WITH RECURSIVE k AS ({_TRANSFER_CANDIDATES}), ord AS (SELECT k.*, row_number() OVER (ORDER BY evidence DESC, t.occurred_at, out_id, in_id) AS n FROM k JOIN ({_LEGS}) t ON t.id = k.out_id),
steps(n, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
    UNION ALL SELECT s.n + 1, CASE WHEN list_has_any(s.used, [o.out_id, o.in_id]) THEN s.used ELSE s.used || [o.out_id, o.in_id] END, CASE WHEN list_has_any(s.used, [o.out_id, o.in_id]) THEN s.taken ELSE s.taken || [o.n] END
    FROM steps s JOIN ord o ON o.n = s.n + 1),
last AS (SELECT unnest(taken) AS n FROM steps ORDER BY steps.n DESC LIMIT (SELECT len(taken) FROM steps ORDER BY n DESC LIMIT 1))
SELECT out_id, in_id, evidence, CASE evidence WHEN 'reference_match' THEN 'internal' ELSE 'candidate' END AS state, 'itl:' || CAST(out_id AS VARCHAR) || ':' || CAST(in_id AS VARCHAR) AS group_id FROM ord WHERE n IN (SELECT n FROM last)"""


@query(_TRANSFER_PAIRS)
def j8_transfer_pairs(spark, d):
    return transfers.pair_transfers(legs(spark, d))


@query(
    f"""WITH p AS ({_TRANSFER_PAIRS}), l AS (SELECT * FROM ({_LEGS}) WHERE NOT is_deleted AND id NOT IN (SELECT unnest([out_id, in_id]) FROM p)), met AS (SELECT o.id AS out_id, i.id AS in_id,
    CASE WHEN o.instrument_id <> i.instrument_id AND o.currency <> i.currency THEN 'cross_currency_near_match' WHEN (o.instrument_id IS NULL) <> (i.instrument_id IS NULL) AND o.amount = i.amount AND o.currency = i.currency THEN 'unresolved_instrument' END AS reason
    FROM l o JOIN l i ON o.type = 'transfer_out' AND i.type = 'transfer_in' AND abs(epoch_us(o.occurred_at) - epoch_us(i.occurred_at)) <= 86400000000),
known AS (SELECT out_id AS id, in_id AS partner, reason FROM met WHERE reason IS NOT NULL UNION ALL SELECT in_id, out_id, reason FROM met WHERE reason IS NOT NULL)
SELECT id, arg_min(reason, partner) AS reason FROM known GROUP BY id"""
)
def j9_near_matches(spark, d):
    rows = legs(spark, d)
    return transfers.near_matches(rows, transfers.pair_transfers(rows))


@query()
def j10_merchant_matching(spark, d):
    names = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    swapped = F.concat_ws(" ", F.reverse(F.split(names, " ")))
    texts = _tables(spark, d, "part").select(F.col("p_partkey").alias("id"), text.merchant_key(F.when(F.col("p_partkey") % 2 == 0, names).otherwise(swapped)).alias("key"))
    return matching.match_merchants(texts, matching.merchant_candidates(*_merchant_tables(spark, d), categories(spark)))


@query(
    f"""WITH m AS ({_MERCHANT}), r AS (SELECT id, merchant_key, id % 3 = 0 AND id % 2 = 0 AND id % 7 <> 0 AS ruled, id % 5 = 0 AS mine FROM m),
t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || ' ' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) || ' ' || array_to_string(list_reverse(string_split(upper(p_name), ' ')), ' ') END AS key FROM part),
exact AS (SELECT t.id, r.id AS merchant_id, ruled, mine FROM t JOIN r ON t.key = r.merchant_key),
token AS (SELECT t.id, r.id AS merchant_id FROM t JOIN r ON ruled AND t.id = r.id AND t.key <> r.merchant_key)
SELECT id, merchant_id, CASE WHEN NOT ruled THEN 'none' WHEN mine THEN 'exact_user' ELSE 'exact_seed' END AS tier, CASE WHEN ruled THEN 'groceries' END AS category_id FROM exact
UNION ALL SELECT id, merchant_id, 'token', 'groceries' FROM token"""
)
def j10_exact_and_token_tiers(spark, d):
    # a key with its words in another order has the same words as no other merchant, as each ends in a number of its own
    return j10_merchant_matching(spark, d).where("tier IN ('exact_user', 'exact_seed', 'none') OR confidence >= 0.85").select("id", "merchant_id", "tier", "category_id")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://blog[.]') THEN 'blog' WHEN regexp_matches(url, '(?i)[.]com/') THEN 'com' END AS bank_id FROM pages")
def j11_sender_bank(spark, d):
    banks = tuple(rule_pack.Bank(b, {}, (), (rule_pack.java_pattern(p),), ()) for b, p in (("blog", "^https?://blog[.]"), ("com", "[.]com/")))
    return _tables(spark, d, "pages").select("page_id", rule_pack.bank_of(rule_pack.RulePack("p", "1", banks), F.col("url")).alias("bank_id"))


@query("SELECT n_nationkey, regexp_replace(lower(trim(n_name)), '[\\s_-]+', '', 'g') AS bank_key FROM nation")
def j12_bank_key(spark, d):
    return _tables(spark, d, "nation").select("n_nationkey", text.bank_key(F.col("n_name")).alias("bank_key"))


@query("WITH b AS (SELECT event_id, user_id * 1000 + CAST(floor(value) AS BIGINT) AS k FROM events) SELECT min(event_id) AS event_id FROM b WHERE event_id >= 2000 AND k NOT IN (SELECT k FROM b WHERE event_id < 2000) GROUP BY k")
def j13_exact_new(spark, d):
    rows = _tables(spark, d, "events").select("event_id", (F.col("user_id") * 1000 + F.floor("value")).alias("k"))
    return duplicates.exact_new(rows.where("event_id >= 2000"), rows.where("event_id < 2000"), ("k",), "event_id").select("event_id")


@query("WITH b AS (SELECT event_id, user_id AS a, CAST(floor(value) AS BIGINT) AS k FROM events), seen AS (SELECT list(DISTINCT a) AS u, list(DISTINCT k) AS v FROM b WHERE event_id < 200), l AS (SELECT list({'e': event_id, 'a': a, 'k': k} ORDER BY event_id) AS x FROM b WHERE event_id >= 200) SELECT unnest(list_reduce(list_prepend({'kept': CAST([] AS BIGINT[]), 'u': u, 'v': v, 'e': CAST(0 AS BIGINT), 'a': CAST(0 AS BIGINT), 'k': CAST(0 AS BIGINT)}, list_transform(x, lambda r: {'kept': CAST([] AS BIGINT[]), 'u': CAST([] AS BIGINT[]), 'v': CAST([] AS BIGINT[]), 'e': CAST(r.e AS BIGINT), 'a': CAST(r.a AS BIGINT), 'k': r.k})), lambda s, r: CASE WHEN list_contains(s.u, r.a) OR list_contains(s.v, r.k) THEN s ELSE {'kept': s.kept || [r.e], 'u': s.u || [r.a], 'v': s.v || [r.k], 'e': s.e, 'a': s.a, 'k': s.k} END).kept) AS event_id FROM l, seen")
def j13_exact_new_two_keys(spark, d):
    rows = _tables(spark, d, "events").select("event_id", F.col("user_id").alias("a"), F.floor("value").alias("k"))
    return duplicates.exact_new(rows.where("event_id >= 200"), rows.where("event_id < 200"), ("a", "k"), "event_id").select("event_id")


# --- reports -------------------------------------------------------------------------------------


@query(
    _MEASURED
    + """SELECT m.measure, CAST(sum(base_value) AS DOUBLE) AS base, count(base_value) AS converted_count, count(*) FILTER (id IS NOT NULL AND base_value IS NULL) AS unconverted_count,
    count(*) FILTER (id IS NOT NULL AND base_value IS NULL) > 0 AS is_incomplete
FROM (VALUES ('spend'), ('income'), ('cash_withdrawals'), ('internal_transfers'), ('fees')) m(measure) LEFT JOIN (SELECT * FROM measured WHERE inside) x USING (measure) GROUP BY 1"""
)
def a1_period_report(spark, d):
    out = reports.period_report(classify.classified(ledger(spark, d)), START, END, BASE)
    return out.select("measure", *_double("base"), "converted_count", "unconverted_count", "is_incomplete")


@query(
    _MEASURED
    + """, s AS (SELECT measure, currency, CAST(sum(native) AS DOUBLE) AS net, count(*) AS transactions, CAST(sum(native) FILTER (base_value IS NULL) AS DOUBLE) AS unconverted_net, count(*) FILTER (base_value IS NULL) AS unconverted
    FROM measured WHERE inside GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY measure ORDER BY transactions DESC, currency) AS position FROM s"""
)
def a2_by_currency(spark, d):
    out = reports.by_currency(classify.classified(ledger(spark, d)), START, END, BASE)
    return out.select("measure", "currency", *_double("net"), "transactions", *_double("unconverted_net"), "unconverted", "position")


@query(
    _CLASSIFIED
    + """SELECT CAST(CASE WHEN count(*) FILTER (class = 'income') = 0 THEN 0 ELSE sum(base_value) FILTER (class = 'income') END - CASE WHEN count(*) FILTER (is_spend) = 0 THEN 0 ELSE sum(signed_base) FILTER (is_spend) END AS DOUBLE) AS net_kept,
    count(*) FILTER (class_review) AS needs_review FROM live WHERE inside"""
)
def a5_net_kept(spark, d):
    return reports.net_kept(classify.classified(ledger(spark, d)), START, END, BASE).select(*_double("net_kept"), "needs_review")


@query(
    _CLASSIFIED
    + f""", cats(category, g, sort_order) AS (VALUES {_CATEGORY_ROWS}), r AS (SELECT *, CASE WHEN category_id IN (SELECT category FROM cats) THEN category_id ELSE 'uncategorized' END AS category FROM live),
s AS (SELECT category, sum(signed_base) FILTER (is_spend AND inside) AS base, count(*) FILTER (is_spend AND inside AND base_value IS NULL) AS unconverted_count, count(*) FILTER (inside) AS members FROM r GROUP BY 1)
SELECT category, sort_order, CAST(base AS DOUBLE) AS base, unconverted_count, members, CAST(round(abs(base) * 100.0 / nullif(abs(sum(base) OVER ()), 0)) AS BIGINT) AS percent FROM s JOIN cats USING (category)"""
)
def a7_category_breakdown(spark, d):
    out = reports.category_breakdown(classify.classified(ledger(spark, d)), categories(spark), START, END, BASE)
    return out.select("category", "sort_order", *_double("base"), "unconverted_count", "members", "percent")


@query(
    _CLASSIFIED
    + """SELECT instrument_id, grouping(instrument_id) = 1 AS is_total, CAST(sum(signed_base) FILTER (is_spend) AS DOUBLE) AS base, count(*) FILTER (is_spend AND base_value IS NOT NULL) AS converted_count,
    count(*) FILTER (is_spend AND base_value IS NULL) AS unconverted_count, count(*) AS members FROM live WHERE inside GROUP BY ROLLUP (instrument_id)"""
)
def a10_instrument_breakdown(spark, d):
    out = reports.instrument_breakdown(classify.classified(ledger(spark, d)), START, END, BASE)
    return out.select("instrument_id", "is_total", *_double("base"), "converted_count", "unconverted_count", "members")


@query(
    _CLASSIFIED
    + f""", s AS (SELECT instrument_id, sum(signed_base) FILTER (is_spend) AS base, count(*) AS members FROM live WHERE inside AND instrument_id IS NOT NULL GROUP BY 1),
tree AS (SELECT b.id AS bank_id, i.id AS instrument_id, s.base, s.members FROM ({_BANK}) b LEFT JOIN ({_INST}) i ON b.id = i.bank_id LEFT JOIN s ON s.instrument_id = i.id)
SELECT bank_id, instrument_id, CASE grouping(bank_id, instrument_id) WHEN 0 THEN 'instrument' WHEN 1 THEN 'bank' ELSE 'all' END AS level, CAST(sum(base) AS DOUBLE) AS base, CAST(coalesce(sum(members), 0) AS BIGINT) AS members
FROM tree GROUP BY ROLLUP (bank_id, instrument_id) HAVING grouping(bank_id, instrument_id) <> 0 OR instrument_id IS NOT NULL"""
)
def a11_bank_tree(spark, d):
    out = reports.bank_tree(classify.classified(ledger(spark, d)), view(spark, d, BANK_SQL), view(spark, d, INSTRUMENT_SQL), START, END, BASE)
    return out.select("bank_id", "instrument_id", "level", *_double("base"), "members")


@query(f"SELECT count(DISTINCT date_trunc('month', occurred_at + INTERVAL 3 HOUR)) AS months FROM ({_TX}) WHERE NOT is_deleted AND occurred_at IS NOT NULL")
def a12_months_with_data(spark, d):
    return reports.months_with_data(ledger(spark, d))


@query(
    _CLASSIFIED
    + """SELECT count(*) FILTER (needs_review) AS flagged, count(*) FILTER (category_id IS NULL) AS uncategorized, count(*) FILTER (transfer_state = 'candidate') AS transfers,
    count(*) FILTER (needs_review OR category_id IS NULL OR coalesce(transfer_state = 'candidate', FALSE)) AS needing_attention, (SELECT count(*) FROM events WHERE event_type = 'error') AS unparsed,
    count(*) FILTER (needs_review OR category_id IS NULL OR coalesce(transfer_state = 'candidate', FALSE)) + (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM live"""
)
def a13_review_counts(spark, d):
    return reports.review_counts(classify.classified(ledger(spark, d)), _tables(spark, d, "events").where("event_type = 'error'"))


@query(f"WITH cats(category, g, sort_order) AS (VALUES {_CATEGORY_ROWS}) SELECT category, count(t.id) AS n FROM cats LEFT JOIN ({_TX}) t ON t.category_id = category GROUP BY 1")
def a14_usage_by_category(spark, d):
    used = ledger(spark, d).groupBy("category_id").agg(F.count("*").alias("n"))
    return categories(spark).select(F.col("id").alias("category_id")).join(used, "category_id", "left").select(F.col("category_id").alias("category"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT g AS group_key, max(sort_order) AS last FROM (VALUES {_CATEGORY_ROWS}) c(category, g, sort_order) GROUP BY 1")
def a16_last_sort_order(spark, d):
    return categories(spark).groupBy("group_key").agg(F.max("sort_order").alias("last"))


_MONTHLY = _CLASSIFIED + """, months AS (SELECT date_trunc('month', occurred_at + INTERVAL 3 HOUR) AS month, sum(signed_base) FILTER (is_spend) AS base, count(*) FILTER (is_spend AND base_value IS NULL) AS unconverted FROM live WHERE occurred_at IS NOT NULL GROUP BY 1)
"""


@query(_MONTHLY + "SELECT month, CAST(base AS DOUBLE) AS spend, CAST(lag(base) OVER (ORDER BY month) AS DOUBLE) AS previous, CAST(coalesce(base, 0) - lag(coalesce(base, 0)) OVER (ORDER BY month) AS DOUBLE) AS difference FROM months")
def w2_month_over_month(spark, d):
    return reports.month_over_month(classify.classified(ledger(spark, d)), BASE).select("month", *_double("spend", "previous", "difference"))


@query(
    _MONTHLY
    + """, trail AS (SELECT m.month, base FROM (SELECT unnest(generate_series(TIMESTAMP '1996-05-01', TIMESTAMP '1996-07-01', INTERVAL 1 MONTH)) AS month) m LEFT JOIN months USING (month))
SELECT month, CAST(base AS DOUBLE) AS base, CASE WHEN base IS NULL THEN 0 ELSE CAST(greatest(1, least(100, round(abs(base) * 100.0 / max(abs(base)) OVER ()))) AS BIGINT) END AS weight FROM trail"""
)
def w1_month_trail(spark, d):
    out = reports.month_trail(classify.classified(ledger(spark, d)), BASE, datetime(1996, 7, 1))
    return out.select("month", *_double("base"), "weight")


@query(f"SELECT id, occurred_at FROM ({_TX}) WHERE NOT is_deleted ORDER BY occurred_at DESC NULLS LAST, id DESC LIMIT 5")
def o3_recent(spark, d):
    return reports.recent(ledger(spark, d)).select("id", "occurred_at")


@query(f"SELECT id, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, id DESC) AS place FROM ({_TX}) WHERE NOT is_deleted")
def o1_ledger_order(spark, d):
    live = ledger(spark, d).where(filters.LIVE).select("id", "occurred_at")
    return lineage.numbered(live, F.col("occurred_at").desc_nulls_last(), F.desc("id"), name="place").select("id", "place")


@query(f"SELECT id, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, id DESC) AS place FROM ({_TX}) WHERE NOT is_deleted AND needs_review")
def o2_review_order(spark, d):
    rows = filters.needing_review(ledger(spark, d)).select("id", "occurred_at")
    return lineage.numbered(rows, F.col("occurred_at").desc_nulls_last(), F.desc("id"), name="place").select("id", "place")


@query("SELECT event_id, page FROM (SELECT event_id, 1 AS page, row_number() OVER (ORDER BY event_id) AS r FROM events WHERE event_id > 0) WHERE r <= 100 UNION ALL SELECT event_id, 2 FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events WHERE event_id > 0) WHERE r BETWEEN 101 AND 200")
def o6_pages(spark, d):
    rows = _tables(spark, d, "events").select("event_id")
    first = messages.read_since(rows, 0, 100, "event_id")
    last = messages.high_water_mark(first.withColumn("at", F.lit(0)), "event_id", "at").first()["last_id"]
    second = messages.read_since(rows, last, 100, "event_id")
    return first.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2)))


# --- scalar functions ----------------------------------------------------------------------------


@query(_CLASSIFIED + "SELECT id, class, class_reason, class_review FROM c")
def n11_classification(spark, d):
    return classify.classified(ledger(spark, d)).select("id", "class", "class_reason", "class_review")


@query(_CLASSIFIED + "SELECT id, CAST(base_value AS DOUBLE) AS value, basis, CAST(fee_base AS DOUBLE) AS fee FROM c")
def n5_base_currency(spark, d):
    rows = ledger(spark, d).select("id", money.base_amount(BASE).alias("b"), money.base_amount(BASE, "fee_amount", "fee_currency", converted=False)["value"].cast("double").alias("fee"))
    return rows.select("id", F.col("b.value").cast("double").alias("value"), F.col("b.basis").alias("basis"), "fee")


@query(f"""WITH t AS ({_TX}) SELECT id, CASE WHEN currency = '{BASE}' THEN NULL WHEN fx_rate > 0 THEN 'sms_stated' WHEN converted_currency = '{BASE}' THEN 'sms_implied' END AS source,
    currency <> '{BASE}' AND coalesce(fx_rate, 0) <= 0 AND converted_currency IS NULL AS pending, CASE WHEN fx_rate > 0 AND currency <> '{BASE}' THEN CAST(fx_rate AS DOUBLE) WHEN converted_currency IS NOT NULL AND currency <> '{BASE}' THEN 3.75 END AS rate FROM t""")
def n8_fx_recording(spark, d):
    rows = ledger(spark, d).select("id", money.fx_recording(BASE).alias("f"))
    return rows.select("id", F.col("f.source").alias("source"), F.col("f.pending").alias("pending"), F.col("f.rate").cast("double").alias("rate"))


@query(f"SELECT id, CAST(trunc(amount * CASE currency WHEN 'KWD' THEN 1000 ELSE 100 END) AS BIGINT) AS minor FROM ({_TX})")
def n2_minor_units(spark, d):
    return ledger(spark, d).select("id", money.minor_units(F.col("amount"), F.col("currency")).alias("minor"))


@query(f"SELECT id, CASE WHEN category_source = 'user' THEN 'user_chosen' WHEN category_confidence IS NULL OR category_confidence <= 0 THEN 'none' WHEN category_confidence >= 0.85 THEN 'confident' ELSE 'low' END AS band FROM ({_TX})")
def n13_confidence_band(spark, d):
    return ledger(spark, d).select("id", money.confidence_band(F.col("category_source"), F.col("category_confidence")).alias("band"))


@query("SELECT event_id, date_trunc('month', ts + INTERVAL 3 HOUR) AS month FROM events")
def n12_local_month(spark, d):
    return _tables(spark, d, "events").select("event_id", money.local_month(F.col("ts")).alias("month"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(CAST(CAST(s_acctbal AS DECIMAL(20,4)) AS STRING), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS canonical FROM supplier")
def n1_canonical_amount(spark, d):
    return _tables(spark, d, "supplier").select("s_suppkey", money.canonical(F.col("s_acctbal").cast("decimal(20,4)")).alias("canonical"))


@query("SELECT doc_id, md5(trim(translate(text, ',', ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS numerals FROM documents")
def x1_numerals(spark, d):
    return _tables(spark, d, "documents").select("doc_id", F.md5(text.normalize_numerals(F.col("text")).cast("binary")).alias("numerals"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized FROM documents")
def x2_normalize(spark, d):
    return _tables(spark, d, "documents").select("doc_id", F.md5(text.normalize_message(F.col("text")).cast("binary")).alias("normalized"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || ' ' || CAST(p_partkey AS STRING) ELSE upper(p_name) END AS merchant_key FROM part")
def x5_merchant_key(spark, d):
    n = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("-", "p_name", n)).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_name"), F.lit(" Store #"), n)).otherwise(F.concat(F.col("p_name"), F.lit(" "), n, F.lit(" BRANCH LLC")))
    return _tables(spark, d, "part").select("p_partkey", text.merchant_key(raw).alias("merchant_key"))


@query("SELECT event_id, CASE WHEN length(CAST(event_id * 7919 AS STRING)) >= 4 THEN '****' || right(CAST(event_id * 7919 AS STRING), 4) END AS masked FROM events")
def x8_mask(spark, d):
    return _tables(spark, d, "events").select("event_id", text.mask_last4((F.col("event_id") * 7919).cast("string")).alias("masked"))


@query("SELECT s_suppkey, CAST(s_nationkey AS STRING) || ':card:' || right(regexp_replace(s_name, '[^0-9]', '', 'g'), 4) AS ref_key FROM supplier")
def x10_ref_key(spark, d):
    return _tables(spark, d, "supplier").select("s_suppkey", text.instrument_ref_key(F.col("s_nationkey"), F.lit("card"), F.col("s_name")).alias("ref_key"))


@query()
def x11_sanitize(spark, d):
    rows = _tables(spark, d, "documents").select("doc_id", sanitize.sanitize(F.col("text")).alias("s"))
    return rows.select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("digest"), F.col("s.pan_redacted").alias("pan_redacted"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) END AS parsed FROM events")
def x12_dates(spark, d):
    shown = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yy HH:mm")).otherwise("31/02/24 10:00")
    return _tables(spark, d, "events").select("event_id", text.sms_date(shown, "dd/MM/yy HH:mm").cast("timestamp_ntz").alias("parsed"))


_PAD = lambda x: "'" + "".join(f"\\x{(b ^ x):02X}" for b in b"test key".ljust(64, b"\0")) + "'::BLOB"
_HMAC = f"sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || {{message}})))"
_PLAIN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_MESSAGE = f"encode('v1') || '\\x00'::BLOB || encode(coalesce({_PLAIN.format('html')}, '')) || '\\x00'::BLOB || encode(lower(coalesce({_PLAIN.format('url')}, '')))"


@query(f"SELECT page_id, {_HMAC.format(message=_MESSAGE)} AS hmac FROM pages")
def x13_content_hmac(spark, d):
    return _tables(spark, d, "pages").select("page_id", hashing.content_hmac(b"test key", text.normalize_message(F.col("html")), F.col("url")).alias("hmac"))


@query("SELECT item_id, CASE WHEN n = 0 THEN 0.0 ELSE CAST(low AS DOUBLE) / n END AS jaccard FROM (SELECT item_id, count(*) AS n, count(*) FILTER (shared) AS low FROM (SELECT item_id, t, count(DISTINCT side) = 2 AS shared FROM (SELECT item_id, 'a' AS side, unnest(string_split(text, ' ')) AS t FROM benchmark UNION ALL SELECT item_id, 'b', unnest(list_filter(string_split(text, ' '), lambda w: length(w) > 4)) FROM benchmark) GROUP BY ALL) GROUP BY 1)")
def e1_jaccard(spark, d):
    words = F.array_distinct(F.split("text", " "))
    return _tables(spark, d, "benchmark").select("item_id", similarity.multiset_jaccard(words, F.filter(words, lambda w: F.char_length(w) > 4)).alias("jaccard"))


@query()
def e3_edit_ratio(spark, d):
    return _tables(spark, d, "part").select("p_partkey", similarity.edit_ratio(F.col("p_name"), F.concat("p_brand", "p_name")).alias("ratio"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS STRING) END AS amount FROM events")
def r6_partial_codec(spark, d):
    k = F.get_json_object("props", "$.k")
    coded = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).alias("v"), k.alias("amount"), F.lit("SAR").alias("currency")))
    return _tables(spark, d, "events").select("event_id", rule_pack.read_partial(coded)["amount"].alias("amount"))


def _event_messages(spark, d):
    body = F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("decimal(20,2)").cast("string"), F.lit(" SAR k="), F.get_json_object("props", "$.k"))
    return _tables(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("address"), body.alias("body"))


_PACK = rule_pack.load_pack(
    r"""{"schemaVersion": 1, "packId": "events", "packVersion": "1", "banks": [{"bankId": "bank", "displayName": {"en": "Bank"}, "aliases": [], "senderPatterns": ["^[0-9]+$"], "messageRules": [
    {"ruleId": "view", "priority": 50, "messageType": "info", "intent": "ignore", "match": {"anyOf": ["^view"]}},
    {"ruleId": "buy", "priority": 100, "messageType": "pos_purchase", "intent": "transaction", "match": {"anyOf": ["^purchase"]}, "regex": "purchase (?<amount>[0-9.]+) (?<currency>[A-Z]{3})(?: k=(?<k>[0-9]{2}))?$",
     "extract": {"amount": {"group": "amount"}, "currency": {"group": "currency"}, "referenceNumber": {"group": "k"}}, "sign": "debit", "requiredFields": ["amount", "referenceNumber"]}]}]}"""
)


@query(
    """WITH e AS (SELECT event_id, event_type, CAST(CAST(value AS DECIMAL(20,2)) AS STRING) AS v, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN 'ignored' WHEN event_type <> 'purchase' THEN 'unparsed' WHEN length(k) = 2 THEN 'parsed' ELSE 'unparsed' END AS outcome,
    CASE WHEN event_type = 'view' THEN NULL WHEN event_type <> 'purchase' THEN 'no_rule_matched' WHEN length(k) = 2 THEN NULL ELSE 'extraction_failed' END AS reason,
    CASE WHEN event_type = 'purchase' AND length(k) = 2 THEN CAST(v AS DOUBLE) END AS amount FROM e"""
)
def r2_extraction(spark, d):
    p = rule_pack.parse_messages(_event_messages(spark, d), _PACK)
    return p.select("event_id", F.col("parsed.outcome").alias("outcome"), F.col("parsed.reason").alias("reason"), F.when(F.col("parsed.outcome") == "parsed", F.col("parsed.amount").cast("double")).alias("amount"))


# --- changes -------------------------------------------------------------------------------------


@query(f"SELECT id, CASE WHEN id % 10 = 3 THEN 'dining' ELSE category_id END AS category_id, CASE WHEN id % 10 = 3 THEN 'user' ELSE category_source END AS category_source, CASE WHEN id % 10 = 3 AND review_reason = 'low_confidence' THEN FALSE ELSE needs_review END AS needs_review FROM ({_TX})")
def u1_user_category(spark, d):
    tx = ledger(spark, d)
    out = mutations.set_category_by_user(tx, tx.where("id % 10 = 3").select("id", F.lit("dining").alias("category_id")))
    return out.select("id", "category_id", "category_source", "needs_review")


@query(f"SELECT id, CASE WHEN id % 10 IN (0, 1) AND coalesce(category_source, '') <> 'user' THEN 'dining' ELSE category_id END AS category_id, needs_review OR (id % 10 IN (0, 1) AND coalesce(category_source, '') <> 'user') AS needs_review, CASE WHEN id % 10 IN (0, 1) AND coalesce(category_source, '') <> 'user' THEN coalesce(review_reason, 'low_confidence') ELSE review_reason END AS review_reason FROM ({_TX})")
def u2_automatic_category(spark, d):
    tx = ledger(spark, d)
    changes = tx.where("id % 10 IN (0, 1)").select("id", F.lit("dining").alias("category_id"), F.lit(1).cast("bigint").alias("rule_id"), F.lit(0.7).alias("confidence"), F.lit("low_confidence").alias("reason"))
    return mutations.set_category_automatically(tx, changes).select("id", "category_id", "needs_review", "review_reason")


@query(f"SELECT id, is_deleted OR id % 6 = 1 AS is_deleted FROM ({_TX})")
def u3_soft_delete(spark, d):
    tx = ledger(spark, d)
    return mutations.soft_delete(tx, tx.where("id % 6 = 1").select("id"), datetime(2026, 7, 1)).select("id", "is_deleted")


@query(f"SELECT id, CASE WHEN id % 4 = 1 THEN 'NEW' ELSE merchant_text END AS merchant_text, CASE WHEN id % 4 = 1 THEN 'merchant_text' ELSE '' END AS edited FROM ({_TX})")
def u4_user_edit(spark, d):
    tx = ledger(spark, d)
    edits = tx.where("id % 4 = 1").withColumns({"merchant_text": F.lit("NEW"), "set": F.array(F.lit("merchant_text"), F.lit("type"))})
    return mutations.edit(tx, edits).select("id", "merchant_text", F.array_join(F.coalesce("user_edited", F.array().cast("array<string>")), ",").alias("edited"))


@query(
    f"""WITH t AS ({_TX}), p AS (SELECT s.id AS survivor_id, m.id AS merged_id, s.is_deleted OR m.is_deleted AS dead, s.amount <> m.amount OR s.currency <> m.currency AS money, s.direction IS DISTINCT FROM m.direction AS dir, s.type <> m.type AS kind
    FROM t s JOIN t m ON m.id = s.id + 13 WHERE s.id % 13 = 0)
SELECT survivor_id, merged_id, CASE WHEN dead THEN 'not_live' WHEN money THEN 'amount_differs' WHEN dir THEN 'direction_differs' WHEN kind THEN 'type_differs' END AS refusal FROM p"""
)
def u5_merge_refusals(spark, d):
    tx = ledger(spark, d)
    return merge.assess(tx.where("id % 13 = 0").select(F.col("id").alias("survivor_id"), (F.col("id") + 13).alias("merged_id")), tx)


@query(f"SELECT id, coalesce(category_id, CASE WHEN NOT is_deleted AND merchant_id = 7 AND coalesce(category_source, '') <> 'user' THEN 'dining' END) AS category_id FROM ({_TX})")
def u11_fill_siblings(spark, d):
    return mutations.fill_siblings(ledger(spark, d), 7, "dining").select("id", "category_id")


@query("SELECT n_nationkey AS id, n_name AS canonical_key FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY c_mktsegment), c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def u8_get_or_create(spark, d):
    banks = _tables(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("canonical_key"), F.lit(None).cast("string").alias("source"))
    wanted = _tables(spark, d, "customer").select(F.col("c_mktsegment").alias("canonical_key"), F.lit("sms").alias("source"))
    return mutations.get_or_create(banks, wanted, "canonical_key", ("source",)).select("id", "canonical_key")


@query(f"SELECT id, nullif(nullif(category_id, 'dining'), '') AS category_id FROM ({_TX})")
def u10_delete_category(spark, d):
    _, _, rules = _merchant_tables(spark, d)
    return mutations.delete_category(ledger(spark, d), rules, categories(spark), "dining")[0].select("id", "category_id")


def _entries(spark, d):
    s = _tables(spark, d, "supplier")
    change = F.to_json(F.array(F.struct(F.lit("name").alias("field"), F.col("s_name").alias("from"), F.lit("x").alias("to"))))
    return s.select(F.col("s_suppkey").alias("seq"), F.lit("bank").alias("entity_type"), F.col("s_nationkey").cast("string").alias("entity_id"), F.lit("update").alias("action"), F.lit("user").alias("actor"), F.lit(None).cast("string").alias("actor_detail"), F.lit(datetime(2026, 7, 1)).alias("changed_at"), change.alias("field_changes"))


_AUDIT_PAD = lambda x: "'" + "".join(f"\\x{(b ^ x):02X}" for b in b"audit key".ljust(64, b"\0")) + "'::BLOB"


@query(
    f"""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, '{{"entityType":"bank","entityId":"' || CAST(s_nationkey AS VARCHAR)
    || '","action":"update","actor":"user","actorDetail":null,"changedAt":"2026-07-01T00:00:00.000Z","fieldChanges":[{{"field":"name","from":"' || s_name || '","to":"x"}}]}}' AS payload FROM supplier),
chain(id, entry_hash) AS (SELECT CAST(0 AS BIGINT), 'GENESIS' UNION ALL SELECT e.id, sha256({_AUDIT_PAD(0x5C)} || unhex(sha256({_AUDIT_PAD(0x36)} || encode(c.entry_hash || '|' || e.payload)))) FROM chain c JOIN e ON e.id = c.id + 1)
SELECT id, entry_hash, TRUE AS linked, TRUE AS intact FROM chain WHERE id > 0"""
)
def w3_audit_chain(spark, d):
    log = audit.append(_entries(spark, d), b"audit key")
    return log.select("id", "entry_hash").join(audit.verify(log, b"audit key"), "id")


@query("SELECT CAST(s_nationkey AS STRING) AS entity_id, 'name' AS field, arg_min(s_name, s_suppkey) AS original FROM supplier GROUP BY 1")
def a19_original_values(spark, d):
    return mutations.original_values(_entries(spark, d).withColumn("id", F.col("seq")))


# --- further operators of the inventory ------------------------------------------------------------


@query("SELECT * FROM (VALUES ('bank', 0, 'buy', 100, 'pos_purchase', 'transaction'), ('bank', 1, 'view', 50, 'info', 'ignore')) r(bank_id, place, rule_id, priority, message_type, intent)")
def s6_rule_pack(spark, d):
    return rule_pack.rules_table(spark, _PACK)


_MESSAGES = "SELECT event_id AS id, ts AS received_at, CASE event_type WHEN 'error' THEN 'financial_unparsed' WHEN 'purchase' THEN 'financial_parsed' ELSE 'ignored' END AS classification, event_id % 7 = 0 AS dismissed_as_not_transaction FROM {events}"
_PENDING = f"SELECT * FROM ({_MESSAGES.format(events='events')}) WHERE classification = 'financial_unparsed' AND NOT dismissed_as_not_transaction"
_CUTOFF = datetime(2024, 1, 15)


@query(f"SELECT id FROM ({_PENDING})")
def f4_review_queue(spark, d):
    return view(spark, d, _MESSAGES).where(filters.PENDING_REVIEW).select("id")


@query(f"SELECT count(*) AS waiting FROM ({_PENDING}) WHERE received_at < TIMESTAMP '2024-01-15'")
def f5_review_before(spark, d):
    return filters.review_before(view(spark, d, _MESSAGES), _CUTOFF).agg(F.count("*").alias("waiting"))


@query(f"SELECT id FROM ({_MESSAGES.format(events='events')}) EXCEPT ALL SELECT id FROM ({_PENDING}) WHERE received_at < TIMESTAMP '2024-01-15'")
def u14_discard_review(spark, d):
    return mutations.discard_review(view(spark, d, _MESSAGES), _CUTOFF)[0].select("id")


@query(f"SELECT id, occurred_at, review_reason FROM ({_TX}) WHERE needs_review AND NOT is_deleted")
def f6_needing_review(spark, d):
    return filters.needing_review(ledger(spark, d)).select("id", "occurred_at", "review_reason")


@query(f"SELECT id, merchant_text, category_id FROM ({_TX}) WHERE instrument_id = 7 AND NOT is_deleted")
def f7_of_instrument(spark, d):
    return ledger(spark, d).where(filters.LIVE).where("instrument_id = 7").select("id", "merchant_text", "category_id")


def _merged(spark, d):
    """Rows whose id is 1 to 3 more than a multiple of 4 are absorbed by that one."""
    survivor = F.floor(F.col("id") / 4) * 4
    absorbed = F.col("id") % 4 != 0
    return ledger(spark, d).withColumns({"merged_into": F.when(absorbed, survivor).cast("bigint"), "is_deleted": absorbed, "deleted_at": F.when(absorbed, F.timestamp_seconds(F.col("id") % 3))})


@query(f"SELECT id, row_number() OVER (ORDER BY id % 3 DESC, id DESC) AS place FROM ({_TX}) WHERE id % 4 <> 0 AND id // 4 = 8")
def f10_absorbed(spark, d):
    from pyspark.sql import Window

    rows = mutations.absorbed_by(_merged(spark, d), 32)
    return rows.select("id", F.row_number().over(Window.partitionBy("merged_into").orderBy(F.desc("deleted_at"), F.desc("id"))).alias("place"))


@query(f"SELECT id // 4 * 4 AS id, arg_max(id, id % 3 * 1000000000000 + id) AS latest FROM ({_TX}) WHERE id % 4 <> 0 GROUP BY 1")
def w5_latest_absorbed(spark, d):
    rows = _merged(spark, d).where("merged_into IS NOT NULL AND is_deleted")
    return rows.groupBy(F.col("merged_into").alias("id")).agg(F.max_by("id", F.struct("deleted_at", "id")).alias("latest"))


@query(f"SELECT category, g AS group_key, sort_order AS place FROM (VALUES {_CATEGORY_ROWS}) c(category, g, sort_order)")
def o5_category_order(spark, d):
    return categories(spark).orderBy("sort_order", "id").select(F.col("id").alias("category"), "group_key", F.col("sort_order").alias("place"))


@query(_CLASSIFIED + f", cats(category, g, sort_order) AS (VALUES {_CATEGORY_ROWS}), parts AS (SELECT coalesce(category, 'uncategorized') AS k, sum(signed_base) AS x FROM live LEFT JOIN cats ON category = category_id WHERE inside AND is_spend GROUP BY 1) SELECT CAST((SELECT sum(x) FROM parts) AS DOUBLE) AS slices, CAST(sum(signed_base) AS DOUBLE) AS total, (SELECT sum(x) FROM parts) = sum(signed_base) AS reconciles FROM live WHERE inside AND is_spend")
def a8_categories_reconcile(spark, d):
    rows = classify.classified(ledger(spark, d))
    out = reports.category_reconciles(reports.category_breakdown(rows, categories(spark), START, END, BASE), reports.period_report(rows, START, END, BASE))
    return out.select(*_double("slices", "total"), "reconciles")


@query(_CLASSIFIED + ", parts AS (SELECT instrument_id, sum(signed_base) AS x FROM live WHERE inside AND is_spend GROUP BY 1) SELECT CAST((SELECT sum(x) FROM parts) AS DOUBLE) AS slices, CAST(sum(signed_base) AS DOUBLE) AS total, (SELECT sum(x) FROM parts) = sum(signed_base) AS reconciles FROM live WHERE inside AND is_spend")
def a10_instruments_reconcile(spark, d):
    out = reports.instruments_reconcile(reports.instrument_breakdown(classify.classified(ledger(spark, d)), START, END, BASE))
    return out.select(*_double("slices", "total"), "reconciles")


@query(f"SELECT count(*) FILTER ({_PERIOD} AND coalesce(category_id, 'no_such_category') = 'no_such_category') AS uncategorized FROM ({_TX}) WHERE NOT is_deleted")
def a9_uncategorized(spark, d):
    rows = reports.resolved_category(ledger(spark, d).where(filters.LIVE).where(filters.in_period(START, END)), categories(spark))
    return rows.agg(F.count_if(F.col("category") == "uncategorized").alias("uncategorized"))


@query(f"SELECT currency, CAST(sum(amount) AS DOUBLE) AS total FROM ({_TX}) GROUP BY currency")
def a15_money_sum(spark, d):
    return ledger(spark, d).groupBy("currency").agg(money.money_sum(F.col("amount"), F.col("currency")).cast("double").alias("total"))


_FEED_PACK = rule_pack.load_pack(
    r"""{"schemaVersion": 1, "packId": "feed", "packVersion": "1", "banks": [{"bankId": "bank", "displayName": {"en": "Bank"}, "aliases": [], "senderPatterns": ["^[0-9]*[1-9]$"], "messageRules": [
    {"ruleId": "view", "priority": 50, "messageType": "info", "intent": "ignore", "match": {"anyOf": ["^view"]}},
    {"ruleId": "buy", "priority": 100, "messageType": "pos_purchase", "intent": "transaction", "match": {"anyOf": ["^purchase", "^error"]}, "regex": "(?:purchase|error) (?<amount>[0-9.-]+) (?<currency>[A-Z]{3}) on (?<card>[0-9]{4})(?: of (?<network>[a-z]+))? at (?<shop>shop [0-9]+)(?: rate (?<rate>[0-9.]+))?(?: from (?<account>[0-9]{4}))?$",
     "extract": {"amount": {"group": "amount"}, "currency": {"group": "currency"}, "instrumentRef": {"group": "card", "kind": "card", "maskPolicy": "last4"}, "instrumentRefNetwork": {"group": "network"}, "settlementRef": {"group": "account", "kind": "account", "maskPolicy": "last4"}, "exchangeRate": {"group": "rate"}, "merchant": {"group": "shop"}}, "sign": "debit", "requiredFields": ["amount"]}]}]}"""
)
# a feed of messages, with amounts so coarse that some repeat, foreign ones with and without a rate, and cards that name their account
_FEED = """SELECT event_id AS provider_id, CAST(user_id % 10 AS STRING) AS address, ts AS received_at,
    event_type || ' ' || CAST(CASE WHEN event_id % 31 = 0 THEN -1 ELSE 1 END * CAST(floor(value / 10) AS BIGINT) AS STRING) || CASE WHEN event_id % 37 = 0 THEN ' riyal' WHEN event_id % 19 = 0 THEN ' USD' ELSE ' SAR' END
    || ' on ' || CAST(1000 + user_id % 50 AS STRING) || CASE WHEN event_id % 23 = 0 THEN ' of visa' WHEN event_id % 29 = 0 THEN ' of mada' ELSE '' END || ' at shop ' || CAST(CAST(floor(value / 25) AS BIGINT) AS STRING)
    || CASE WHEN event_id % 57 = 0 THEN ' rate 3.7512' ELSE '' END || CASE WHEN event_id % 43 = 0 THEN ' from ' || CAST(7000 + event_id % 3 AS STRING) ELSE '' END
    AS body FROM {events}"""


def _feed_batches(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events as messages, in two halves."""
    rows = view(spark, d, _FEED).withColumn("received_at", F.date_trunc("hour", "received_at").cast("timestamp")).select("provider_id", "address", "body", "received_at")
    half = rows.agg(F.expr("CAST(floor(max(provider_id) / 2) AS BIGINT)").alias("h")).first()["h"]
    return rows.where(F.col("provider_id") <= half), rows.where(F.col("provider_id") > half)


def _ingested(spark, d):
    """The feed, written batch by batch into a folder of its own."""
    from ..streaming.ingest import Ingest

    job = Ingest(f"{lineage.shared_dir(spark)}/feed-{uuid.uuid4().hex}", _FEED_PACK, b"feed key")
    for n, batch in enumerate(_feed_batches(spark, d)):
        job.write(batch, n, "feed")
    return job


_FED = f"""WITH f AS (SELECT provider_id AS id, address, body, date_trunc('hour', received_at) AS at, provider_id <= (SELECT floor(max(event_id) / 2) FROM events) AS early FROM ({_FEED.format(events='events')})),
n AS (SELECT *, address <> '0' AS known, row_number() OVER (PARTITION BY address, body ORDER BY id) AS r, CASE WHEN starts_with(body, 'view') THEN 'ignored' WHEN NOT regexp_matches(body, '^(purchase|error) [0-9]+ (SAR|USD)') THEN 'review' ELSE 'transaction' END AS kind, regexp_extract(body, ' ([0-9]+) (SAR|USD)', 1) AS amount, regexp_extract(body, ' (SAR|USD)', 1) AS currency, regexp_extract(body, ' on ([0-9]{{4}})', 1) AS card, regexp_extract(body, ' at (shop [0-9]+)', 1) AS shop,
    nullif(regexp_extract(body, ' of ([a-z]+)', 1), '') AS network, nullif(regexp_extract(body, ' from ([0-9]{{4}})', 1), '') AS account, CAST(nullif(regexp_extract(body, ' rate ([0-9.]+)', 1), '') AS DOUBLE) AS rate FROM f),
t AS (SELECT * FROM n WHERE known AND r = 1 AND kind = 'transaction'),
dup AS (SELECT i.id, min(e.id) AS duplicate_of FROM t i JOIN t e ON i.amount = e.amount AND i.currency = e.currency AND i.card = e.card AND i.shop = e.shop AND e.id < i.id AND abs(epoch(i.at) - epoch(e.at)) <= 900 GROUP BY 1),
fed AS (SELECT n.id AS provider_id, CASE WHEN NOT known THEN 'not_financial' WHEN r > 1 THEN 'duplicate' WHEN kind <> 'transaction' THEN kind WHEN duplicate_of IS NOT NULL THEN 'flagged' ELSE kind END AS outcome, CASE WHEN known AND r = 1 THEN duplicate_of END AS duplicate_of FROM n LEFT JOIN dup USING (id)),
named AS (SELECT id AS seen, 0 AS role, 'card' AS kind, card AS digits, network, currency FROM t UNION ALL SELECT id, 1, 'account', account, NULL, NULL FROM t WHERE account IS NOT NULL),
keyed AS (SELECT kind, digits, min(seen * 2 + role) AS place, min(seen) AS first_seen, arg_min(network, seen) FILTER (network IS NOT NULL) AS network, arg_min(currency, seen) FILTER (currency IS NOT NULL) AS currency FROM named GROUP BY ALL),
instruments AS (SELECT *, row_number() OVER (ORDER BY place) AS id FROM keyed)
"""


@query(_FED + "SELECT outcome, count(*) AS n FROM fed GROUP BY 1")
def a18_run_counters(spark, d):
    return _ingested(spark, d).counters(spark)


@query(_FED + "SELECT provider_id, outcome, duplicate_of FROM fed WHERE outcome NOT IN ('duplicate', 'not_financial')")
def g5_ingest_outcomes(spark, d):
    rows = _ingested(spark, d).ingested(spark)
    kind = F.when(F.col("transaction.duplicate_of").isNotNull(), "flagged").when(F.col("transaction").isNotNull(), "transaction").when(F.col("classification") == "ignored", "ignored").otherwise("review")
    return rows.select(F.col("sms_provider_id").alias("provider_id"), kind.alias("outcome"), F.col("transaction.duplicate_of").alias("duplicate_of"))


@query(
    _FED
    + """SELECT provider_id, CAST(amount AS DOUBLE) AS amount, t.currency, '****' || card AS masked_ref, shop AS merchant_text, t.at AS occurred_at, 'received' AS time_source, i.id AS instrument_id,
    CASE WHEN t.currency <> 'SAR' THEN rate END AS fx_rate, CASE WHEN t.currency <> 'SAR' AND rate IS NOT NULL THEN 'sms_stated' END AS fx_rate_source, t.currency <> 'SAR' AND rate IS NULL AS conversion_pending
FROM fed JOIN t ON t.id = provider_id JOIN instruments i ON i.kind = 'card' AND i.digits = t.card"""
)
def g10_ingested_transactions(spark, d):
    rows = _ingested(spark, d).ingested(spark).where("transaction IS NOT NULL").select(F.col("sms_provider_id").alias("provider_id"), "transaction.*")
    return rows.select("provider_id", *_double("amount"), "currency", "masked_ref", "merchant_text", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "time_source", "instrument_id", F.col("fx_rate").cast("double").alias("fx_rate"), "fx_rate_source", "conversion_pending")


@query(
    _FED
    + """, v AS (SELECT date_trunc('month', t.at + INTERVAL 3 HOUR) AS month, currency, CAST(amount AS DECIMAL(20,4)) AS amount, CASE WHEN currency = 'SAR' THEN CAST(amount AS DECIMAL(20,4)) ELSE round(CAST(amount AS DECIMAL(20,4)) * CAST(rate AS DECIMAL(18,8)), 2) END AS base FROM t)
SELECT month, 'spend' AS measure, currency, CAST(sum(amount) AS DOUBLE) AS net, count(*) AS transactions, CAST(sum(base) AS DOUBLE) AS base, count(base) AS converted_count, CAST(sum(amount) FILTER (base IS NULL) AS DOUBLE) AS unconverted_net, count(*) FILTER (base IS NULL) AS unconverted FROM v GROUP BY ALL"""
)
def s9_live_totals(spark, d):
    totals = reports.merged_totals(_ingested(spark, d).totals(spark))
    return totals.select(F.col("month").cast("timestamp_ntz").alias("month"), "measure", "currency", *_double("net"), "transactions", *_double("base"), "converted_count", *_double("unconverted_net"), "unconverted")


@query(
    _FED
    + """, linked AS (SELECT card, arg_min(account, id) AS account FROM t WHERE account IS NOT NULL GROUP BY 1)
SELECT i.id, 1 AS bank_id, i.kind, '****' || i.digits AS masked, i.network, i.currency, a.id AS settlement_account_id, CASE WHEN a.id IS NOT NULL THEN 'sms_repayment' END AS link_source, i.first_seen
FROM instruments i LEFT JOIN linked l ON i.kind = 'card' AND l.card = i.digits LEFT JOIN instruments a ON a.kind = 'account' AND a.digits = l.account"""
)
def u8_instruments_at_ingest(spark, d):
    table = entities.instruments(_ingested(spark, d).instrument_log(spark))
    return table.select("id", "bank_id", "kind", "masked", "network", "currency", "settlement_account_id", "link_source", "first_seen")


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN 'groceries' END AS category_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS merchant_id,
    CASE WHEN p_partkey % 2 <> 0 THEN 'unknown_merchant' WHEN p_partkey % 3 <> 0 OR p_partkey % 7 = 0 THEN 'known_merchant_without_rule' END AS review_reason FROM part"""
)
def g9_categorised(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.md5(F.col("p_partkey").cast("string").cast("binary")))
    rows = _tables(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), name.alias("merchant_text"))
    candidates = matching.merchant_candidates(*_merchant_tables(spark, d), categories(spark))
    return categorise.categorise(with_defaults(rows), candidates).select("id", "category_id", "merchant_id", "review_reason")


@query(_CLASSIFIED + "SELECT id, CAST(round(abs(signed_base) * 100.0 / nullif(abs(amount), 0)) AS BIGINT) AS percent FROM c")
def a20_percent_share(spark, d):
    value = money.signed_for_spend(money.base_amount(BASE)["value"], F.col("direction"))
    return ledger(spark, d).select("id", money.percent_share(value, F.col("amount")).alias("percent"))


@query("SELECT doc_id, md5(upper(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'SS'))) AS folded FROM documents")
def x3_fold(spark, d):
    return _tables(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'mixed' ELSE 'arabic' END ELSE 'latin' END AS script FROM documents WHERE text IS NOT NULL")
def x6_script(spark, d):
    return _tables(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query("SELECT page_id, regexp_replace(lower(url), '[^0-9]', '', 'g') AS digits, upper(url) AS upper_url FROM pages")
def x7_transforms(spark, d):
    url = F.col("url")
    return _tables(spark, d, "pages").select("page_id", text.apply_transforms(url, ("lower", "digitsOnly")).alias("digits"), text.apply_transforms(url, ("trim", "collapseWs", "upper", "no such transform")).alias("upper_url"))


@query("SELECT s_suppkey, '•••• ' || right(s_name, 4) AS card, left(s_name, 2) || '**…' || right(s_name, 4) AS iban, regexp_replace(s_name, '[0-9]', '•', 'g') AS amount FROM supplier")
def x9_display_masks(spark, d):
    name = F.col("s_name")
    return _tables(spark, d, "supplier").select("s_suppkey", text.card_mask(name).alias("card"), text.iban_mask(name).alias("iban"), text.amount_mask(name).alias("amount"))


@query(f"SELECT id, CAST(amount + fee_amount AS DOUBLE) AS both_amounts, CAST(-amount AS DOUBLE) AS negated, amount > fee_amount AS more FROM ({_TX}) WHERE currency = fee_currency")
def n3_money_arithmetic(spark, d):
    same = ledger(spark, d).where("currency = fee_currency")
    amount, fee, codes = F.col("amount"), F.col("fee_amount"), (F.col("currency"), F.col("fee_currency"))
    return same.select("id", money.guarded(amount + fee, *codes).cast("double").alias("both_amounts"), (-amount).cast("double").alias("negated"), money.guarded(amount > fee, *codes).alias("more"))


@query(f"SELECT id, CAST(round(amount * CAST(3.75125 AS DECIMAL(18,8)), 2) AS DOUBLE) AS converted FROM ({_TX})")
def n4_convert(spark, d):
    return ledger(spark, d).select("id", money.convert(F.col("amount"), F.lit("3.75125").cast("decimal(18,8)"), BASE).cast("double").alias("converted"))


@query(f"SELECT id, CASE WHEN fx_rate IS NOT NULL THEN CAST(fx_rate AS DOUBLE) WHEN converted_amount IS NOT NULL THEN 3.75 END AS rate FROM ({_TX})")
def n7_implied_rate(spark, d):
    return ledger(spark, d).select("id", money.implied_rate().cast("double").alias("rate"))


@query(f"SELECT id, CAST(CASE WHEN direction = 'credit' THEN -amount ELSE amount END AS DOUBLE) AS signed FROM ({_TX})")
def n9_signed_for_spend(spark, d):
    return ledger(spark, d).select("id", money.signed_for_spend(F.col("amount"), F.col("direction")).cast("double").alias("signed"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'negative' END AS problem FROM supplier")
def n10_amount_problem(spark, d):
    return _tables(spark, d, "supplier").select("s_suppkey", money.amount_problem(F.col("s_acctbal").cast("decimal(20,4)").cast("string")).alias("problem"))


@query(f"SELECT id, coalesce(nullif(trim(friendly_name), ''), masked) AS shown FROM ({_INST})")
def n14_display_name(spark, d):
    return view(spark, d, INSTRUMENT_SQL).select("id", money.display_name(F.col("friendly_name"), F.col("masked")).alias("shown"))


@query("SELECT p_partkey, round(0.60 + 0.25 * ((p_size % 21 + 80) / CAST(100.0 AS DOUBLE) - 0.80) / 0.20, 6) AS confidence FROM part")
def e2_token_confidence(spark, d):
    return _tables(spark, d, "part").select("p_partkey", F.round(similarity.token_confidence((F.col("p_size") % 21 + 80) / 100.0), 6).alias("confidence"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' AND length(json_extract_string(props, '$.k')) <> 2 THEN 'extraction_failed' WHEN event_type NOT IN ('purchase', 'view') THEN 'no_rule_matched' END AS reason FROM events")
def r3_outcome_reasons(spark, d):
    return rule_pack.parse_messages(_event_messages(spark, d), _PACK).select("event_id", F.col("parsed.reason").alias("reason"))


@query(f"SELECT id, needs_review OR id % 5 = 2 AS needs_review, CASE WHEN id % 5 = 2 THEN 'possible_duplicate' ELSE review_reason END AS review_reason, CASE WHEN id % 5 = 2 THEN id + 1 END AS duplicate_of FROM ({_TX})")
def u6_flag_duplicates(spark, d):
    tx = ledger(spark, d)
    pairs = tx.where("id % 5 = 2").select("id", F.explode(F.array(F.col("id") + 2, F.col("id") + 1)).alias("other_id"))
    return mutations.flag_duplicates(tx, pairs).select("id", "needs_review", "review_reason", "duplicate_of")


@query(f"SELECT id, needs_review AND coalesce(review_reason, '') <> 'possible_duplicate' AS needs_review, CASE WHEN NOT (needs_review AND coalesce(review_reason, '') = 'possible_duplicate') THEN review_reason END AS review_reason FROM ({_TX})")
def u6_resolve_duplicates(spark, d):
    tx = ledger(spark, d)
    return mutations.resolve_duplicates(tx, tx.select("id")).select("id", "needs_review", "review_reason")


@query(f"SELECT id, CASE WHEN type = 'transfer_out' THEN 'internal' WHEN type = 'transfer_in' THEN 'external' ELSE transfer_state END AS transfer_state, CASE WHEN type = 'transfer_out' THEN 'g' END AS transfer_group, needs_review AND type NOT IN ('transfer_out', 'transfer_in') AS needs_review FROM ({_TX})")
def u7_transfer_decisions(spark, d):
    tx = ledger(spark, d)
    said = tx.where("type IN ('transfer_out', 'transfer_in')").select("id", F.when(F.col("type") == "transfer_out", "internal").otherwise("external").alias("state"), F.lit("g").alias("group_id"))
    return mutations.decide_transfers(tx, said).select("id", "transfer_state", "transfer_group", "needs_review")


_RULES = "SELECT id, id AS merchant_id, CASE WHEN id % 2 = 0 THEN 'groceries' ELSE 'gone' END AS category_id, CASE WHEN id % 5 = 0 THEN 'user' ELSE 'seed' END AS source FROM m WHERE id % 3 = 0"


@query(
    f"""WITH m AS ({_MERCHANT}), r AS ({_RULES}), last AS (SELECT max(id) AS last FROM r), n AS (SELECT id AS merchant_id, row_number() OVER (ORDER BY id) AS k FROM m WHERE id % 2 = 0 AND id % 3 <> 0)
SELECT id, merchant_id, 'dining' AS category_id, source FROM r UNION ALL SELECT last + k, merchant_id, 'dining', 'seed' FROM n, last"""
)
def u8_upsert_rules(spark, d):
    m, _, rules = _merchant_tables(spark, d)
    wanted = m.where("id % 3 = 0 OR id % 2 = 0").select(F.col("id").alias("merchant_id"), F.explode(F.array(F.lit("dining"), F.lit("no_such_category"))).alias("category_id"), F.lit("seed").alias("source"))
    return mutations.upsert_rules(rules, wanted, categories(spark)).select("id", "merchant_id", "category_id", "source")


@query(
    f"""WITH m AS ({_MERCHANT}), w AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 5 = 0 THEN 'SHOP ' || CAST(id // 10 * 4 AS STRING) ELSE 'KIOSK ' || CAST(id // 3 AS STRING) END AS k FROM m),
held AS (SELECT 'SHOP ' || CAST(id AS STRING) AS k FROM m WHERE id % 4 = 0)
SELECT id AS merchant_id, CASE WHEN k IS NULL THEN 'no_key' WHEN k IN (SELECT k FROM held) OR row_number() OVER (PARTITION BY k ORDER BY id) > 1 THEN 'clash' ELSE 'linked' END AS status FROM w"""
)
def u8_link_aliases(spark, d):
    m, aliases, _ = _merchant_tables(spark, d)
    n = F.col("id")
    told = F.when(n % 6 == 0, " ").when(n % 5 == 0, F.concat(F.lit("Shop "), (F.floor(n / 10) * 4).cast("string"))).otherwise(F.concat(F.lit("kiosk  "), F.floor(n / 3).cast("string")))
    return mutations.link_aliases(aliases, m.select(n.alias("n"), n.alias("merchant_id"), told.alias("text")))[1].select("merchant_id", "status")


def _choices(tx: DataFrame) -> DataFrame:
    n = F.col("id")
    category = F.when(n % 9 == 0, "uncategorized").when(n % 27 == 1, "no_such_category").when(n % 2 == 0, "dining").otherwise("utilities_bills")
    return tx.where("id % 3 <> 2").select("id", category.alias("category_id"), (n % 5 != 0).alias("learn"))


@query(
    f"""WITH t AS ({_TX}), m AS ({_MERCHANT}), r AS ({_RULES}), c AS (SELECT id, merchant_id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 27 = 1 THEN 'no_such_category' WHEN id % 2 = 0 THEN 'dining' ELSE 'utilities_bills' END AS category_id, id % 5 <> 0 AS learn FROM t WHERE id % 3 <> 2),
w AS (SELECT merchant_id, arg_max(category_id, id) AS category_id FROM c WHERE learn AND category_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY 1), good AS (SELECT * FROM w WHERE category_id <> 'no_such_category'),
n AS (SELECT merchant_id, category_id, row_number() OVER (ORDER BY merchant_id) AS k FROM good WHERE merchant_id NOT IN (SELECT merchant_id FROM r))
SELECT r.id, merchant_id, coalesce(g.category_id, r.category_id) AS category_id, CASE WHEN g.category_id IS NOT NULL THEN 'user' ELSE source END AS source FROM r LEFT JOIN good g USING (merchant_id)
UNION ALL SELECT (SELECT max(id) FROM r) + k, merchant_id, category_id, 'user' FROM n"""
)
def u12_learnt_rules(spark, d):
    tx = ledger(spark, d)
    m, _, rules = _merchant_tables(spark, d)
    return mutations.learn_from_choices(tx, m.select("id", "merchant_key"), rules, categories(spark), _choices(tx))[2].select("id", "merchant_id", "category_id", "source")


@query(
    f"""WITH t AS ({_TX}), m AS ({_MERCHANT}), k AS (SELECT id, upper(split_part(merchant_text, ' Store', 1)) || ' STORE' AS k FROM t WHERE id % 3 <> 2 AND id % 4 = 0),
n AS (SELECT k, row_number() OVER (ORDER BY k) + (SELECT max(id) FROM m) AS merchant_id FROM (SELECT DISTINCT replace(k, '-', ' ') AS k FROM k))
SELECT t.id, CASE WHEN t.id % 4 = 0 THEN n.merchant_id ELSE t.merchant_id END AS merchant_id FROM t LEFT JOIN k USING (id) LEFT JOIN n ON n.k = replace(k.k, '-', ' ')"""
)
def u12_merchants_of_choices(spark, d):
    tx = ledger(spark, d).withColumn("merchant_id", F.when(F.col("id") % 4 != 0, F.col("merchant_id")))
    m, _, rules = _merchant_tables(spark, d)
    return mutations.learn_from_choices(tx, m.select("id", "merchant_key"), rules, categories(spark), _choices(tx))[0].select("id", "merchant_id")


@query(f"SELECT id FROM ({_PENDING}) WHERE id % 5 <> 0")
def u14_dismissed(spark, d):
    rows = view(spark, d, _MESSAGES)
    return mutations.dismiss(rows, rows.where("id % 5 = 0").select("id")).where(filters.PENDING_REVIEW).select("id")


_AT = datetime(2026, 7, 1)
_ENTRY_COLUMNS = ("seq", "action", "actor", "actor_detail", "field_changes")
_JSON = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
_CHANGE = lambda name, old, new: f"""'{{"field":"{name}","from":' || {_JSON(old)} || ',"to":' || {_JSON(new)} || '}}'"""


@query(f"SELECT id AS seq, 'categorize' AS action, 'user' AS actor, CAST(NULL AS STRING) AS actor_detail, '[' || {_CHANGE('categoryId', 'category_id', chr(39) + 'dining' + chr(39))} || ',' || {_CHANGE('categorySource', 'category_source', chr(39) + 'user' + chr(39))} || ']' AS field_changes FROM ({_TX}) WHERE id % 10 = 3")
def u1_audit_entries(spark, d):
    tx = ledger(spark, d)
    choices = tx.where("id % 10 = 3").select("id", F.lit("dining").alias("category_id"))
    return audit.categorised_by_user(tx, mutations.set_category_by_user(tx, choices), choices, F.lit(_AT)).select(*_ENTRY_COLUMNS)


@query(f"SELECT id AS seq, 'categorize' AS action, 'system_rule' AS actor, 'rule' AS actor_detail, '[' || {_CHANGE('categoryId', 'category_id', chr(39) + 'dining' + chr(39))} || ',' || {_CHANGE('categoryConfidence', 'CAST(category_confidence AS STRING)', chr(39) + '0.7' + chr(39))} || ']' AS field_changes FROM ({_TX}) WHERE id % 10 IN (0, 1) AND coalesce(category_source, '') <> 'user' AND category_id IS DISTINCT FROM 'dining'")
def u2_audit_entries(spark, d):
    tx = ledger(spark, d)
    changes = tx.where("id % 10 IN (0, 1)").select("id", F.lit("dining").alias("category_id"), F.lit(1).cast("bigint").alias("rule_id"), F.lit(0.7).alias("confidence"), F.lit("low_confidence").alias("reason"))
    return audit.categorised_by_rule(tx, mutations.set_category_automatically(tx, changes), changes, F.lit(_AT), "rule").select(*_ENTRY_COLUMNS)


@query(f"SELECT id AS seq, 'delete' AS action, 'user' AS actor, CAST(NULL AS STRING) AS actor_detail, '[' || {_CHANGE('isDeleted', 'CAST(is_deleted AS STRING)', chr(39) + 'true' + chr(39))} || ']' AS field_changes FROM ({_TX}) WHERE id % 6 = 1")
def u3_audit_entries(spark, d):
    tx = ledger(spark, d)
    ids = tx.where("id % 6 = 1").select("id")
    return audit.deleted(tx, mutations.soft_delete(tx, ids, _AT), ids, F.lit(_AT)).select(*_ENTRY_COLUMNS)


@query(f"SELECT id AS seq, 'update' AS action, 'user' AS actor, 'manual_edit' AS actor_detail, '[' || {_CHANGE('merchantRawText', 'merchant_text', chr(39) + 'NEW' + chr(39))} || CASE WHEN type <> 'fee' THEN ',' || {_CHANGE('transactionType', 'type', chr(39) + 'fee' + chr(39))} ELSE '' END || ']' AS field_changes FROM ({_TX}) WHERE id % 4 = 1")
def u4_audit_entries(spark, d):
    tx = ledger(spark, d)
    edits = tx.where("id % 4 = 1").withColumns({"merchant_text": F.lit("NEW"), "type": F.lit("fee"), "set": F.array(F.lit("merchant_text"), F.lit("type"))})
    return audit.edited(tx, mutations.edit(tx, edits), edits, F.lit(_AT)).select(*_ENTRY_COLUMNS)


@query(f"WITH i AS ({_INST}) SELECT id, CASE WHEN settlement_account_id IS NULL OR id % 2 = 0 THEN 1 ELSE settlement_account_id END AS settlement_account_id FROM i")
def u9_settlement_links(spark, d):
    inst = view(spark, d, INSTRUMENT_SQL).withColumn("link_source", F.lit(None).cast("string"))
    links = inst.select("id", F.lit(1).cast("bigint").alias("account_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("sms").alias("source"))
    return mutations.link_settlement(inst, links).select("id", F.col("settlement_account_id").cast("bigint").alias("settlement_account_id"))


def _drafts(spark, d):
    s = _tables(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("draft_id"), F.col("s_acctbal").cast("decimal(20,4)").cast("string").alias("amount_text"), F.when(F.col("s_nationkey") % 5 != 0, "sar").alias("currency"), F.lit(START).alias("occurred_at"), F.when(F.col("s_nationkey") % 2 == 0, "withdrawal").otherwise("fee").alias("type"), F.lit("debit").alias("direction"))


@query("SELECT s_suppkey AS draft_id, CASE WHEN s_acctbal < 0 THEN 'amount' WHEN s_nationkey % 5 = 0 THEN 'amount,currency' ELSE '' END AS missing FROM supplier")
def u12_check_entries(spark, d):
    return entry.check_entries(_drafts(spark, d)).select("draft_id", F.array_join("missing", ",").alias("missing"))


@query("SELECT 1000 + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey AS draft_id, 'SAR' AS currency, s_nationkey % 2 <> 0 AS affects_spend FROM supplier WHERE s_acctbal >= 0 AND s_nationkey % 5 <> 0")
def u12_manual_entries(spark, d):
    return entry.manual_entries(_drafts(spark, d), 1000).select("id", "draft_id", "currency", "affects_spend")


@query(f"SELECT s_suppkey AS message_id, CASE WHEN s_nationkey % 5 = 0 THEN 'rejected' WHEN s_suppkey IN (SELECT id FROM ({_PENDING})) THEN 'accepted' ELSE 'unavailable' END AS status FROM supplier")
def u12_complete_messages(spark, d):
    drafts = _drafts(spark, d).withColumnRenamed("draft_id", "message_id")
    return entry.complete_messages(drafts, view(spark, d, _MESSAGES)).select("message_id", "status")


@query("SELECT c_custkey, CASE WHEN CAST(c_acctbal AS DECIMAL(20,4)) IS NULL THEN 0 ELSE CAST(greatest(1, least(100, round(abs(CAST(c_acctbal AS DECIMAL(20,4))) * 100.0 / max(abs(CAST(c_acctbal AS DECIMAL(20,4)))) OVER ()))) AS BIGINT) END AS weight FROM customer")
def a21_bar_weights(spark, d):
    rows = _tables(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(20,4)").alias("x"))
    most = rows.agg(F.max(F.abs("x")).alias("most"))
    return rows.join(F.broadcast(most)).select("c_custkey", money.bar_weight(F.col("x"), F.col("most")).alias("weight"))


@query(f"WITH t AS (SELECT * FROM ({_TX})) SELECT id, id % 4 = 1 AS is_deleted, CASE WHEN id % 4 = 0 THEN (SELECT arg_max(a.id, a.id % 3 * 1000000000000 + a.id) FROM t a WHERE a.id // 4 = t.id // 4 AND a.id % 4 = 1) END AS merged_from FROM t")
def u3_restore(spark, d):
    rows = lineage.cut(_merged(spark, d))
    return mutations.restore(rows, rows.where("id % 4 IN (2, 3)").select("id")).select("id", "is_deleted", "merged_from")


@query(f"WITH m AS (SELECT id AS merchant_id, id % 2 = 0 AS groceries, id % 5 = 0 AS mine FROM ({_MERCHANT}) WHERE id % 3 = 0 AND id % 7 <> 0) SELECT id, CASE WHEN m.merchant_id IS NOT NULL AND NOT is_deleted AND coalesce(category_source, '') <> 'user' THEN CASE WHEN groceries THEN 'groceries' ELSE 'gone' END ELSE category_id END AS category_id FROM ({_TX}) t LEFT JOIN m USING (merchant_id)")
def u11_reapply_rules(spark, d):
    _, _, rules = _merchant_tables(spark, d)
    return mutations.reapply_rules(ledger(spark, d), rules).select("id", "category_id")


@query(f"SELECT id, category_id FROM ({_TX})")
def u11_undo(spark, d):
    before = ledger(spark, d)
    after = mutations.fill_siblings(before, 7, "dining")
    return mutations.undo(after, before.where("merchant_id = 7")).select("id", "category_id")


@query("SELECT category, sort_order, name FROM (SELECT category, sort_order, CASE category WHEN 'dining' THEN 'Eating out' WHEN 'groceries' THEN 'Groceries' END AS name FROM (VALUES " + _CATEGORY_ROWS + ") c(category, g, sort_order) WHERE category IN ('dining', 'groceries')) UNION ALL SELECT 'pets', 10, 'Pets'")
def u10_create_and_rename_category(spark, d):
    made = mutations.rename_category(mutations.create_category(categories(spark), "pets", "spending", "Pets "), "dining", "Eating out")
    return made.where("id IN ('dining', 'groceries', 'pets')").select(F.col("id").alias("category"), "sort_order", F.col("name_en").alias("name"))


_PAIRED = "SELECT n, n * 2 AS s, CASE WHEN n = 1 THEN n * 2 ELSE n * 2 + 1 END AS m FROM (SELECT unnest(range(1, 13)) AS n)"


@query(
    f"SELECT s AS survivor_id, m AS merged_id, CASE n WHEN 1 THEN 'same_transaction' WHEN 2 THEN 'not_live' WHEN 3 THEN 'amount_differs' WHEN 4 THEN 'direction_differs' WHEN 5 THEN 'type_differs' WHEN 6 THEN 'chain_would_form' WHEN 7 THEN 'fee_differs' WHEN 8 THEN 'conversion_differs' WHEN 9 THEN 'remaining_balance_differs' WHEN 10 THEN 'spend_effect_differs' WHEN 11 THEN 'user_edit_differs' END AS refusal FROM ({_PAIRED})"
)
def u5_every_refusal(spark, d):
    case, second = F.floor(F.col("id") / 2), F.col("id") % 2 == 1
    when = lambda n, x, y: F.when(case == n, F.when(second, y).otherwise(x))
    ten, one, two = (F.lit(x).cast("decimal(20,4)") for x in ("10", "1", "2"))
    rows = spark.range(2, 26).withColumns({
        "amount": F.coalesce(when(3, one, two), ten), "currency": F.lit("SAR"), "direction": F.coalesce(when(4, F.lit("debit"), F.lit("credit")), F.lit("debit")), "type": F.coalesce(when(5, F.lit("fee"), F.lit("withdrawal")), F.lit("fee")),
        "affects_spend": F.coalesce(when(10, F.lit(True), F.lit(False)), F.lit(True)), "is_deleted": F.coalesce((case == 2) & second, F.lit(False)), "merged_from": F.when((case == 6) & second, F.lit(99)).cast("bigint"),
        "fee_amount": when(7, one, two), "fee_currency": when(7, F.lit("SAR"), F.lit("SAR")), "converted_amount": when(8, one, two), "converted_currency": when(8, F.lit("SAR"), F.lit("SAR")), "balance_amount": when(9, one, two), "balance_currency": when(9, F.lit("SAR"), F.lit("SAR")),
        "category_id": when(11, F.lit("dining"), F.lit("groceries")), "user_edited": F.when((case == 11) & second, F.array(F.lit("category_id"))),
    })
    pairs = rows.where("id % 2 = 0").select(F.col("id").alias("survivor_id"), F.when(F.col("id") == 2, F.col("id")).otherwise(F.col("id") + 1).alias("merged_id"))
    return merge.assess(pairs, with_defaults(rows))


@query("SELECT event_id, least(TIMESTAMP '2024-01-10', date_trunc('month', ts + INTERVAL 3 HOUR) - INTERVAL 3 HOUR) AS since FROM events")
def g7_rescan_window(spark, d):
    from ..streaming.backfill import rescan_window

    return _tables(spark, d, "events").select("event_id", rescan_window(F.col("ts").cast("timestamp"), F.lit(datetime(2024, 1, 10)).cast("timestamp")).cast("timestamp_ntz").alias("since"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
