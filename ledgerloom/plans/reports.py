"""Reports over classified ledger rows.

Rows come from ``operators.classify.classified``, run on the whole ledger: pairing decides classes,
so a report filters and groups afterwards. Each report is one pass with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import bar_weight, base_amount, display_name, local_month, percent_share, signed_for_spend
from ..operators.filters import LIVE, in_period
from ..operators.lineage import small
from ..schema import MAX_BROADCAST_CATEGORIES, UNCATEGORIZED

MEASURES = ("spend", "income", "cash_withdrawals", "internal_transfers", "fees")


def measured(classified: DataFrame, base: str) -> DataFrame:
    """A row for each amount that a live row adds to a measure: (measure, currency, native, base_value) and the row's columns."""
    kind, credit = F.col("class"), F.col("direction") == "credit"
    is_spend = kind.isin("spend", "spend_credit")
    internal = (kind == "excluded") & (F.col("class_reason") == "internal_transfer") & (F.col("direction") == "debit")
    measure = F.when(is_spend, "spend").when(kind == "income", "income").when(kind == "cash_withdrawal", "cash_withdrawals").when(internal, "internal_transfers")
    sign = lambda c: F.when(is_spend & credit, -c).otherwise(c)
    own = F.struct(measure.alias("measure"), F.col("currency").alias("currency"), sign(F.col("amount")).cast("decimal(20,4)").alias("native"), sign(base_amount(base)["value"]).cast("decimal(20,4)").alias("base_value"))
    fee = F.struct(F.when(F.col("fee_amount").isNotNull(), "fees").alias("measure"), F.col("fee_currency").alias("currency"), F.col("fee_amount").alias("native"), base_amount(base, "fee_amount", "fee_currency", converted=False)["value"].alias("base_value"))
    rows = classified.where(LIVE).withColumn("__m", F.explode(F.array(own, fee))).where("__m.measure IS NOT NULL")
    return rows.drop("currency").withColumns({"measure": F.col("__m.measure"), "currency": F.col("__m.currency"), "native": F.col("__m.native"), "base_value": F.col("__m.base_value")}).drop("__m")


def _totals() -> list[Column]:
    return [
        F.sum("base_value").alias("base"),
        F.count("base_value").alias("converted_count"),
        F.count_if(F.col("base_value").isNull()).alias("unconverted_count"),
    ]


def by_currency(classified: DataFrame, start, end, base: str) -> DataFrame:
    """(measure, currency, net, transactions, unconverted_net, unconverted, position): native totals, the most used currency first."""
    rows = measured(classified, base).where(in_period(start, end))
    missing = F.col("base_value").isNull()
    sums = rows.groupBy("measure", "currency").agg(F.sum("native").alias("net"), F.count("*").alias("transactions"), F.sum(F.when(missing, F.col("native"))).alias("unconverted_net"), F.count_if(missing).alias("unconverted"))
    order = Window.partitionBy("measure").orderBy(F.desc("transactions"), F.asc("currency"))
    return sums.withColumn("position", F.row_number().over(order))


def period_report(classified: DataFrame, start, end, base: str) -> DataFrame:
    """(measure, base, converted_count, unconverted_count, is_incomplete): the five measures; base is null if nothing converted."""
    rows = measured(classified, base).where(in_period(start, end))
    every = classified.sparkSession.range(1).select(F.explode(F.array(*(F.lit(m) for m in MEASURES))).alias("measure"))
    sums = rows.groupBy("measure").agg(*_totals())
    out = every.join(sums, "measure", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return out.select("measure", "base", count("converted_count").alias("converted_count"), count("unconverted_count").alias("unconverted_count"), (count("unconverted_count") > 0).alias("is_incomplete"))


TOTALS = "month timestamp, measure string, currency string, net decimal(30,4), transactions bigint, base decimal(30,4), converted_count bigint, unconverted_net decimal(30,4), unconverted bigint"
_SUMS = ("net", "transactions", "base", "converted_count", "unconverted_net", "unconverted")


def partial_totals(classified: DataFrame, base: str) -> DataFrame:
    """Sums of dated rows by local month, measure and currency, which add up over disjoint sets of rows. See ``TOTALS``."""
    rows = measured(classified, base).where("occurred_at IS NOT NULL").withColumn("month", local_month(F.col("occurred_at")).cast("timestamp"))
    missing = F.col("base_value").isNull()
    values = (F.sum("native"), F.count("*"), F.sum("base_value"), F.count("base_value"), F.sum(F.when(missing, F.col("native"))), F.count_if(missing))
    kinds = dict(part.split(" ") for part in TOTALS.split(", "))
    return rows.groupBy("month", "measure", "currency").agg(*(v.cast(kinds[name]).alias(name) for name, v in zip(_SUMS, values, strict=True)))


def merged_totals(partials: DataFrame) -> DataFrame:
    """Partial totals of several batches as those of all their rows."""
    kinds = dict(part.split(" ") for part in TOTALS.split(", "))
    return partials.groupBy("month", "measure", "currency").agg(*(F.sum(c).cast(kinds[c]).alias(c) for c in _SUMS))


def months_by_currency(totals: DataFrame) -> DataFrame:
    """``by_currency`` of every month, from totals."""
    order = Window.partitionBy("month", "measure").orderBy(F.desc("transactions"), F.asc("currency"))
    return totals.select("month", "measure", "currency", "net", "transactions", "unconverted_net", "unconverted", F.row_number().over(order).alias("position"))


def month_reports(totals: DataFrame) -> DataFrame:
    """``period_report`` of every month with rows, from totals; measures without rows are left out."""
    sums = totals.groupBy("month", "measure").agg(F.sum("base").alias("base"), F.sum("converted_count").alias("converted_count"), F.sum("unconverted").alias("unconverted_count"))
    return sums.withColumn("is_incomplete", F.col("unconverted_count") > 0)


def net_kept(classified: DataFrame, start, end, base: str) -> DataFrame:
    """(net_kept, needs_review): income less spend; null if a side has rows but none converted, or both have none."""
    live = classified.where(LIVE).where(in_period(start, end))
    value, credit = base_amount(base)["value"], F.col("direction")
    spend, income = F.col("class").isin("spend", "spend_credit"), F.col("class") == "income"
    one = live.agg(
        F.sum(F.when(spend, signed_for_spend(value, credit))).alias("spend"),
        F.count_if(spend).alias("spends"),
        F.sum(F.when(income, value)).alias("income"),
        F.count_if(income).alias("incomes"),
        F.count_if("class_review").alias("needs_review"),
    )
    nothing = F.lit(0).cast("decimal(30,4)")
    side = lambda total, n: F.when(F.col(n) == 0, nothing).otherwise(F.col(total))
    kept = F.when((F.col("spends") > 0) | (F.col("incomes") > 0), side("income", "incomes") - side("spend", "spends"))
    return one.select(kept.alias("net_kept"), "needs_review")


def resolved_category(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``category``, the row's category if it is known, else uncategorized."""
    known = categories.select(F.col("id").alias("__category"))
    return transactions.join(small(known, MAX_BROADCAST_CATEGORIES), F.col("category_id") == F.col("__category"), "left").withColumn("category", F.coalesce("__category", F.lit(UNCATEGORIZED))).drop("__category")


def category_breakdown(classified: DataFrame, categories: DataFrame, start, end, base: str, include_empty: bool = False) -> DataFrame:
    """(category, sort_order, base, unconverted_count, members, percent) by category.

    A category shows if any live row of any period has it; members counts its rows in the period,
    of whatever class; percent is of the total spend. The parts add up to the total exactly.
    """
    live = resolved_category(classified.where(LIVE), categories)
    inside = in_period(start, end)
    counts = F.col("class").isin("spend", "spend_credit") & inside
    value = signed_for_spend(base_amount(base)["value"], F.col("direction"))
    sums = live.groupBy("category").agg(F.sum(F.when(counts, value)).alias("base"), F.count_if(counts & value.isNull()).alias("unconverted_count"), F.count_if(inside).alias("members"))
    joined = categories.select(F.col("id").alias("category"), "sort_order").join(sums, "category", "left" if include_empty else "inner")
    zero = F.lit(0).cast("bigint")
    share = percent_share(F.col("base"), F.sum("base").over(Window.partitionBy()))
    return joined.select("category", "sort_order", "base", F.coalesce("unconverted_count", zero).alias("unconverted_count"), F.coalesce("members", zero).alias("members"), share.alias("percent"))


def instrument_breakdown(classified: DataFrame, start, end, base: str) -> DataFrame:
    """(instrument_id, is_total, base, converted_count, unconverted_count, members): spend by instrument, null for none, and the total."""
    live = classified.where(LIVE).where(in_period(start, end))
    spend = F.col("class").isin("spend", "spend_credit")
    value = signed_for_spend(base_amount(base)["value"], F.col("direction"))
    rows = live.withColumn("base_value", F.when(spend, value)).withColumn("__spend", spend)
    out = rows.rollup("instrument_id").agg(F.grouping("instrument_id").alias("g"), F.sum("base_value").alias("base"), F.count("base_value").alias("converted_count"), F.count_if(F.col("__spend") & F.col("base_value").isNull()).alias("unconverted_count"), F.count("*").alias("members"))
    return out.select("instrument_id", (F.col("g") == 1).alias("is_total"), "base", "converted_count", "unconverted_count", "members")


def bank_tree(classified: DataFrame, banks: DataFrame, instruments: DataFrame, start, end, base: str) -> DataFrame:
    """(bank_id, instrument_id, level, base, members): banks with their instruments and totals.

    Banks without instruments stay, instruments of unknown banks go, and so do rows without one.
    """
    live = classified.where(LIVE).where(in_period(start, end)).where("instrument_id IS NOT NULL")
    spend = F.col("class").isin("spend", "spend_credit")
    value = F.when(spend, signed_for_spend(base_amount(base)["value"], F.col("direction")))
    sums = live.groupBy("instrument_id").agg(F.sum(value).alias("base"), F.count("*").alias("members"))
    tree = banks.select(F.col("id").alias("bank_id")).join(instruments.select(F.col("id").alias("instrument_id"), "bank_id"), "bank_id", "left").join(sums, "instrument_id", "left")
    out = tree.rollup("bank_id", "instrument_id").agg(F.grouping_id().alias("g"), F.sum("base").alias("base"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"))
    level = F.when(F.col("g") == 0, "instrument").when(F.col("g") == 1, "bank").otherwise("all")
    return out.select("bank_id", "instrument_id", level.alias("level"), "base", "members").where("level <> 'instrument' OR instrument_id IS NOT NULL")


def settlement_labels(instruments: DataFrame) -> DataFrame:
    """(id, settlement_label): name of the account an instrument settles on, its own name first, else the masked number."""
    other = instruments.select(F.col("id").alias("__id"), display_name(F.col("friendly_name"), F.col("masked")).alias("settlement_label"))
    return instruments.join(other, F.col("settlement_account_id") == F.col("__id"), "left").select("id", "settlement_label")


def category_reconciles(breakdown: DataFrame, report: DataFrame) -> DataFrame:
    """(slices, total, reconciles): the categories' sum against the period's spend, exact; two unknown sums agree."""
    slices = breakdown.agg(F.sum("base").alias("slices"))
    total = report.where("measure = 'spend'").select(F.col("base").alias("total"))
    return slices.join(total).withColumn("reconciles", F.col("slices").eqNullSafe(F.col("total")))


def instruments_reconcile(breakdown: DataFrame) -> DataFrame:
    """(slices, total, reconciles): the instruments' sum, with the rows that have none, against the total row."""
    both = breakdown.agg(F.sum(F.when(~F.col("is_total"), F.col("base"))).alias("slices"), F.sum(F.when(F.col("is_total"), F.col("base"))).alias("total"))
    return both.withColumn("reconciles", F.col("slices").eqNullSafe(F.col("total")))


def monthly_spend(classified: DataFrame, base: str) -> DataFrame:
    """(month, base, unconverted_count, rows) by Riyadh month of dated live rows."""
    dated = classified.where(LIVE).where("occurred_at IS NOT NULL").withColumn("month", local_month(F.col("occurred_at")))
    spend = F.col("class").isin("spend", "spend_credit")
    value = signed_for_spend(base_amount(base)["value"], F.col("direction"))
    return dated.groupBy("month").agg(F.sum(F.when(spend, value)).alias("base"), F.count_if(spend & value.isNull()).alias("unconverted_count"), F.count("*").alias("rows"))


def month_trail(classified: DataFrame, base: str, selected, length: int = 3) -> DataFrame:
    """(month, base, weight): consecutive months up to the selected one; an empty month has a null base."""
    spark = classified.sparkSession
    last = F.lit(selected).cast("timestamp")
    spine = spark.range(length).select(F.add_months(last, (F.col("id") - (length - 1)).cast("int")).cast("timestamp").alias("month"))
    joined = spine.join(monthly_spend(classified, base).withColumn("month", F.col("month").cast("timestamp")), "month", "left")
    most = F.max(F.abs("base")).over(Window.partitionBy())
    return joined.select("month", "base", bar_weight(F.col("base"), most).alias("weight"))


def month_over_month(classified: DataFrame, base: str) -> DataFrame:
    """(month, spend, previous, difference) on a spine of months; the difference is null below two months of data, an empty side counts 0."""
    months = monthly_spend(classified, base)
    bounds = months.agg(F.min("month").alias("a"), F.max("month").alias("b"), F.count("*").alias("n"))
    spine = bounds.where("a IS NOT NULL").select("n", F.explode(F.sequence("a", "b", F.expr("INTERVAL '1' MONTH"))).alias("month"))
    joined = spine.join(months, "month", "left")
    over = Window.partitionBy().orderBy("month")  # one row a month
    nothing = F.lit(0).cast("decimal(30,4)")
    # a month with rows of which none converted has an unknown spend
    unknown = F.col("base").isNull() & (F.coalesce("unconverted_count", F.lit(0)) > 0)
    now = F.when(unknown, None).otherwise(F.coalesce("base", nothing))
    out = joined.withColumn("now", now).withColumn("before", F.lag("now").over(over))
    return out.select("month", F.col("base").alias("spend"), F.lag("base").over(over).alias("previous"), F.when(F.col("n") >= 2, F.col("now") - F.col("before")).alias("difference"))


def months_with_data(transactions: DataFrame) -> DataFrame:
    dated = transactions.where(LIVE).where("occurred_at IS NOT NULL")
    return dated.agg(F.count_distinct(local_month(F.col("occurred_at"))).alias("months"))


def review_counts(classified: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(flagged, uncategorized, transfers, needing_attention, unparsed, total); a row with several reasons needs attention once."""
    live = classified.where(LIVE)
    flagged, bare = F.coalesce("needs_review", F.lit(False)), F.col("category_id").isNull()
    state = F.coalesce("transfer_state", "derived_state") if "derived_state" in classified.columns else F.col("transfer_state")
    transfer = F.coalesce(state == "candidate", F.lit(False))
    counts = live.agg(F.count_if(flagged).alias("flagged"), F.count_if(bare).alias("uncategorized"), F.count_if(transfer).alias("transfers"), F.count_if(flagged | bare | transfer).alias("needing_attention"))
    waiting = unparsed.agg(F.count("*").alias("unparsed"))
    return counts.join(waiting).withColumn("total", F.col("needing_attention") + F.col("unparsed"))


def recent(transactions: DataFrame, n: int = 5) -> DataFrame:
    return transactions.where(LIVE).orderBy(F.col("occurred_at").desc_nulls_last(), F.desc("id")).limit(n)
