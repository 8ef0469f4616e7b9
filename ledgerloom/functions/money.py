"""Exact money as columns: an amount (decimal(20,4)) beside its currency code.

Products and quotients are formed on decimals and rounded half away from zero, to the number of
places of the target currency, which must be known when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AMOUNT, MINOR_DIGITS, RATE, minor_digits
from .text import normalize_numerals, trim

RATE_DIGITS = 8


def parse_amount(c: Column) -> Column:
    return normalize_numerals(c).try_cast(AMOUNT)


def currency_code(c: Column) -> Column:
    code = F.upper(trim(c))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def digits_of(currency: Column) -> Column:
    out = F.lit(2)
    for n, codes in MINOR_DIGITS.items():
        out = F.when(currency.isin(*codes), n).otherwise(out)
    return F.when(currency.isNotNull(), out)


def minor_units(amount: Column, currency: Column) -> Column:
    """Whole minor units, cut off towards zero."""
    shifted = [F.when(digits_of(currency) == n, (amount * 10**n).cast("bigint")) for n in (0, 2, 3, 4)]
    return F.coalesce(*shifted)


def from_minor_units(units: Column, currency: Column) -> Column:
    exact = units.cast("decimal(19,0)")
    return F.coalesce(*(F.when(digits_of(currency) == n, (exact / F.lit(10**n).cast("decimal(5,0)")).cast(AMOUNT)) for n in (0, 2, 3, 4)))


def canonical(amount: Column) -> Column:
    """Decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def convert(amount: Column, rate: Column, to_currency: str) -> Column:
    return F.round(amount * rate.cast(RATE), minor_digits(to_currency)).cast(AMOUNT)


def guarded(result: Column, currency: Column, other: Column) -> Column:
    """``result``, or an error if the currencies differ."""
    clash = F.raise_error(F.concat(F.lit("currency mismatch: "), currency, F.lit(" and "), other))
    return F.when(currency == other, result).when(currency.isNull() | other.isNull(), None).otherwise(clash)


def base_amount(base: str, amount: str = "amount", currency: str = "currency", converted: bool = True) -> Column:
    """Struct (value, basis) of an amount in the base currency.

    Native if it is in the base; else what the bank converted, if to the base; else by the stated
    rate, if positive; else unavailable. A fee has no bank-supplied conversion.
    """
    native = F.col(currency) == base
    bank = (F.col("converted_currency") == base) & F.col("converted_amount").isNotNull() if converted else F.lit(False)
    stated = F.col("fx_rate") > 0
    has = F.col(amount).isNotNull()
    value = F.when(has & native, F.col(amount)).when(has & bank, F.col("converted_amount")).when(has & stated, convert(F.col(amount), F.col("fx_rate"), base))
    basis = F.when(has & native, "native").when(has & bank, "bank_supplied").when(has & stated, "stated_rate").otherwise("unavailable")
    return F.struct(value.cast(AMOUNT).alias("value"), basis.alias("basis"))


def implied_rate() -> Column:
    """Converted by native amount, rounded at the eighth place; a stated rate goes first, no rate of nothing."""
    quotient = F.round(F.col("converted_amount").cast("decimal(20,8)") / F.col("amount"), RATE_DIGITS).cast(RATE)
    return F.when(F.col("amount") == 0, None).otherwise(F.coalesce(F.col("fx_rate"), quotient))


def fx_recording(base: str) -> Column:
    """What to record of a message's exchange: struct (rate, rate_date, source, pending)."""
    native = F.col("currency") == base
    stated = F.col("fx_rate") > 0
    implied = (F.col("converted_currency") == base) & F.col("converted_amount").isNotNull() & (F.col("amount") != 0)
    quotient = F.round(F.col("converted_amount").cast("decimal(20,8)") / F.nullif(F.col("amount"), F.lit(0).cast(AMOUNT)), RATE_DIGITS).cast(RATE)
    rate = F.when(native, None).when(stated, F.col("fx_rate")).when(implied, quotient)
    known = F.coalesce(native, F.lit(False))
    source = F.when(known, None).when(stated, "sms_stated").when(implied, "sms_implied")
    pending = ~known & ~F.coalesce(stated, F.lit(False)) & ~F.coalesce(implied, F.lit(False))
    return F.struct(rate.alias("rate"), F.when(source.isNotNull(), F.col("occurred_at")).alias("rate_date"), source.alias("source"), pending.alias("pending"))


def money_sum(amount: Column, currency: Column) -> Column:
    """Aggregate: the sum of amounts of one currency; an error if there are several."""
    clash = F.raise_error(F.concat(F.lit("currency mismatch: "), F.min(currency), F.lit(" and "), F.max(currency)))
    return F.when(F.min(currency) == F.max(currency), F.sum(amount)).when(F.count(currency) == 0, None).otherwise(clash)


def amount_problem(text: Column) -> Column:
    """Why an amount given as text cannot be taken: missing, unparsable or negative; null if it can. Nothing is a valid amount."""
    amount = parse_amount(text)
    return F.when(text.isNull() | (trim(text) == ""), "missing").when(amount.isNull(), "unparsable").when(amount < 0, "negative")


def signed_for_spend(amount: Column, direction: Column) -> Column:
    return F.when(direction == "credit", -amount).otherwise(amount)


def percent_share(part: Column, whole: Column) -> Column:
    """Whole percent of the magnitudes; null if either is null or the whole is nothing."""
    share = F.round(F.abs(part).cast("decimal(22,4)") * 100 / F.nullif(F.abs(whole), F.lit(0).cast("decimal(28,4)")), 0)
    return share.cast("bigint")


def bar_weight(value: Column, most: Column) -> Column:
    """0 to 100 against the largest magnitude; at least 1 for a value that is there."""
    scaled = F.round(F.abs(value).cast("decimal(22,4)") * 100 / F.nullif(most, F.lit(0).cast("decimal(28,4)")), 0).cast("bigint")
    return F.when(value.isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(scaled, F.lit(0))))).cast("bigint")


def confidence_band(source: Column, confidence: Column) -> Column:
    return F.when(source == "user", "user_chosen").when(confidence.isNull() | (confidence <= 0), "none").when(confidence >= 0.85, "confident").otherwise("low")


def wall_clock(ts: Column) -> Column:
    """Riyadh wall-clock time of a UTC instant; the offset is fixed."""
    return ts + F.expr("INTERVAL '3' HOUR")


def local_month(ts: Column) -> Column:
    return F.date_trunc("month", wall_clock(ts))


def month_window(now: Column, offset: int = 0) -> Column:
    """Struct (start, end) in UTC of the Riyadh month ``offset`` months from that of ``now``."""
    month = F.add_months(local_month(now), offset).cast("timestamp")
    after = F.add_months(local_month(now), offset + 1).cast("timestamp")
    back = F.expr("INTERVAL '3' HOUR")
    return F.struct((month - back).alias("start"), (after - back).alias("end"))


def display_name(*choices: Column) -> Column:
    return F.coalesce(*(F.nullif(trim(c), F.lit("")) for c in choices))
