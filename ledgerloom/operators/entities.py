"""Banks and instruments that messages name, kept as tables that a stream adds to.

A table is a log of additions, a few rows a batch. The first row of a key carries its id; later rows of the
same id fill what was null. ``banks`` and ``instruments`` fold a log into the table. Ids follow the order in
which keys are first mentioned, so a feed gives the same ids in whatever batches it comes.

Instruments are told apart by bank, kind and last digits. What is observed first stands: the network, the
type of card, the currency, and the account that a card's repayments come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import instrument_ref_key
from .lineage import cut, numbered, small

BANK_LOG = "id bigint, canonical_key string, name_en string, name_ar string, aliases array<string>, source string, first_seen bigint"
INSTRUMENT_LOG = "id bigint, ref_key string, bank_id bigint, kind string, masked string, network string, card_type string, currency string, settlement_account_id bigint, link_source string, link_observed_at timestamp, first_seen bigint"
#: What a later message may fill.
FILLED = ("network", "card_type", "currency")
LINK = ("settlement_account_id", "link_source", "link_observed_at")
#: Keys of one batch (about 50 bytes each) up to this number are broadcast.
MAX_BROADCAST_KEYS = 200_000


def _folded(log: DataFrame, *own: str) -> DataFrame:
    return log.groupBy("id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in log.columns if c in own))


def banks(log: DataFrame) -> DataFrame:
    """The banks of a log."""
    return log.dropDuplicates(["id"])


def instruments(log: DataFrame) -> DataFrame:
    """The instruments of a log; a column has at most one value in all rows of an id."""
    return _folded(log, *(c for c in log.columns if c != "id"))


def mentions(parsed: DataFrame, order: str = "provider_id") -> DataFrame:
    """One row for each instrument that a parsed message names: (seen, role, bank_key, kind, masked, ref_key, ...).

    ``role`` 0 is the instrument of the transaction, 1 the account that settles it, which states no currency.
    A message without a bank names none. ``parsed`` has the columns bank_id, parsed and the order.
    """
    p = lambda k: F.col(f"parsed.{k}")
    none = F.lit(None).cast("string")

    def one(role: int, kind: Column, masked: Column, network: Column, card_type: Column, currency: Column) -> Column:
        key = instrument_ref_key(F.col("bank_id"), kind, masked)
        return F.when(key.isNotNull(), F.struct(F.lit(role).alias("role"), kind.alias("kind"), masked.alias("masked"), key.alias("ref_key"), network.alias("network"), card_type.alias("card_type"), currency.alias("currency")))

    both = F.array_compact(F.array(one(0, p("instrument_kind"), p("instrumentRef"), p("instrumentRefNetwork"), p("instrumentRefType"), p("currency")), one(1, p("settlement_kind"), p("settlementRef"), none, none, none)))
    at = F.coalesce(p("occurredAt"), F.col("received_at"))
    return parsed.where("bank_id IS NOT NULL").select(F.col(order).alias("seen"), F.col("bank_id").alias("bank_key"), at.alias("at"), F.explode(both).alias("m")).select("seen", "bank_key", "at", "m.*")


def _known(log: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The log's rows of the ids whose key is wanted; the keys of a batch are few, the log is only read."""
    ids = log.join(wanted, key, "left_semi").select("id").distinct()
    return log.join(small(cut(ids), MAX_BROADCAST_KEYS), "id", "left_semi")


def _next_ids(new: DataFrame, log: DataFrame, *order: str) -> DataFrame:
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return numbered(new, *order).join(F.broadcast(last)).withColumn("id", F.col("last") + F.col("n")).drop("n", "last")  # one row


def add_banks(log: DataFrame, parsed: DataFrame, profiles: DataFrame, order: str = "provider_id") -> DataFrame:
    """Rows for the banks of parsed messages that the log lacks.

    ``profiles`` (canonical_key, name_en, name_ar, aliases) tells their names; an unknown bank is named by its key.
    """
    named = parsed.where("bank_id <> ''").groupBy(F.col("bank_id").alias("canonical_key")).agg(F.min(order).alias("first_seen"))
    new = _next_ids(named.join(log.select("canonical_key"), "canonical_key", "left_anti"), log, "first_seen", "canonical_key")
    told = new.join(small(profiles, MAX_BROADCAST_KEYS), "canonical_key", "left")
    key = F.col("canonical_key")
    return told.select("id", "canonical_key", F.coalesce("name_en", key).alias("name_en"), F.coalesce("name_ar", key).alias("name_ar"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.lit("rule_pack").alias("source"), "first_seen")


def add_instruments(log: DataFrame, named: DataFrame, bank_table: DataFrame) -> DataFrame:
    """Rows that the mentions of a batch add to the log: new instruments, and what they tell of known ones.

    Of several values in the batch the one seen first counts, and none where the log has one already.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seen", "role", c)))[c].alias(c)
    of_key = cut(named.groupBy("ref_key").agg(F.min(F.struct("seen", "role")).alias("at"), F.min("seen").alias("first_seen"), *(F.min_by(c, F.struct("seen", "role")).alias(c) for c in ("bank_key", "kind", "masked")), *map(first, FILLED)))
    known = cut(instruments(_known(log, "ref_key", small(of_key.select("ref_key"), MAX_BROADCAST_KEYS))))
    new = _next_ids(of_key.join(known.select("ref_key"), "ref_key", "left_anti"), log, "at")
    owner = bank_table.select(F.col("id").alias("bank_id"), F.col("canonical_key").alias("bank_key"))
    made = new.join(small(owner, MAX_BROADCAST_KEYS), "bank_key")
    # links need the ids of both ends
    ids = cut(known.select("ref_key", "id", "kind").unionByName(made.select("ref_key", "id", "kind")))
    cards, accounts = (named.where(F.col("role") == r).select("seen", F.col("ref_key").alias(f"key{r}"), F.col("kind").alias(f"kind{r}"), "at") for r in (0, 1))
    pairs = cards.join(accounts.drop("at"), "seen").where("kind0 = 'card' AND kind1 = 'account'")
    one = pairs.groupBy(F.col("key0").alias("ref_key")).agg(F.min_by(F.struct("key1", "at"), "seen").alias("to"))
    to = ids.select(F.col("ref_key").alias("key1"), F.col("id").alias("settlement_account_id"))
    links = one.select("ref_key", "to.key1", F.col("to.at").alias("link_observed_at")).join(to, "key1").select("ref_key", "settlement_account_id", F.lit("sms_repayment").alias("link_source"), "link_observed_at")
    columns = [part.split(" ")[0] for part in INSTRUMENT_LOG.split(", ")]
    created = made.join(links, "ref_key", "left").select(*columns)
    k = known.select("id", "ref_key", *(F.col(c).alias(f"old_{c}") for c in (*FILLED, "settlement_account_id")))
    open_ = k.join(of_key, "ref_key").join(links, "ref_key", "left")
    unset = F.col("old_settlement_account_id").isNull()
    filled = {c: F.when(F.col(f"old_{c}").isNull(), F.col(c)) for c in FILLED} | {c: F.when(unset, F.col(c)) for c in LINK}
    told = open_.select("id", *(v.alias(c) for c, v in filled.items())).where(F.coalesce(*(F.col(c).cast("string") for c in (*FILLED, "settlement_account_id"))).isNotNull())
    return created.unionByName(told, allowMissingColumns=True)


def instrument_ids(named: DataFrame, table: DataFrame) -> DataFrame:
    """(seen, instrument_id) of the instruments of transactions."""
    wanted = table.select("ref_key", F.col("id").alias("instrument_id"))
    return named.where("role = 0").select("seen", "ref_key").join(small(wanted, MAX_BROADCAST_KEYS), "ref_key").select("seen", "instrument_id")
