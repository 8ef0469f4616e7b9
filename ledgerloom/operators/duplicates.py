"""Duplicates among incoming messages and transactions.

Incoming rows are compared with the history and with the rows before them in the same batch, so a
batch gives what one-by-one processing would. A duplicate is flagged, never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .lineage import cut, small, spread, unused

WINDOW_SECONDS = 15 * 60
#: Rounds in which rows are settled by the first row of each of their keys.
ROUNDS = 3
#: Rows that are still open after them (about 100 bytes each) and are settled by one task.
MOST_IN_ONE_PASS = 500_000


#: Up to so many distinct keys of a batch (about 100 bytes each) are broadcast to the scan of the history.
MAX_BROADCAST_KEYS = 500_000


def _held(rows: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    """(key, value) and the columns ``more``: one row for each key of a row that is not null."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    held = rows.select(*more, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("__k"))
    return held.select(*more, "__k.key", "__k.value")


def exact_new(batch: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("content_hmac", "sms_provider_id"), order: str = "provider_id") -> DataFrame:
    """Rows of the batch that one-by-one processing in the order would keep.

    A row is dropped if the history, or an earlier row that was kept, has one of its keys. A row that is
    dropped itself drops no other. Null keys match nothing; a row without keys stays. Rows of the same
    order are taken in the order of their keys; of equal ones any stays. An empty batch or history is fine.

    The history is read once, its two key columns only, and not shuffled while the batch is small. Among the
    rows of the batch those that come first by all their keys are kept and what shares a key with them is
    dropped, which settles any number of rows that share one key. What is still open after ``ROUNDS`` of this
    are chains of rows that share one key after the other. Up to ``MOST_IN_ONE_PASS`` such rows are one sorted
    pass, which remembers the keys that were kept; of more, each connected chain is a pass of its own, at the
    price of jobs whose number grows with the logarithm of the longest chain.
    """
    n, rank = unused(batch, "__n", "__rank")
    rows = cut(batch.withColumn(n, F.monotonically_increasing_id()))
    ranked = rows.withColumn(rank, F.struct(F.col(order).alias("o"), F.xxhash64(*keys).alias("h"), F.col(n).alias("n")))
    held = cut(_held(ranked.select(n, rank, *keys).withColumnsRenamed({n: "n", rank: "rank"}), keys, "n", "rank"))
    wanted = small(held.select("key", "value").distinct(), MAX_BROADCAST_KEYS)
    known = _held(history, keys).join(wanted, ["key", "value"], "left_semi").distinct()
    dropped = cut(held.join(known, ["key", "value"], "left_semi").select("n").distinct())
    open_ = held.join(dropped, "n", "left_anti")
    for _ in range(ROUNDS):
        first = spread(open_.groupBy("key", "value").agg(F.min("rank").alias("first")))
        if first.isEmpty():
            break
        leads = open_.join(first, ["key", "value"]).groupBy("n").agg(F.bool_and(F.col("rank") == F.col("first")).alias("kept"))
        kept = cut(leads.where("kept").select("n"))
        taken = first.select("key", "value", F.col("first.n").alias("n")).join(kept, "n", "left_semi").select("key", "value")
        settled = open_.join(taken, ["key", "value"], "left_semi").select("n").distinct()
        dropped = cut(dropped.unionByName(settled.join(kept, "n", "left_anti")))
        open_ = cut(open_.join(kept, "n", "left_anti").join(dropped, "n", "left_anti"))
    else:
        dropped = dropped.unionByName(_repeats_in_chains(open_))
    return rows.join(dropped.withColumnRenamed("n", n), n, "left_anti").select(*batch.columns)


def _repeats_in_chains(held: DataFrame) -> DataFrame:
    """(n) of the rows that repeat a key of an earlier kept row, each connected chain in one sorted pass."""
    rows = cut(held.groupBy("n", "rank").agg(F.collect_list(F.concat_ws("=", "key", "value")).alias("held")))
    if rows.count() <= MOST_IN_ONE_PASS:
        dealt = rows.withColumn("component", F.lit(0).cast("long")).coalesce(1)
    else:
        first = spread(held.groupBy("key", "value").agg(F.min("n").alias("least")))
        links = held.join(first, ["key", "value"]).select(F.col("n").alias("a"), F.col("least").alias("b"))
        # a row that shares no key is in no chain; it stays
        dealt = rows.join(components(links).withColumnRenamed("node", "n"), "n").repartition("component")
    dealt = dealt.sortWithinPartitions("component", "rank").select("component", "n", "held")

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, seen = None, set()
        for batch in batches:
            out = []
            for c, n, own in zip(batch["component"], batch["n"], batch["held"], strict=True):
                if c != chain:
                    chain, seen = c, set()
                if seen.isdisjoint(own):
                    seen.update(own)
                else:
                    out.append(n)
            yield pd.DataFrame({"n": pd.Series(out, dtype="int64")})

    return dealt.mapInPandas(repeats, "n bigint")


def duplicate_decisions(incoming: DataFrame, existing: DataFrame, window_seconds: int = WINDOW_SECONDS, authorisation_types: tuple[str, ...] = (), fresh: str | None = None) -> DataFrame:
    """(id, duplicate_of, tier) for incoming rows that repeat an existing one.

    Tier 1: equal reference and masked instrument. Tier 2: equal instrument and money, at most the
    window apart, and the same merchant text, or one of the two of an authorisation type. Existing
    rows count from one window before the incoming row, without an upper bound. The first tier
    wins, then the smallest id. Both joins are equi-joins. ``fresh`` names a column that tells which existing
    rows are of the batch itself: they count for rows after them only.
    """
    i = incoming.alias("i")
    e = existing.where("NOT is_deleted").withColumn("__fresh", F.col(fresh) if fresh else F.lit(False)).alias("e")
    later = F.unix_micros(F.col("e.occurred_at").cast("timestamp")) - F.unix_micros(F.col("i.occurred_at").cast("timestamp"))
    after = F.coalesce(later >= -window_seconds * 1e6, F.lit(False)) & (F.col("e.id") != F.col("i.id"))
    after = after & (~F.coalesce(F.col("e.__fresh"), F.lit(False)) | (F.col("e.id") < F.col("i.id")))
    by_reference = i.join(e, (F.col("i.reference") == F.col("e.reference")) & (F.col("i.reference") != "") & (F.col("i.masked_ref") == F.col("e.masked_ref")) & after)
    same_text = F.col("i.merchant_text") == F.col("e.merchant_text")
    auth = F.col("i.type").isin(*authorisation_types) != F.col("e.type").isin(*authorisation_types) if authorisation_types else F.lit(False)
    by_money = i.join(
        e,
        (F.col("i.masked_ref") == F.col("e.masked_ref"))
        & (F.col("i.currency") == F.col("e.currency"))
        & (F.col("i.amount") == F.col("e.amount"))
        & after
        & (F.abs(later) <= window_seconds * 1e6)
        & (F.coalesce(same_text, F.lit(False)) | F.coalesce(auth, F.lit(False))),
    )
    pick = lambda df, tier: df.select(F.col("i.id").alias("id"), F.struct(F.lit(tier).alias("tier"), F.col("e.id").alias("of")).alias("hit"))
    hits = pick(by_reference, 1).unionByName(pick(by_money, 2)).groupBy("id").agg(F.min("hit").alias("hit"))
    return hits.select("id", F.col("hit.of").alias("duplicate_of"), F.when(F.col("hit.tier") == 1, "reference").otherwise("amount_and_time").alias("tier"))


def batch_decisions(batch: DataFrame, history: DataFrame, window_seconds: int = WINDOW_SECONDS, **options) -> DataFrame:
    """The same for a batch: its rows see the history and the rows before them (by id) in the batch.

    Nothing older than a window before the batch's oldest row is read of the history.
    """
    oldest = batch.agg(F.min(F.col("occurred_at").cast("timestamp")).alias("t")).first()["t"]
    if oldest is None:
        seen = history.where("false")
    else:
        seen = history.where(F.col("occurred_at") >= F.lit(oldest - timedelta(seconds=window_seconds)))
    (fresh,) = unused(batch, "__of_batch")
    both = seen.withColumn(fresh, F.lit(False)).unionByName(batch.withColumn(fresh, F.lit(True)), allowMissingColumns=True)
    return duplicate_decisions(batch, both, window_seconds, fresh=fresh, **options)


def flag_pairs(decisions: DataFrame) -> DataFrame:
    """(id, duplicate_of) for both rows of each pair, as flags go on both."""
    both = F.explode(F.array(F.struct(F.col("id").alias("id"), F.col("duplicate_of").alias("of")), F.struct(F.col("duplicate_of").alias("id"), F.col("id").alias("of"))))
    return decisions.select(both.alias("p")).select("p.id", F.col("p.of").alias("duplicate_of")).groupBy("id").agg(F.min("duplicate_of").alias("duplicate_of"))
