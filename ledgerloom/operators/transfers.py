"""Internal transfers: pairing of outgoing and incoming legs, and near matches that cannot be paired.

Pairing must see the whole live ledger; filters belong after it. The choice is greedy: pairs of equal
references first, then by time and id of the outgoing leg, then by the incoming id. Two pairs can compete
only within equal money, so each (currency, amount) is a problem of its own, and there each stretch of
days without a gap. A problem is a sorted stream that one pass settles: an outgoing leg is decided once
the stream is past its window, and takes the smallest incoming id in the window that is free. No list
of candidates is made; a pass holds the legs of two windows (more if ids do not grow with time), and costs
the logarithm of that a leg.

Near matches are found by passes of the same kind, over equal money for legs without instrument, and
over days for legs of different currencies.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

WINDOW_SECONDS = 24 * 3600


def reference_key(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def _micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def _legs(transactions: DataFrame) -> DataFrame:
    live = transactions.where("NOT is_deleted AND occurred_at IS NOT NULL AND type IN ('transfer_out', 'transfer_in')")
    return live.select("id", "amount", "currency", (F.col("type") == "transfer_out").alias("leaves"), "occurred_at", _micros("occurred_at").alias("at"), "instrument_id", reference_key(F.col("reference")).alias("reference"))


def transfer_candidates(transactions: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(out_id, in_id, evidence): all pairs of legs that could be one transfer, as many as there are.

    Legs meet by money and day; an incoming leg is looked for on the day of the outgoing one and those next to it.
    """
    span = window_seconds * 1_000_000
    legs = _legs(transactions).where("instrument_id IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / span))
    out = legs.where("leaves").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).alias("o")
    into = legs.where("NOT leaves").alias("i")
    near = (F.col("o.instrument_id") != F.col("i.instrument_id")) & (F.abs(F.col("o.at") - F.col("i.at")) <= span)
    met = out.join(into, (F.col("o.currency") == F.col("i.currency")) & (F.col("o.amount") == F.col("i.amount")) & (F.col("o.bucket") == F.col("i.bucket")) & near)
    evidence = F.when(F.col("o.reference") == F.col("i.reference"), "reference_match").otherwise("amount_and_time")
    return met.select(F.col("o.id").alias("out_id"), F.col("i.id").alias("in_id"), evidence.alias("evidence"))


class Shelf:
    """Legs of a sliding window; tells the smallest id that is not of a given instrument."""

    def __init__(self) -> None:
        self.by_instrument: dict[object, list[tuple[int, int]]] = defaultdict(list)
        self.tops: list[tuple[int, object]] = []
        self.used: set[int] = set()

    def add(self, leg: int, instrument: object, at: int) -> None:
        ids = self.by_instrument[instrument]
        heapq.heappush(ids, (leg, at))
        if ids[0][0] == leg:
            heapq.heappush(self.tops, (leg, instrument))

    def _top(self, instrument: object, oldest: int) -> int | None:
        ids = self.by_instrument[instrument]
        while ids and (ids[0][1] < oldest or ids[0][0] in self.used):
            self.used.discard(heapq.heappop(ids)[0])
        return ids[0][0] if ids else None

    def smallest(self, instrument: object, oldest: int) -> int | None:
        """Of the legs not older than ``oldest`` (which must not fall from call to call) and of another instrument."""
        aside = None
        while self.tops:
            leg, other = self.tops[0]
            now = self._top(other, oldest)
            if now != leg:  # taken or too old: the next of its instrument stands in
                heapq.heappop(self.tops)
                if now is not None:
                    heapq.heappush(self.tops, (now, other))
                elif not self.by_instrument[other]:
                    del self.by_instrument[other]
                continue
            if other != instrument:
                break
            heapq.heappop(self.tops)
            if aside is None:
                aside = (leg, other)
        found = self.tops[0][0] if self.tops else None
        if aside is not None:
            heapq.heappush(self.tops, aside)
        return found

    def take(self, leg: int) -> None:
        self.used.add(leg)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, tuple]]:
    """(is this the first row of its group, row) over sorted batches of (group, at, id, leaves, instrument, currency)."""
    last = None
    for pdf in batches:
        instruments = [None if x is None else x for x in pdf["instrument"].tolist()]
        for row in zip(pdf["group"].tolist(), pdf["at"].tolist(), pdf["id"].tolist(), pdf["leaves"].tolist(), instruments, pdf["currency"].tolist(), strict=True):
            yield row[0] != last, row
            last = row[0]


def _tables(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pd.DataFrame(part, columns=names)
            part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def _pairing(span: int):
    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
        waiting, shelf = deque(), Shelf()

        def settle(until: int | None) -> Iterator[tuple[int, int]]:
            while waiting and (until is None or waiting[0][0] + span < until):
                at, leg, instrument = waiting.popleft()
                found = shelf.smallest(instrument, at - span)
                if found is not None:
                    shelf.take(found)
                    yield leg, found

        for new, (_, at, leg, leaves, instrument, _) in _groups(batches):
            if new:
                yield from settle(None)
                shelf = Shelf()
            yield from settle(at)
            if leaves:
                waiting.append((at, leg, instrument))
            else:
                shelf.add(leg, instrument, at)
        yield from settle(None)

    return lambda batches: _tables(pair(batches), ["out_id", "in_id"])


def _streamed(legs: DataFrame, keys: list[Column], currency: Column | None = None) -> DataFrame:
    """Legs as streams: a group in one partition, in order of time and id; the sort spills, nothing is collected."""
    rows = legs.select(F.concat_ws("|", *keys).alias("group"), "at", "id", "leaves", F.col("instrument_id").cast("string").alias("instrument"), (F.lit("") if currency is None else currency).alias("currency"))
    n = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group").sortWithinPartitions("group", "at", "id")


def _islands(legs: DataFrame, span: int) -> DataFrame:
    """Adds ``island``: within equal money, days that have legs and no empty day between them have one number."""
    bucket = F.floor(F.col("at") / span)
    days = legs.select("currency", "amount", bucket.alias("bucket")).distinct()
    over = Window.partitionBy("currency", "amount").orderBy("bucket")
    opens = F.when(F.col("bucket") - F.lag("bucket").over(over) <= 1, 0).otherwise(1)
    numbered = days.withColumn("opens", opens).withColumn("island", F.sum("opens").over(over)).drop("opens")
    return legs.withColumn("bucket", bucket).join(numbered, ["currency", "amount", "bucket"]).drop("bucket")


def pair_transfers(transactions: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(out_id, in_id, evidence, state, group_id): a one-to-one choice of candidates.

    Legs without time, instrument, amount or currency are not paired. Ids are taken to be unique.
    """
    span = window_seconds * 1_000_000
    legs = cut(_islands(_legs(transactions).where("instrument_id IS NOT NULL AND amount IS NOT NULL AND currency IS NOT NULL"), span))
    money = [F.col("currency"), F.col("amount").cast("string"), F.col("island").cast("string")]
    schema = "out_id bigint, in_id bigint"
    told = legs.where("reference IS NOT NULL")
    sure = cut(_streamed(told, [*money, F.col("reference")]).mapInPandas(_pairing(span), schema))
    paired = sure.select(F.explode(F.array("out_id", "in_id")).alias("id"))
    rest = _streamed(legs.join(paired, "id", "left_anti"), money).mapInPandas(_pairing(span), schema)
    found = sure.withColumn("evidence", F.lit("reference_match")).unionByName(rest.withColumn("evidence", F.lit("amount_and_time")))
    state = F.when(F.col("evidence") == "reference_match", "internal").otherwise("candidate")
    return cut(found.select("out_id", "in_id", "evidence", state.alias("state"), F.concat_ws(":", F.lit("itl"), "out_id", "in_id").alias("group_id")))


def _nearest(span: int, crossing: bool):
    """For each leg that asks, the smallest id within the window of a leg that goes the other way and almost fits.

    ``crossing``: one of another currency and instrument; else one of which, other than of the asking leg,
    the instrument is known or not known. A leg asks once the stream is past its window.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
        waiting, shelves = deque(), defaultdict(Shelf)

        def settle(until: int | None) -> Iterator[tuple[int, int]]:
            while waiting and (until is None or waiting[0][0] + span < until):
                at, leg, leaves, instrument, currency = waiting.popleft()
                if crossing:
                    places = [k for k in shelves if k[0] != leaves and k[1] != currency]
                else:
                    places = [(not leaves, instrument is not None)]
                found = [x for k in places if (x := shelves[k].smallest(instrument if crossing else "", at - span)) is not None]
                if found:
                    yield leg, min(found)

        for new, (_, at, leg, leaves, instrument, currency) in _groups(batches):
            if new:
                yield from settle(None)
                shelves.clear()
            yield from settle(at)
            own = leg >= 0
            if own:
                waiting.append((at, leg, leaves, instrument, currency))
            leg = leg if own else -1 - leg
            if crossing:
                shelves[leaves, currency].add(leg, instrument, at)
            else:
                shelves[leaves, instrument is None].add(leg, instrument or " ", at)
        yield from settle(None)

    return lambda batches: _tables(look(batches), ["id", "partner"])


def near_matches(transactions: DataFrame, pairs: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(id, reason) of unpaired legs with a partner that almost fits.

    cross_currency_near_match: both instruments are known and differ, and so do the currencies;
    unresolved_instrument: the money is equal and one of the two has no instrument. Of several reasons
    that of the partner with the smallest id counts. Ids must not be negative.
    """
    span = window_seconds * 1_000_000
    paired = pairs.select(F.explode(F.array("out_id", "in_id")).alias("id"))
    legs = cut(_legs(transactions).where("amount IS NOT NULL AND currency IS NOT NULL").join(paired, "id", "left_anti"))
    schema = "id bigint, partner bigint"
    money = _islands(legs, span)
    unknown = _streamed(money, [F.col("currency"), F.col("amount").cast("string"), F.col("island").cast("string")]).mapInPandas(_nearest(span, False), schema)
    # a day's task also gets the legs of the days next to it, as negative ids: they are found there but do not ask
    bucket = F.floor(F.col("at") / span)
    place = F.explode(F.array(*(F.struct((bucket + d).cast("string").alias("day"), F.lit(d == 0).alias("own")) for d in (-1, 0, 1))))
    dealt = legs.where("instrument_id IS NOT NULL").withColumn("p", place).withColumn("id", F.when(F.col("p.own"), F.col("id")).otherwise(-1 - F.col("id")))
    crossing = _streamed(dealt, [F.col("p.day")], F.col("currency")).mapInPandas(_nearest(span, True), schema)
    both = crossing.withColumn("reason", F.lit("cross_currency_near_match")).unionByName(unknown.withColumn("reason", F.lit("unresolved_instrument")))
    return both.groupBy("id").agg(F.min_by("reason", "partner").alias("reason"))


def analyse_transfers(transactions: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The rows with ``derived_state``, ``derived_group`` and ``unpairable_reason``, over the whole ledger.

    A persisted state hides the derived one and any reason, but the row takes part in pairing.
    """
    pairs = pair_transfers(transactions, window_seconds)
    legs = pairs.select(F.explode(F.array("out_id", "in_id")).alias("id"), F.col("state").alias("derived_state"), F.col("group_id").alias("derived_group"))
    reasons = near_matches(transactions, pairs, window_seconds).select("id", F.col("reason").alias("unpairable_reason"))
    joined = transactions.join(legs, "id", "left").join(reasons, "id", "left")
    return joined.withColumn("unpairable_reason", F.when(F.col("transfer_state").isNull(), F.col("unpairable_reason")))


def review_inbox(analysed: DataFrame) -> DataFrame:
    """(id, item, reason): transfers to confirm and transfers that could not be paired."""
    state = F.coalesce("transfer_state", "derived_state")
    open_ = analysed.where(~F.col("is_deleted") & (state == "candidate")).select("id", F.lit("candidate").alias("item"), F.lit(None).cast("string").alias("reason"))
    rest = analysed.where(~F.col("is_deleted") & F.col("unpairable_reason").isNotNull()).select("id", F.lit("unpairable").alias("item"), F.col("unpairable_reason").alias("reason"))
    return open_.unionByName(rest)
