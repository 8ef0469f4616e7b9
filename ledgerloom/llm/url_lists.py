"""URL filter lists as of the time of capture.

A list is a log of dated entries: (list_name, kind, value, action, listed_at), kind url, host or
domain, action block, allow or remove. An entry holds from its date until the next entry for the
same list, kind and value. An as-of join gives every capture the entries that were active when it
was fetched: the capture's url, host and enclosing domains are equi-join keys, the interval is the
residual condition. The most specific active entry decides; of equally specific ones block wins,
then the latest, then the list's name. Without an active entry a capture is allowed.

Everything is DataFrame operations. Entries without value or date are ignored; of entries for one
key and instant, remove wins over block and block over allow. Captures with a null url or time
match nothing and are allowed. Repeated captures come back as often as they are; further columns
of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spread

#: Up to so many intervals (about 150 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_INTERVALS = 200_000


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def plain_url(url: Column) -> Column:
    """Host and path without scheme, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, kind, value, action, valid_from, valid_to): block and allow entries with the time they hold."""
    rank = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    known = entries.where(F.col("value").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("block", "allow", "remove"))
    one = known.groupBy("list_name", "kind", "value", "listed_at").agg(F.max_by("action", rank).alias("action"))
    log = Window.partitionBy("list_name", "kind", "value").orderBy("listed_at")
    held = one.withColumn("valid_to", F.lead("listed_at").over(log)).where("action <> 'remove'")
    return held.select("list_name", "kind", "value", "action", F.col("listed_at").alias("valid_from"), "valid_to")


def capture_keys(url: Column) -> Column:
    """Array of (kind, value, specificity): the url, the host and every enclosing domain."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    ends = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(ends, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"), (F.size(labels) - i + 1).cast("int").alias("specificity")))
    own = F.array(
        F.struct(F.lit("url").alias("kind"), plain_url(url).alias("value"), F.lit(1001).alias("specificity")),
        F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(1000).alias("specificity")),
    )
    return F.when(host.isNotNull(), F.concat(own, domains))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, host, n_active, decision, list_name, kind, value, valid_from) for every capture (page_id, url, fetched_at)."""
    held = spread(intervals(entries))
    if held.count() <= MAX_BROADCAST_INTERVALS:
        held = F.broadcast(held)
    # repeated captures are looked up once
    rows = captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    keyed = rows.select("*", F.explode_outer(capture_keys(F.col("url"))).alias("key")).select("page_id", "url", "fetched_at", "copies", F.col("key.kind").alias("k"), F.col("key.value").alias("v"), F.col("key.specificity").alias("s"))
    active = (F.col("k") == F.col("kind")) & (F.col("v") == F.col("value")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    met = keyed.join(held, active, "left")
    choice = F.struct("s", (F.col("action") == "block").cast("int").alias("b"), "valid_from", "list_name", "kind", "value")
    best = met.groupBy("page_id", "url", "fetched_at").agg(F.max(F.when(F.col("action").isNotNull(), choice)).alias("best"), F.count("action").alias("n_active"), F.max("copies").alias("copies"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    decision = F.when(F.col("best.b") == 1, "block").otherwise("allow")
    return out.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), "n_active", decision.alias("decision"), *(F.col(f"best.{c}").alias(c) for c in ("list_name", "kind", "value", "valid_from")))
