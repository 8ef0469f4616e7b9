"""Hash-chained audit log.

Each entry's hash covers the hash before it and the entry, so entries are chained one after the other.
Spark writes the entries as JSON and numbers them; one task sees number and JSON only, as a stream, and
the hashes are joined to the entries by number. Verification looks one row back and is parallel.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from .lineage import numbered

GENESIS = "GENESIS"


def payload() -> Column:
    """Canonical JSON of an entry, its keys in a fixed order."""
    at = F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    changes = F.from_json("field_changes", "array<struct<field:string,from:string,to:string>>")
    row = F.struct(F.col("entity_type").alias("entityType"), F.col("entity_id").alias("entityId"), "action", "actor", F.col("actor_detail").alias("actorDetail"), at.alias("changedAt"), F.coalesce(changes, F.array().cast("array<struct<field:string,from:string,to:string>>")).alias("fieldChanges"))
    return F.to_json(row, {"ignoreNullFields": "false"})


def entries(before: DataFrame, after: DataFrame, touched: DataFrame, fields: dict[str, str], action: str, actor: str, at: Column, detail: str | None = None, entity: str = "transaction", only_changed: bool = True) -> DataFrame:
    """Entries for the ids of ``touched`` between two versions of a table, ready for ``append``.

    ``fields``: columns and their names in the log, in the order in which they are listed. With ``only_changed``
    fields that are the same in both versions are left out, and so are entries without any.
    """
    ids = touched.select("id").distinct()
    old, new = (df.select("id", *(F.col(c).cast("string").alias(f"{part}_{c}") for c in fields)) for part, df in (("old", before), ("new", after)))
    both = ids.join(old, "id").join(new, "id")
    change = lambda c, name: F.struct(F.lit(name).alias("field"), F.col(f"old_{c}").alias("from"), F.col(f"new_{c}").alias("to"))
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    listed = F.array_compact(F.array(*(F.when(differs(c), change(c, name)) if only_changed else change(c, name) for c, name in fields.items())))
    rows = both.withColumn("changes", listed).where(F.size("changes") > 0)
    return rows.select(
        F.col("id").alias("seq"), F.lit(entity).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit(action).alias("action"), F.lit(actor).alias("actor"),
        F.lit(detail).cast("string").alias("actor_detail"), at.alias("changed_at"), F.to_json("changes", {"ignoreNullFields": "false"}).alias("field_changes"),
    )


def categorised_by_user(before: DataFrame, after: DataFrame, choices: DataFrame, at: Column, detail: str | None = None) -> DataFrame:
    """An entry for every choice, also for one that confirms what was there."""
    return entries(before, after, choices, {"category_id": "categoryId", "category_source": "categorySource"}, "categorize", "user", at, detail, only_changed=False)


def categorised_by_rule(before: DataFrame, after: DataFrame, changes: DataFrame, at: Column, detail: str) -> DataFrame:
    """Entries for rows that a rule gave another category than they had; rows that lost theirs have none."""
    old, new = before.select("id", F.col("category_id").alias("old")), after.where("category_id IS NOT NULL").select("id", F.col("category_id").alias("new"))
    touched = changes.select("id").join(old, "id").join(new, "id").where("NOT (old <=> new)")
    return entries(before, after, touched, {"category_id": "categoryId", "category_confidence": "categoryConfidence"}, "categorize", "system_rule", at, detail, only_changed=False)


def deleted(before: DataFrame, after: DataFrame, ids: DataFrame, at: Column, actor: str = "user", detail: str | None = None) -> DataFrame:
    return entries(before, after, ids, {"is_deleted": "isDeleted"}, "delete", actor, at, detail, only_changed=False)


def restored(before: DataFrame, after: DataFrame, ids: DataFrame, at: Column, actor: str = "user", detail: str | None = None) -> DataFrame:
    return entries(before, after, ids, {"is_deleted": "isDeleted", "merged_into": "mergedIntoId"}, "restore", actor, at, detail)


# Names of a transaction's fields in the log.
FIELDS = {
    "amount": "amount", "currency": "currency", "merchant_text": "merchantRawText", "occurred_at": "occurredAt", "direction": "direction", "type": "transactionType",
    "reference": "referenceNumber", "counterparty_name": "counterpartyName", "instrument_id": "instrumentId", "category_id": "categoryId",
}


def edited(before: DataFrame, after: DataFrame, edits: DataFrame, at: Column, detail: str = "manual_edit") -> DataFrame:
    """Entries for edits that changed anything, with the fields that did."""
    return entries(before, after, edits, FIELDS, "update", "user", at, detail)


def append(entries: DataFrame, key: bytes, last_hash: str = GENESIS, last_id: int = 0) -> DataFrame:
    """entries (seq and the fields of an entry) with id, prev_hash and entry_hash, chained by seq after the last one.

    Entries of one seq are chained in the order of their JSON. A chain has one writer.
    """
    names = ["entity_type", "entity_id", "action", "actor", "actor_detail", "changed_at", "field_changes"]
    ready = entries.withColumn("changed_at", F.date_trunc("second", "changed_at")).withColumn("payload", payload()).select("seq", *names, "payload")
    placed = numbered(ready, "seq", "payload", name="id")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = last_hash
        for batch in batches:
            before, after = [], []
            for text in batch["payload"]:
                before.append(last)
                last = hmac.new(key, f"{last}|{text}".encode(), hashlib.sha256).hexdigest()
                after.append(last)
            yield pd.DataFrame({"id": batch["id"], "prev_hash": before, "entry_hash": after})

    hashes = placed.select("id", "payload").repartition(1).sortWithinPartitions("id").mapInPandas(chain, "id bigint, prev_hash string, entry_hash string")
    return placed.join(hashes, "id").select((F.col("id") + last_id).alias("id"), *names, "prev_hash", "entry_hash")


def verify(audit: DataFrame, key: bytes, block: int = 1_000_000) -> DataFrame:
    """(id, linked, intact): does the entry name the hash before it, and does its own hash fit its content.

    Ids are cut into blocks that are looked at in parallel; the last hash of each block is handed on.
    """
    rows = audit.withColumn("__block", F.floor(F.col("id") / block))
    ends = rows.groupBy("__block").agg(F.max_by("entry_hash", "id").alias("__end"))
    handed = ends.withColumn("__carry", F.lag("__end").over(Window.partitionBy().orderBy("__block")))  # one row a block
    inside = F.lag("entry_hash").over(Window.partitionBy("__block").orderBy("id"))
    expected = F.coalesce("__inside", "__carry", F.lit(GENESIS))
    joined = rows.withColumn("__inside", inside).join(handed.select("__block", "__carry"), "__block", "left")
    own = hmac_sha256(key, F.concat_ws("|", "prev_hash", payload()))
    return joined.select("id", (F.col("prev_hash") == expected).alias("linked"), (F.col("entry_hash") == own).alias("intact"))
