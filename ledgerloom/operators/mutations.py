"""Changes of the ledger as versioned DataFrame transforms: new rows replace old ones, keyed by id.

A change is a DataFrame with one row for each id it touches. What the user has set is protected
from automatic changes; every change can be recorded as field differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, merchant_key, script_of
from ..schema import MAX_BROADCAST_CATEGORIES, UNCATEGORIZED
from .lineage import cut, numbered, small

CATEGORY_FLAGS = ("low_confidence", "unknown_merchant", "known_merchant_without_rule")
DUPLICATE_FLAGS = ("possible_duplicate", "possible_authorisation_posting_pair")
EDITABLE = ("amount", "currency", "merchant_text", "occurred_at", "direction", "type", "reference", "counterparty_name", "instrument_id", "category_id")


def _changed(transactions: DataFrame, changes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows beside their change: columns of the change get the given names, ``__hit`` says if there is one."""
    c = changes.select("id", *(F.col(k).alias(v) for k, v in names.items()), F.lit(True).alias("__hit"))
    return transactions.join(c, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def _protect(field: str) -> Column:
    return F.array_sort(F.array_union(F.coalesce("user_edited", F.array().cast("array<string>")), F.array(F.lit(field))))


def is_protected(field: str) -> Column:
    return F.coalesce(F.array_contains("user_edited", field), F.lit(False))


def set_category_by_user(transactions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, category_id): source user, confidence 1, no rule, the field protected, category flags cleared."""
    rows = _changed(transactions, changes, {"category_id": "__category"})
    hit = F.col("__hit")
    flagged = hit & F.coalesce(F.col("review_reason").isin(*CATEGORY_FLAGS), F.lit(False))
    out = rows.withColumns(
        {
            "category_id": F.when(hit, F.nullif("__category", F.lit(UNCATEGORIZED))).otherwise(F.col("category_id")),
            "category_source": F.when(hit, "user").otherwise(F.col("category_source")),
            "category_confidence": F.when(hit, 1.0).otherwise(F.col("category_confidence")),
            "category_rule_id": F.when(~hit, F.col("category_rule_id")),
            "user_edited": F.when(hit, _protect("category_id")).otherwise(F.col("user_edited")),
            "needs_review": F.when(flagged, False).otherwise(F.col("needs_review")),
            "review_reason": F.when(~flagged, F.col("review_reason")),
        }
    )
    return out.select(*transactions.columns)


def set_category_automatically(transactions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, category_id, rule_id, confidence, reason): nothing where the user decided; a reason flags, but replaces no other."""
    rows = _changed(transactions, changes, {"category_id": "__category", "rule_id": "__rule", "confidence": "__confidence", "reason": "__reason"})
    free = F.col("__hit") & ~F.coalesce(F.col("category_source") == "user", F.lit(False)) & ~is_protected("category_id")
    flag = free & F.col("__reason").isNotNull()
    out = rows.withColumns(
        {
            "category_source": F.when(free, F.when(F.col("__category").isNotNull(), "rule")).otherwise(F.col("category_source")),
            "category_id": F.when(free, F.col("__category")).otherwise(F.col("category_id")),
            "category_rule_id": F.when(free, F.col("__rule")).otherwise(F.col("category_rule_id")),
            "category_confidence": F.when(free, F.col("__confidence")).otherwise(F.col("category_confidence")),
            "needs_review": F.col("needs_review") | flag,
            "review_reason": F.when(flag, F.coalesce("review_reason", "__reason")).otherwise(F.col("review_reason")),
        }
    )
    return out.select(*transactions.columns)


def soft_delete(transactions: DataFrame, ids: DataFrame, at) -> DataFrame:
    rows = _changed(transactions, ids, {})
    new = F.col("__hit") & ~F.col("is_deleted")
    return rows.withColumns({"deleted_at": F.when(new, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at")), "is_deleted": F.col("is_deleted") | new}).select(*transactions.columns)


def restore(transactions: DataFrame, ids: DataFrame) -> DataFrame:
    """Undeletes rows and mends merge pointers: the survivor names its latest row that is still absorbed."""
    rows = _changed(transactions, ids, {})
    back = F.col("__hit") & F.col("is_deleted")
    survivors = rows.where(back & F.col("merged_into").isNotNull()).select(F.col("merged_into").alias("id")).distinct().withColumn("__touched", F.lit(True))
    out = rows.withColumns({"merged_into": F.when(~back, F.col("merged_into")), "deleted_at": F.when(~back, F.col("deleted_at")), "is_deleted": F.col("is_deleted") & ~back}).drop("__hit")
    absorbed = out.where("is_deleted AND merged_into IS NOT NULL").groupBy(F.col("merged_into").alias("id")).agg(F.max_by("id", F.struct("deleted_at", "id")).alias("__latest"))
    fixed = out.join(survivors, "id", "left").join(absorbed, "id", "left")
    return fixed.withColumn("merged_from", F.when(F.col("__touched"), F.col("__latest")).otherwise(F.col("merged_from"))).select(*transactions.columns)


def edit(transactions: DataFrame, edits: DataFrame, fields: tuple[str, ...] = EDITABLE) -> DataFrame:
    """edits (id, set array<string>, values of the fields): only fields named in ``set`` that differ change, and are then protected."""
    rows = _changed(transactions, edits, {"set": "__set", **{f: f"__new_{f}" for f in fields}})
    differs = {f: F.col("__hit") & F.array_contains("__set", f) & ~F.col(f).eqNullSafe(F.col(f"__new_{f}")) for f in fields}
    named = F.array_compact(F.array(*(F.when(d, F.lit(f)) for f, d in differs.items())))
    rows = rows.withColumn("__named", named)
    out = rows.withColumns({f: F.when(F.array_contains("__named", f), F.col(f"__new_{f}")).otherwise(F.col(f)) for f in fields})
    protected = F.when(F.size("__named") > 0, F.array_sort(F.array_union(F.coalesce("user_edited", F.array().cast("array<string>")), "__named"))).otherwise(F.col("user_edited"))
    return out.withColumn("user_edited", protected).select(*transactions.columns)


def field_changes(before: DataFrame, after: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, field_changes): JSON array of {field, from, to} for every row that changed."""
    b, a = before.alias("b"), after.alias("a")
    each = [F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("from"), F.col(f"a.{f}").cast("string").alias("to"))) for f in fields]
    joined = b.join(a, F.col("b.id") == F.col("a.id")).select(F.col("a.id").alias("id"), F.array_compact(F.array(*each)).alias("c"))
    return joined.where(F.size("c") > 0).select("id", F.to_json("c", {"ignoreNullFields": "false"}).alias("field_changes"))


def original_values(audit: DataFrame) -> DataFrame:
    """(entity_id, field, original): what each field held before the user first changed it."""
    mine = audit.where("action = 'update' AND actor = 'user'")
    each = mine.select("id", "entity_id", F.explode(F.from_json("field_changes", "array<struct<field:string,from:string,to:string>>")).alias("c"))
    return each.groupBy("entity_id", F.col("c.field").alias("field")).agg(F.min_by("c.from", "id").alias("original"))


def get_or_create(table: DataFrame, wanted: DataFrame, key: str, fill: tuple[str, ...] = ()) -> DataFrame:
    """Upsert on a unique key: known rows get their null ``fill`` columns filled, new keys are appended with ids after the last."""
    named = wanted.where(F.col(key).isNotNull())
    one = named.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(f"__{c}") for c in fill)) if fill else named.select(key).distinct()
    old = table.join(one, key, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in fill}).select(*table.columns)
    new = one.join(table.select(key), key, "left_anti")
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    # ids follow the order of keys
    fresh = numbered(new, key, name="__n").join(F.broadcast(last)).select((F.col("__last") + F.col("__n")).alias("id"), key, *(F.col(f"__{c}").alias(c) for c in fill))
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert_rules(rules: DataFrame, wanted: DataFrame, categories: DataFrame) -> DataFrame:
    """wanted (merchant_id, category_id, source), one row a merchant: a rule a merchant; unknown categories are refused.

    The category is taken over from any source, but a rule that was the user's stays the user's. New rules get
    ids after the last, in the order of merchants.
    """
    known = wanted.join(small(categories.select(F.col("id").alias("category_id")), MAX_BROADCAST_CATEGORIES), "category_id", "left_semi")
    w = known.select("merchant_id", F.col("category_id").alias("__category"), F.col("source").alias("__source"))
    old = rules.join(w, "merchant_id", "left")
    told = F.col("__source").isNotNull()
    source = F.when(told & ~F.coalesce(F.col("source") == "user", F.lit(False)), F.col("__source")).otherwise(F.col("source"))
    kept = old.withColumns({"category_id": F.when(told, F.col("__category")).otherwise(F.col("category_id")), "source": source}).select(*rules.columns)
    new = numbered(w.join(rules.select("merchant_id"), "merchant_id", "left_anti"), "merchant_id", name="__n")
    last = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # one row
    fresh = new.join(F.broadcast(last)).select((F.col("__last") + F.col("__n")).cast(rules.schema["id"].dataType).alias("id"), "merchant_id", F.col("__category").alias("category_id"), F.col("__source").alias("source"), F.lit(True).alias("is_enabled"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def link_aliases(aliases: DataFrame, wanted: DataFrame, order: str = "n") -> tuple[DataFrame, DataFrame]:
    """(``aliases`` and the new ones, ``wanted`` with ``status``): wanted (order, merchant_id, text).

    no_key: the text names no merchant; clash: its key is an alias already, of whichever merchant, or an earlier
    row takes it. What is refused changes nothing.
    """
    keyed = wanted.withColumns({"alias_key": merchant_key(F.col("text")), "script": script_of(F.col("text"))})
    first = keyed.where("alias_key IS NOT NULL").groupBy("alias_key").agg(F.min(order).alias("__first"))
    held = aliases.select("alias_key", F.lit(True).alias("__held")).distinct()
    status = F.when(F.col("alias_key").isNull(), "no_key").when(F.coalesce("__held", F.lit(False)) | (F.col(order) != F.col("__first")), "clash").otherwise("linked")
    told = keyed.join(first, "alias_key", "left").join(held, "alias_key", "left").withColumn("status", status).drop("__first", "__held")
    new = told.where("status = 'linked'").select("merchant_id", "alias_key", "script").dropDuplicates(["alias_key"])
    return aliases.unionByName(new.select(*(c for c in new.columns if c in aliases.columns)), allowMissingColumns=True), told.select(*wanted.columns, "status")


def learn_from_choices(transactions: DataFrame, merchants: DataFrame, rules: DataFrame, categories: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, merchants, rules) after choices (id, category_id, learn), one a transaction.

    The category is the user's from now on. A transaction without a merchant whose text names one gets it, made
    if it is new. Where ``learn`` is true and the choice is a category, the merchant's rule becomes the user's;
    of several choices for a merchant that of the greatest transaction counts. Unknown ids change nothing.
    """
    chosen = cut(transactions.select("id", "merchant_id", merchant_key(F.col("merchant_text")).alias("merchant_key")).join(choices, "id"))
    open_ = chosen.where("merchant_id IS NULL AND merchant_key IS NOT NULL")
    all_merchants = cut(get_or_create(merchants, open_.select("merchant_key"), "merchant_key"))
    links = cut(open_.select("id", "merchant_key").join(all_merchants.select("merchant_key", F.col("id").alias("merchant_id")), "merchant_key").select("id", "merchant_id"))
    rows = link_merchants(set_category_by_user(transactions, chosen.select("id", "category_id")), links)
    known = chosen.drop("merchant_key").join(links.withColumnRenamed("merchant_id", "__own"), "id", "left").withColumn("merchant_id", F.coalesce("merchant_id", "__own"))
    taught = known.where(F.col("learn") & F.col("merchant_id").isNotNull() & F.nullif("category_id", F.lit(UNCATEGORIZED)).isNotNull())
    wanted = taught.groupBy("merchant_id").agg(F.max_by("category_id", "id").alias("category_id")).withColumn("source", F.lit("user"))
    return rows, all_merchants, upsert_rules(rules, wanted, categories)


def dismiss(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of these ids are no transactions: they leave the review queue and stay, so that they are known when they come again."""
    said = ids.select("id", F.lit(True).alias("__said")).distinct()
    rows = messages.join(said, "id", "left")
    return rows.withColumn("dismissed_as_not_transaction", F.coalesce("__said", "dismissed_as_not_transaction")).select(*messages.columns)


def link_settlement(instruments: DataFrame, links: DataFrame) -> DataFrame:
    """links (id, account_id, source): the first observation stands unless the user says otherwise."""
    rows = instruments.join(links.select("id", F.col("account_id").alias("__to"), F.col("source").alias("__by")), "id", "left")
    take = F.col("__to").isNotNull() & (F.col("settlement_account_id").isNull() | (F.col("__by") == "user"))
    return rows.withColumns({"settlement_account_id": F.when(take, F.col("__to")).otherwise(F.col("settlement_account_id")), "link_source": F.when(take, F.col("__by")).otherwise(F.col("link_source"))}).select(*instruments.columns)


def _names_taken(categories: DataFrame, name: str, but: str | None = None) -> bool:
    same = categories.where((fold(F.col("name_en")) == fold(F.lit(name))) & (F.col("id") != F.lit(but or "")))
    return not same.isEmpty()


def create_category(categories: DataFrame, category: str, group: str, name: str) -> DataFrame:
    """``categories`` with a further one, last of its group's order; a blank or taken name or id is refused."""
    if not name.strip() or _names_taken(categories, name) or not categories.where(F.col("id") == category).isEmpty():
        raise ValueError(f"category {category} cannot be created: its id or name is blank or taken")
    last = categories.where(F.col("group_key") == group).agg(F.coalesce(F.max("sort_order"), F.lit(-1)).alias("last"))
    made = {"id": F.lit(category), "group_key": F.lit(group), "name_en": F.lit(name.strip()), "is_protected": F.lit(False), "is_archived": F.lit(False), "sort_order": F.col("last") + 1}
    row = last.select(*(made.get(c, F.lit(None)).cast(categories.schema[c].dataType).alias(c) for c in categories.columns))
    return categories.unionByName(row)


def rename_category(categories: DataFrame, category: str, name: str) -> DataFrame:
    """``categories`` with a new name for one; protected or unknown categories and blank or taken names are refused."""
    row = categories.where(F.col("id") == category).first()
    if row is None or row["is_protected"] or not name.strip() or _names_taken(categories, name, category):
        raise ValueError(f"category {category} cannot be renamed")
    return categories.withColumn("name_en", F.when(F.col("id") == category, name.strip()).otherwise(F.col("name_en")))


def delete_category(transactions: DataFrame, rules: DataFrame, categories: DataFrame, category: str, reassign_to: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, rules, categories) without a category: its rows are reassigned or uncategorised, its rules follow or go."""
    row = categories.where(F.col("id") == category).first()
    if row is None or row["is_protected"]:
        raise ValueError(f"category {category} cannot be deleted")
    target = None if reassign_to == UNCATEGORIZED else reassign_to
    mine = F.coalesce(F.col("category_id") == category, F.lit(False))
    rows = transactions.withColumn("category_id", F.when(mine, F.lit(target).cast("string")).otherwise(F.col("category_id")))
    kept = rules.withColumn("category_id", F.when(mine, F.lit(target).cast("string")).otherwise(F.col("category_id"))).where("category_id IS NOT NULL")
    return rows, kept, categories.where(F.col("id") != category)


def fill_siblings(transactions: DataFrame, merchant_id: int, category: str, rule_id: int | None = None) -> DataFrame:
    """Gives all uncategorised live rows of a merchant its category; rows the user decided stay."""
    changes = transactions.where(f"NOT is_deleted AND merchant_id = {int(merchant_id)} AND category_id IS NULL").select("id", F.lit(category).alias("category_id"), F.lit(rule_id).cast("bigint").alias("rule_id"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("reason"))
    return set_category_automatically(transactions, changes)


def reapply_rules(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """Every enabled rule over the history of its merchant."""
    r = rules.where("is_enabled").select("merchant_id", F.col("category_id").alias("c"), F.col("id").alias("r"), F.col("source").alias("s"))
    changes = transactions.where("NOT is_deleted").select("id", "merchant_id").join(r, "merchant_id").select("id", F.col("c").alias("category_id"), F.col("r").alias("rule_id"), F.when(F.col("s") == "user", 1.0).otherwise(0.9).alias("confidence"), F.lit(None).cast("string").alias("reason"))
    return set_category_automatically(transactions, changes)


def undo(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows as the snapshot has them, others as they are."""
    return current.join(snapshot.select("id"), "id", "left_anti").unionByName(snapshot.select(*current.columns))


def discard_review(messages: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(messages without pending ones received before the cutoff, their number)."""
    from .filters import PENDING_REVIEW

    old = F.expr(PENDING_REVIEW) & (F.col("received_at") < F.lit(cutoff))
    return messages.where(~F.coalesce(old, F.lit(False))), messages.where(old).agg(F.count("*").alias("discarded"))


def flag_duplicates(transactions: DataFrame, pairs: DataFrame, reason: str = DUPLICATE_FLAGS[0]) -> DataFrame:
    """pairs (id, other_id): each id is flagged for review and names the other; of several, the smallest."""
    one = pairs.groupBy("id").agg(F.min("other_id").alias("other_id"))
    rows = _changed(transactions, one, {"other_id": "__other"})
    hit = F.col("__hit")
    out = rows.withColumns(
        {
            "needs_review": hit | F.coalesce("needs_review", F.lit(False)),
            "review_reason": F.when(hit, reason).otherwise(F.col("review_reason")),
            "duplicate_of": F.when(hit, F.col("__other")).otherwise(F.col("duplicate_of")),
        }
    )
    return out.select(*transactions.columns)


def resolve_duplicates(transactions: DataFrame, ids: DataFrame) -> DataFrame:
    """Both rows are kept: the flag and the pointer go. Rows flagged for something else stay as they are."""
    rows = _changed(transactions, ids, {})
    hit = F.col("__hit") & F.coalesce(F.col("needs_review") & F.col("review_reason").isin(*DUPLICATE_FLAGS), F.lit(False))
    out = rows.withColumns({"needs_review": F.col("needs_review") & ~hit, "review_reason": F.when(~hit, F.col("review_reason")), "duplicate_of": F.when(~hit, F.col("duplicate_of"))})
    return out.select(*transactions.columns)


def decide_transfers(transactions: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (id, state, group_id): what the user says of a transfer. Only a confirmed pair keeps its group; review ends."""
    rows = _changed(transactions, decisions, {"state": "__state", "group_id": "__group"})
    hit = F.col("__hit")
    out = rows.withColumns(
        {
            "transfer_state": F.when(hit, F.col("__state")).otherwise(F.col("transfer_state")),
            "transfer_group": F.when(hit, F.when(F.col("__state") == "internal", F.col("__group"))).otherwise(F.col("transfer_group")),
            "needs_review": F.col("needs_review") & ~hit,
            "review_reason": F.when(~hit, F.col("review_reason")),
        }
    )
    return out.select(*transactions.columns)


def link_merchants(transactions: DataFrame, links: DataFrame) -> DataFrame:
    """links (id, merchant_id)."""
    rows = _changed(transactions, links, {"merchant_id": "__merchant"})
    return rows.withColumn("merchant_id", F.when(F.col("__hit"), F.col("__merchant")).otherwise(F.col("merchant_id"))).select(*transactions.columns)


def absorbed_by(transactions: DataFrame, survivor: Column | int) -> DataFrame:
    """Rows merged into a survivor and deleted, the latest first."""
    return transactions.where((F.col("merged_into") == survivor) & F.col("is_deleted")).orderBy(F.desc("deleted_at"), F.desc("id"))
