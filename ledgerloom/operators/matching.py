"""Matching merchant texts to known merchants: exact key, then tokens, then edits.

The exact tier is an equi-join. Only what it leaves is compared by similarity: with the token tier
by joining on shared tokens, and with the edit tier by joining on what is left of two keys when they
lose as many characters as edits are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import AUTO_APPLY, EDIT_CEILING, EDIT_FLOOR, MIN_FUZZY_CHARS, TOKEN_FLOOR, edit_ratio, multiset_jaccard, token_confidence
from ..schema import MAX_BROADCAST_CATEGORIES
from .lineage import cut, small

#: Pairs of lengths of keys (12 bytes each) are broadcast up to this number.
MAX_BROADCAST_LENGTHS = 200_000


def merchant_candidates(merchants: DataFrame, aliases: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """(merchant_id, merchant_key, alias_keys, category_id, rule_id, rule_source): merchants with their aliases and enabled rule of a known category."""
    names = aliases.groupBy("merchant_id").agg(F.sort_array(F.collect_set("alias_key")).alias("alias_keys"))
    known = rules.where("is_enabled").join(small(categories.select(F.col("id").alias("category_id")), MAX_BROADCAST_CATEGORIES), "category_id", "left_semi")
    rule = known.select("merchant_id", "category_id", F.col("id").alias("rule_id"), F.col("source").alias("rule_source"))
    out = merchants.withColumnRenamed("id", "merchant_id").join(names.hint("merge"), "merchant_id", "left").join(rule.hint("merge"), "merchant_id", "left")
    return out.select("merchant_id", "merchant_key", F.coalesce("alias_keys", F.array().cast("array<string>")).alias("alias_keys"), "category_id", "rule_id", "rule_source")


def rules_listed(rules: DataFrame, merchants: DataFrame) -> DataFrame:
    """Rules with their merchant's key, the latest first; rules without a merchant are left out."""
    return rules.join(merchants.select(F.col("id").alias("merchant_id"), "merchant_key"), "merchant_id").orderBy(F.desc("updated_at"), "id")


def match_merchants(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, key, tier, merchant_id, category_id, rule_id, confidence, auto_apply) for (id, key).

    An exact match ends the search even without a rule: its tier is then ``none`` and it names the
    merchant. Fuzzy tiers need a key of at least four characters and a candidate with a rule.
    """
    keyed = texts.where("key IS NOT NULL").select("id", "key")
    names = candidates.select("*", F.explode(F.array_distinct(F.concat(F.array("merchant_key"), "alias_keys"))).alias("name"))
    # sizes of what these joins meet can't be told from the files' sizes, so none is left to be broadcast by estimate
    exact = names.groupBy("name").agg(F.min(F.struct("merchant_id", "category_id", "rule_id", "rule_source")).alias("m"))
    met = cut(keyed.join(exact.hint("merge"), F.col("key") == F.col("name"), "left").drop("name"))
    known = F.col("m.rule_id").isNotNull()
    source = F.coalesce(F.col("m.rule_source") == "user", F.lit(False))
    tier = F.when(known & source, "exact_user").when(known, "exact_seed").otherwise("none")
    confidence = F.when(known & source, 1.0).when(known, 0.9).otherwise(0.0)
    found = met.where("m IS NOT NULL").select("id", "key", tier.alias("tier"), F.col("m.merchant_id").alias("merchant_id"), F.col("m.category_id").alias("category_id"), F.col("m.rule_id").alias("rule_id"), confidence.alias("confidence"))
    rest = met.where("m IS NULL").where(F.char_length("key") >= MIN_FUZZY_CHARS).select("id", "key")
    keys = rest.select("key").distinct()
    ruled = cut(names.where("rule_id IS NOT NULL").where(F.char_length("name") >= MIN_FUZZY_CHARS).select("merchant_id", "category_id", "rule_id", "name"))
    # token tier: keys that share one of their rarest tokens
    frequency = ruled.select(F.explode(F.split("name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    shared = _rarest(keys, "key", frequency).join(_rarest(ruled, "name", frequency).hint("merge"), "token").drop("token").distinct()
    scored = shared.withColumn("jaccard", multiset_jaccard(F.split("key", " "), F.split("name", " "))).where(F.col("jaccard") >= TOKEN_FLOOR)
    best = scored.groupBy("key").agg(F.max_by(F.struct("merchant_id", "category_id", "rule_id", "jaccard"), F.struct("jaccard", F.char_length("name"), -F.col("merchant_id"))).alias("m"))
    by_token = cut(best.select("key", F.lit("token").alias("tier"), F.col("m.merchant_id").alias("merchant_id"), F.col("m.category_id").alias("category_id"), F.col("m.rule_id").alias("rule_id"), token_confidence(F.col("m.jaccard")).alias("confidence")))
    # edit tier: hashes of keys and of what is left of them meet; the texts come back for the pairs that are left
    open_ = cut(keys.join(by_token.select("key").hint("merge"), "key", "left_anti"))
    pairs = close_pairs(open_, ruled.select("name").distinct())
    texts_met = pairs.join(open_.select(F.xxhash64("key").alias("k"), "key").hint("merge"), "k").join(ruled.withColumn("n", F.xxhash64("name")).hint("merge"), "n")
    # a swap of neighbours is one edit here and two for the built-in distance
    close = F.levenshtein("key", "name") <= 2 * F.floor(F.greatest(F.char_length("key"), F.char_length("name")) / 10)
    near = texts_met.where(close).drop("k", "n")
    rated = near.withColumn("ratio", edit_ratio(F.col("key"), F.col("name"))).where(F.col("ratio") >= EDIT_FLOOR)
    best = rated.groupBy("key").agg(F.max_by(F.struct("merchant_id", "category_id", "rule_id", "ratio"), F.struct("ratio", -F.col("merchant_id"))).alias("m"))
    by_edit = best.select("key", F.lit("edit").alias("tier"), F.col("m.merchant_id").alias("merchant_id"), F.col("m.category_id").alias("category_id"), F.col("m.rule_id").alias("rule_id"), F.least(F.lit(EDIT_CEILING), EDIT_CEILING * F.col("m.ratio")).alias("confidence"))
    fuzzy = rest.join(by_token.unionByName(by_edit).hint("merge"), "key")
    out = found.unionByName(fuzzy.select(*found.columns))
    auto = F.col("category_id").isNotNull() & ~F.col("tier").isin("edit", "none") & (F.col("confidence") >= AUTO_APPLY)
    return out.withColumn("auto_apply", auto)


def _rarest(df: DataFrame, column: str, frequency: DataFrame) -> DataFrame:
    """Rows with each of the rarest tokens of a key, as many as two keys of Jaccard TOKEN_FLOOR cannot both lack.

    Of n tokens at least TOKEN_FLOOR * n are shared, so among the first n - ceil(TOKEN_FLOOR * n) + 1
    in a common order, rarest first, is one that both have.
    """
    words = F.split(column, " ")
    each = df.withColumn("__n", F.size(words)).withColumn("token", F.explode(words)).join(frequency.hint("merge"), "token", "left")
    place = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.coalesce("frequency", F.lit(0)), "token"))
    kept = each.withColumn("__place", place).where(F.col("__place") <= F.col("__n") - F.ceil(TOKEN_FLOOR * F.col("__n")) + 1)
    return kept.select(*df.columns, "token").distinct()


def close_pairs(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(k, n): hashes of keys and names that may be within the allowed edits, e = a tenth of the longer length.

    Only lengths that the other side has and that differ by at most e are looked at; below ten characters there is no edit.
    Up to two edits, both lose characters until length - e are left, in all ways, and meet where the same is left: a
    beginning that all names share brings no two together. With more edits the name is cut into e pieces. A swap across a
    cut touches both pieces, so at most 2 e - 1 edits are in them, and one piece has at most one. That piece and a window
    of its size in the key, moved by no more than the edits before and behind it allow, have the same left when
    they lose one character.
    """
    left = keys.select("key", F.char_length("key").alias("m"), F.xxhash64("key").alias("k"))
    right = names.select("name", F.char_length("name").alias("r"), F.xxhash64("name").alias("n"))
    longer = F.greatest("m", "r")
    # lengths are few: at most as many as the longest text has characters
    lengths = cut(left.select("m").distinct().crossJoin(F.broadcast(right.select("r").distinct())).select("m", "r", longer.alias("size"), F.floor(longer / 10).cast("int").alias("e")).where("e > 0 AND abs(m - r) <= e"))
    few, many = lengths.where("e <= 2"), lengths.where("e > 2")
    lost = [_left_over(t, text, label, n, few.select(n, "size", "e").distinct()) for t, text, label, n in ((left, "key", "k", "m"), (right, "name", "n", "r"))]
    at, width = F.floor(F.col("i") * F.col("r") / F.col("e")).cast("int"), (F.floor((F.col("i") + 1) * F.col("r") / F.col("e")) - F.floor(F.col("i") * F.col("r") / F.col("e"))).cast("int")
    piece = F.explode(F.expr("sequence(0, e - 1)"))
    cuts = right.join(small(many.select("r", "e").distinct(), MAX_BROADCAST_LENGTHS), "r").withColumn("i", piece).withColumns({"at": at, "w": width})
    # a character that no text has stands behind the key, for a window that ends one place behind it
    moves = F.explode(F.expr("sequence(least(0, m - r) - (e - abs(m - r)) div 2, greatest(0, m - r) + (e - abs(m - r)) div 2)").cast("array<int>"))
    moved = left.join(small(many.select("m", "r", "e"), MAX_BROADCAST_LENGTHS), "m").withColumn("i", piece).withColumns({"at": at, "w": width}).withColumn("move", moves)
    windows = moved.withColumn("at", F.col("at") + F.col("move")).where("at >= 0 AND at + w <= m + 1").withColumn("key", F.concat("key", F.lit("\0")))
    return (
        lost[0].join(lost[1].hint("merge"), "left").select("k", "n")
        .unionByName(_one_less(windows, "key", "k").join(_one_less(cuts, "name", "n").hint("merge"), "left").select("k", "n"))
        .distinct()
    )


def _left_over(df: DataFrame, text: str, label: str, length: str, sizes: DataFrame) -> DataFrame:
    """(label, left): hashes of what is left of a text of size - e characters, for e of at most 2; of equal neighbours the first goes."""
    sized = df.join(small(sizes, MAX_BROADCAST_LENGTHS), length).withColumn("__q", F.col("e") - F.col("size") + F.col(length))
    first = sized.withColumn("a", F.explode(F.expr(f"sequence(IF(__q = 0, {length} + 1, 1), {length} + 1 - __q)")))
    both = first.withColumn("b", F.explode(F.expr(f"sequence(IF(__q = 2, a + 1, a), IF(__q = 2, {length}, a))")))
    again = f"__q = 1 AND a > 1 AND substring({text}, a, 1) = substring({text}, a - 1, 1)"
    rest = F.expr(f"concat(substring({text}, 1, a - 1), substring({text}, a + 1, b - a - 1), substring({text}, b + 1))")
    return both.where(f"NOT ({again})").select(label, F.xxhash64("size", rest).alias("left"))


def _one_less(df: DataFrame, text: str, label: str) -> DataFrame:
    """(label, left): hashes of the w characters behind ``at`` without one of them."""
    out = df.withColumn("j", F.explode(F.expr("sequence(1, w)")))
    rest = F.expr(f"concat(substring({text}, at + 1, j - 1), substring({text}, at + j + 1, w - j))")
    return out.select(label, F.xxhash64("r", "e", "i", rest).alias("left"))


def adopted(matches: DataFrame) -> DataFrame:
    """Matches whose merchant is adopted: exact ones, and token matches that apply by themselves."""
    return matches.where("tier IN ('exact_user', 'exact_seed') OR (tier = 'none' AND merchant_id IS NOT NULL) OR (tier = 'token' AND auto_apply)")


def review_reason(match: str = "tier", auto: str = "auto_apply"):
    """Why a transaction is not categorised by itself."""
    known = F.col("merchant_id").isNotNull()
    return F.when(F.col(auto), None).when(known & (F.col(match) == "none"), "known_merchant_without_rule").when(known, "low_confidence").otherwise("unknown_merchant")
