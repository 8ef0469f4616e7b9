import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, merge, mutations
from ledgerloom.plans.ledger import categories
from ledgerloom.sources import rule_pack

from .test_ledger import frame, tx

PACK = {
    "schemaVersion": 1,
    "packId": "made-for-tests",
    "packVersion": "3",
    "banks": [
        {
            "bankId": "kestrel",
            "displayName": {"en": "Kestrel Savings"},
            "aliases": ["KSB"],
            "senderPatterns": ["^KESTREL-?[0-9]*$"],
            "messageRules": [
                {"ruleId": "login", "priority": 9, "messageType": "otp", "intent": "ignore", "match": {"anyOf": ["sign[- ]in number"]}, "redact": ["member (?<secret>M[0-9]+)"]},
                {
                    "ruleId": "spent",
                    "priority": 4,
                    "messageType": "online_purchase",
                    "intent": "transaction",
                    "match": {"allOf": ["spent", "^Card"]},
                    "regex": r"Card ending (?<tail>\d{4}): (?<money>[A-Z]{3}) (?<sum>-?[\d.,]+) spent, (?<shop>[^,]+), (?<at>[\d-]{10} [\d:]{5})\.(?: Left (?<rest>[\d.,]+))?",
                    "extract": {
                        "amount": {"group": "sum"},
                        "currency": {"group": "money"},
                        "merchant": {"group": "shop", "transform": ["trim", "collapseWs"]},
                        "instrumentRef": {"group": "tail", "kind": "card", "maskPolicy": "last4"},
                        "occurredAt": {"group": "at", "format": "yyyy-MM-dd HH:mm", "timezone": "Asia/Riyadh"},
                        "remainingBalance": {"group": "rest"},
                    },
                    "sign": "debit",
                    "requiredFields": ["amount", "remainingBalance"],
                },
            ],
        }
    ],
}
FULL = "Card ending 3377: EUR 18.40 spent, TEALEAF CAFE, 2026-03-05 08:41. Left 951.60"


def test_extraction(spark):
    pack = rule_pack.load_pack(json.dumps(PACK))
    rows = [(1, "KESTREL", FULL), (2, "KESTREL-7", FULL.split(" Left")[0]), (3, "KESTREL", "Branches close early today"), (4, "OTHER", FULL), (5, "KESTREL", "Sign-in number 1"), (6, "KESTREL", "Card: spent nothing")]
    out = {r["id"]: r["parsed"] for r in rule_pack.parse_messages(spark.createDataFrame(rows, "id bigint, address string, body string"), pack).collect()}
    assert [out[n]["outcome"] for n in range(1, 7)] == ["parsed", "unparsed", "unparsed", "not_financial", "ignored", "unparsed"]
    assert [out[n]["reason"] for n in (2, 3, 6)] == ["required_field_missing", "no_rule_matched", "extraction_failed"]
    assert out[2]["missing"] == ["remainingBalance"]
    p = out[1]
    assert (str(p["amount"]), p["currency"], p["merchant"], p["instrumentRef"], p["occurredAt"]) == ("18.4000", "EUR", "TEALEAF CAFE", "****3377", datetime(2026, 3, 5, 5, 41))
    assert p["balanceCurrency"] == "EUR"


@pytest.mark.parametrize(
    "change",
    [{"schemaVersion": 2}, {"banks": []}, {"banks": [PACK["banks"][0] | {"senderPatterns": ["(a+)+"]}]}, {"banks": [{"bankId": "x"}]}],
)
def test_bad_packs_are_refused(change):
    with pytest.raises(rule_pack.PackError):
        rule_pack.load_pack(json.dumps(PACK | change))


def test_partial_codec(spark):
    rows = spark.createDataFrame([('{"v":1,"amount":"5","currency":"SAR"}',), ('{"v":1,"amount":"5"}',), ('{"v":2,"amount":"5","currency":"SAR"}',), ("nope",), (None,)], "j string")
    got = [r["x"] and r["x"]["amount"] for r in rows.select(rule_pack.read_partial(F.col("j")).alias("x")).collect()]
    assert got == ["5", None, None, None, None]


def test_user_category_is_protected(spark):
    rows = frame(spark, [tx(1, "10", category_id="dining"), tx(2, "10")])
    by_user = mutations.set_category_by_user(rows, spark.createDataFrame([(1, "groceries")], "id bigint, category_id string"))
    change = spark.createDataFrame([(1, "dining", 1, 0.9, None), (2, "dining", 1, 0.9, "low_confidence")], "id bigint, category_id string, rule_id bigint, confidence double, reason string")
    out = {r["id"]: r for r in mutations.set_category_automatically(by_user, change).collect()}
    assert (out[1]["category_id"], out[1]["category_source"], out[1]["user_edited"]) == ("groceries", "user", ["category_id"])
    assert (out[2]["category_id"], out[2]["needs_review"], out[2]["review_reason"]) == ("dining", True, "low_confidence")


def test_merge_fills_nulls_and_restore_undoes(spark):
    rows = frame(spark, [tx(1, "10"), tx(2, "10", merchant_text="A", reference="R"), tx(3, "11")])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 1)], "survivor_id bigint, merged_id bigint")
    refusals = {r["merged_id"]: r["refusal"] for r in merge.assess(pairs, rows).collect()}
    assert refusals == {1: "same_transaction", 2: None, 3: "amount_differs"}
    done = merge.apply_merges(rows, pairs.where("merged_id = 2"), datetime(2026, 8, 1)).cache()
    out = {r["id"]: r for r in done.collect()}
    assert (out[1]["merchant_text"], out[1]["reference"], out[1]["merged_from"]) == ("A", "R", 2)
    assert (out[2]["is_deleted"], out[2]["merged_into"]) == (True, 1)
    back = {r["id"]: r for r in mutations.restore(done, spark.createDataFrame([(2,)], "id bigint")).collect()}
    assert (back[2]["is_deleted"], back[2]["merged_into"], back[1]["merged_from"]) == (False, None, None)


def test_protected_category_is_not_deleted(spark):
    rows = frame(spark, [tx(1, "10", category_id="dining")])
    rules = spark.createDataFrame([(1, "dining")], "id bigint, category_id string")
    with pytest.raises(ValueError):
        mutations.delete_category(rows, rules, categories(spark), "uncategorized")
    after, kept, cats = mutations.delete_category(rows, rules, categories(spark), "dining", "groceries")
    assert (after.first()["category_id"], kept.first()["category_id"], cats.count()) == ("groceries", "groceries", 12)


def test_audit_chain_shows_tampering(spark):
    entries = spark.range(50).select(F.col("id").alias("seq"), F.lit("t").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit("update").alias("action"), F.lit("user").alias("actor"), F.lit(None).cast("string").alias("actor_detail"), F.lit(datetime(2026, 7, 1)).alias("changed_at"), F.lit('[{"field":"a","from":null,"to":"1"}]').alias("field_changes"))
    log = audit.append(entries, b"k").cache()
    assert audit.verify(log, b"k", block=7).where("NOT linked OR NOT intact").count() == 0
    bad = log.withColumn("action", F.when(F.col("id") == 20, "delete").otherwise(F.col("action")))
    assert [r["id"] for r in audit.verify(bad, b"k", block=7).where("NOT intact").collect()] == [20]
    gap = audit.verify(log.where("id <> 30"), b"k", block=7)
    assert [r["id"] for r in gap.where("NOT linked").collect()] == [31]


def test_learning_from_choices(spark):
    rows = [tx(1, "1", merchant_text="Tealeaf Cafe"), tx(2, "1", merchant_text="Tealeaf  cafe"), tx(3, "1", merchant_text="Bare", merchant_id=2), tx(4, "1"), tx(5, "1", merchant_text="Bare", merchant_id=2), tx(6, "1", merchant_text="Odd", merchant_id=3)]
    merchants = spark.createDataFrame([(2, "BARE"), (3, "ODD")], "id bigint, merchant_key string")
    rules = spark.createDataFrame([(7, 2, "groceries", "seed", True)], "id bigint, merchant_id bigint, category_id string, source string, is_enabled boolean")
    choices = spark.createDataFrame([(1, "dining", True), (2, "groceries", False), (3, "dining", True), (4, "dining", True), (5, "shopping_retail", True), (6, "uncategorized", True), (99, "dining", True)], "id bigint, category_id string, learn boolean")
    after, shops, learnt = mutations.learn_from_choices(frame(spark, rows), merchants, rules, categories(spark), choices)
    assert {r["id"]: (r["merchant_id"], r["category_id"], r["category_source"]) for r in after.collect()} == {1: (4, "dining", "user"), 2: (4, "groceries", "user"), 3: (2, "dining", "user"), 4: (None, "dining", "user"), 5: (2, "shopping_retail", "user"), 6: (3, None, "user")}
    assert sorted(map(tuple, shops.collect())) == [(2, "BARE"), (3, "ODD"), (4, "TEALEAF CAFE")]
    assert sorted((r["id"], r["merchant_id"], r["category_id"], r["source"]) for r in learnt.collect()) == [(7, 2, "shopping_retail", "user"), (8, 4, "dining", "user")]


def test_a_seed_does_not_demote_a_user_s_rule(spark):
    rules = spark.createDataFrame([(1, 2, "groceries", "user", True)], "id bigint, merchant_id bigint, category_id string, source string, is_enabled boolean")
    wanted = spark.createDataFrame([(2, "dining", "seed"), (3, "nowhere", "seed")], "merchant_id bigint, category_id string, source string")
    assert [tuple(r)[1:4] for r in mutations.upsert_rules(rules, wanted, categories(spark)).collect()] == [(2, "dining", "user")]


def test_an_alias_is_linked_once(spark):
    aliases = spark.createDataFrame([(1, "CORNER", "latin")], "merchant_id bigint, alias_key string, script string")
    wanted = spark.createDataFrame([(1, 2, "corner"), (2, 3, " "), (3, 4, "المتجر"), (4, 5, "المتجر"), (5, 6, None)], "n bigint, merchant_id bigint, text string")
    after, told = mutations.link_aliases(aliases, wanted)
    assert {r["n"]: r["status"] for r in told.collect()} == {1: "clash", 2: "no_key", 3: "linked", 4: "clash", 5: "no_key"}
    assert sorted((r["merchant_id"], r["script"]) for r in after.collect()) == [(1, "latin"), (4, "arabic")]


def test_entries_of_changes_are_chained(spark):
    before = frame(spark, [tx(1, "1", category_id="dining"), tx(2, "1", merchant_text="Old"), tx(3, "1")]).withColumn("merged_into", F.when(F.col("id") == 3, F.lit(1).cast("bigint")))
    at, ids = F.lit(datetime(2026, 7, 1)), lambda *n: spark.createDataFrame([(i,) for i in n], "id bigint")
    choices = ids(1).withColumn("category_id", F.lit("dining"))
    one = mutations.set_category_by_user(before, choices)
    two = mutations.edit(one, one.where("id = 2").withColumns({"merchant_text": F.lit("New"), "set": F.array(F.lit("merchant_text"))}))
    three = mutations.soft_delete(two, ids(3), datetime(2026, 7, 1))
    four = mutations.restore(three, ids(3))
    logs = [audit.categorised_by_user(before, one, choices, at), audit.edited(one, two, ids(2), at), audit.deleted(two, three, ids(3), at), audit.restored(three, four, ids(3), at)]
    chain, last, n = None, audit.GENESIS, 0
    for log in logs:
        done = audit.append(log, b"k", last, n)
        row = done.orderBy(F.desc("id")).first()
        last, n = row["entry_hash"], row["id"]
        chain = done if chain is None else chain.unionByName(done)
    got = [(r["action"], json.loads(r["field_changes"])) for r in chain.orderBy("id").collect()]
    change = lambda f, a, b: {"field": f, "from": a, "to": b}
    assert got == [
        ("categorize", [change("categoryId", "dining", "dining"), change("categorySource", None, "user")]),
        ("update", [change("merchantRawText", "Old", "New")]),
        ("delete", [change("isDeleted", "false", "true")]),
        ("restore", [change("isDeleted", "true", "false"), change("mergedIntoId", "1", None)]),
    ]
    assert all(r["linked"] and r["intact"] for r in audit.verify(chain, b"k").collect())
    assert audit.edited(four, four, ids(1, 2, 3), at).count() == 0


def test_dismissed_messages_leave_the_queue_and_stay(spark):
    rows = spark.createDataFrame([(1, "financial_unparsed", False), (2, "financial_unparsed", None), (3, "ignored", False)], "id bigint, classification string, dismissed_as_not_transaction boolean")
    after = mutations.dismiss(rows, spark.createDataFrame([(2,), (9,), (2,)], "id bigint"))
    assert sorted(map(tuple, after.collect())) == [(1, "financial_unparsed", False), (2, "financial_unparsed", True), (3, "ignored", False)]
