import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classify, duplicates, filters, matching, transfers
from ledgerloom.plans import reports
from ledgerloom.plans.ledger import categories, with_defaults

START, END = datetime(2026, 7, 1), datetime(2026, 8, 1)


def tx(id, amount, currency="SAR", direction="debit", type="pos_purchase", at=None, **more):
    row = {"id": id, "amount": Decimal(amount), "currency": currency, "direction": direction, "type": type, "affects_spend": True, "is_deleted": False, "occurred_at": at or datetime(2026, 7, 10, 12)}
    return row | more


COLUMNS = (
    "id bigint, amount decimal(20,4), currency string, direction string, type string, affects_spend boolean, is_deleted boolean, occurred_at timestamp, converted_amount decimal(20,4), converted_currency string, "
    "fee_amount decimal(20,4), fee_currency string, fx_rate decimal(18,8), reference string, instrument_id bigint, transfer_state string, category_id string, merchant_text string, masked_ref string, needs_review boolean"
)


def frame(spark, rows):
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")]
    return with_defaults(spark.createDataFrame([tuple(r.get(n, False if n == "needs_review" else None) for n in names) for r in rows], COLUMNS))


def golden():
    d = Decimal
    return [
        tx(1, "152.75", instrument_id=1),
        tx(2, "120.00", "USD", type="online_purchase", converted_amount=d("450.12"), converted_currency="SAR", fee_amount=d("11.25"), fee_currency="SAR", fx_rate=d("3.7510")),
        tx(3, "49.99", "USD", "credit", "refund", converted_amount=d("187.46"), converted_currency="SAR"),
        tx(4, "35.00", "EUR"),
        tx(5, "2000.00", type="transfer_out", reference="TRX-INTERNAL-1", instrument_id=2),
        tx(6, "2000.00", direction="credit", type="transfer_in", reference="trx-internal-1 ", instrument_id=3, at=datetime(2026, 7, 10, 12, 2)),
        tx(7, "14500.00", direction="credit", type="salary_income"),
        tx(8, "500.00", type="withdrawal"),
        tx(9, "1200.00", type="card_repayment"),
        tx(10, "800.00", type="transfer_out", reference="THIRD", instrument_id=2),
        tx(11, "20.00", "USD", "credit", "refund", fx_rate=d("3.7500")),
    ]


def report(spark, rows):
    out = reports.period_report(classify.classified(transfers.analyse_transfers(frame(spark, rows))), START, END, "SAR").collect()
    return {r["measure"]: r for r in out}


def test_golden_ledger(spark):
    got = report(spark, golden())
    assert got["spend"]["base"] == Decimal("1140.41")
    assert got["spend"]["unconverted_count"] == 1
    assert got["income"]["base"] == Decimal("14500")
    assert got["cash_withdrawals"]["base"] == Decimal("500")
    assert got["internal_transfers"]["base"] == Decimal("2000")
    assert got["fees"]["base"] == Decimal("11.25")


def test_unproven_pair_counts_and_is_flagged(spark):
    rows = golden()
    rows[5] = rows[5] | {"reference": None}
    assert report(spark, rows)["spend"]["base"] == Decimal("3140.41")
    c = classify.classified(transfers.analyse_transfers(frame(spark, rows)))
    assert {r["id"] for r in c.where("class_review").collect()} == {5, 6}


def test_empty_ledger(spark):
    got = report(spark, [])
    assert got["spend"]["base"] is None
    assert got["spend"]["converted_count"] == 0


def greedy(rows):
    """The sequential choice."""
    live = [r for r in rows if not r["is_deleted"] and r["occurred_at"] and r.get("instrument_id")]
    key = lambda r: (r.get("reference") or "").strip().upper() or None
    found = []
    for o in (r for r in live if r["type"] == "transfer_out"):
        for i in (r for r in live if r["type"] == "transfer_in"):
            if o["instrument_id"] != i["instrument_id"] and (o["amount"], o["currency"]) == (i["amount"], i["currency"]) and abs(o["occurred_at"] - i["occurred_at"]) <= timedelta(hours=24):
                found.append((not (key(o) and key(o) == key(i)), o["occurred_at"], o["id"], i["id"]))
    used, out = set(), set()
    for _, _, o, i in sorted(found):
        if o not in used and i not in used:
            used |= {o, i}
            out.add((o, i))
    return out


def test_pairs_equal_sequential_choice(spark):
    rng = random.Random(20260730)
    rows = [
        tx(n, rng.choice(["10", "20"]), rng.choice(["SAR", "USD"]), type=rng.choice(["transfer_out", "transfer_in"]), instrument_id=rng.choice([1, 2, 3, None]), reference=rng.choice([None, "a", " A", "b"]), at=START + timedelta(hours=rng.randint(0, 200)), is_deleted=rng.random() < 0.1)
        for n in range(150)
    ]
    got = {(r["out_id"], r["in_id"]) for r in transfers.pair_transfers(frame(spark, rows)).collect()}
    assert got == greedy(rows)


def test_near_matches(spark):
    rows = [
        tx(1, "10", "SAR", type="transfer_out", instrument_id=1),
        tx(2, "3", "USD", "credit", "transfer_in", instrument_id=2, at=datetime(2026, 7, 11, 11)),
        tx(3, "50", type="transfer_out", instrument_id=None, at=datetime(2026, 7, 20)),
        tx(4, "50", direction="credit", type="transfer_in", instrument_id=2, at=datetime(2026, 7, 20, 5)),
        tx(5, "50", direction="credit", type="transfer_in", instrument_id=2, at=datetime(2026, 7, 25)),
    ]
    f = frame(spark, rows)
    got = {r["id"]: r["reason"] for r in transfers.near_matches(f, transfers.pair_transfers(f)).collect()}
    assert got == {1: "cross_currency_near_match", 2: "cross_currency_near_match", 3: "unresolved_instrument", 4: "unresolved_instrument"}
    inbox = {r["id"] for r in transfers.review_inbox(transfers.analyse_transfers(f)).collect()}
    assert inbox == {1, 2, 3, 4}


def nearly(rows, pairs):
    """Reasons by looking at all pairs of legs."""
    paired = {x for p in pairs for x in p}
    live = [r for r in rows if not r["is_deleted"] and r["occurred_at"] and r["id"] not in paired]
    known = {}
    for o in (r for r in live if r["type"] == "transfer_out"):
        for i in (r for r in live if r["type"] == "transfer_in"):
            if abs(o["occurred_at"] - i["occurred_at"]) > timedelta(hours=24):
                continue
            a, b = o.get("instrument_id"), i.get("instrument_id")
            reason = None
            if a and b:
                reason = "cross_currency_near_match" if a != b and o["currency"] != i["currency"] else None
            elif (a or b) and (o["amount"], o["currency"]) == (i["amount"], i["currency"]):
                reason = "unresolved_instrument"
            if reason:
                known.setdefault(o["id"], []).append((i["id"], reason))
                known.setdefault(i["id"], []).append((o["id"], reason))
    return {k: min(v)[1] for k, v in known.items()}


@pytest.mark.parametrize("seed", [5, 6])
def test_transfers_of_a_crowded_ledger(spark, seed):
    rng = random.Random(seed)
    rows = [
        tx(n, "10" if rng.random() < 0.7 else "20", rng.choice(["SAR"] * 5 + ["USD", "EUR"]), type=rng.choice(["transfer_out", "transfer_in"]), instrument_id=rng.choice([1, 1, 1, 2, 3, None]), reference=rng.choice([None, None, "a", "b"]), at=START + timedelta(minutes=rng.choice([0, 7, 1440, rng.randint(0, 9000)])))
        for n in rng.sample(range(1000), 200)
    ]
    f = frame(spark, rows)
    pairs = transfers.pair_transfers(f)
    wanted = greedy(rows)
    assert {(r["out_id"], r["in_id"]) for r in pairs.collect()} == wanted
    assert {r["id"]: r["reason"] for r in transfers.near_matches(f, pairs).collect()} == nearly(rows, wanted)


def test_shelf_skips_an_instrument():
    shelf = transfers.Shelf()
    for leg, instrument, at in [(5, "a", 1), (3, "a", 2), (9, "b", 2), (4, "c", 0), (1, "a", 5)]:
        shelf.add(leg, instrument, at)
    assert [shelf.smallest(x, 1) for x in ("a", "b", "c")] == [9, 1, 1]
    shelf.take(1)
    assert [shelf.smallest(x, 2) for x in ("a", "b")] == [9, 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_add_up(spark, seed):
    rng = random.Random(seed)
    cats = ["groceries", "dining", None, "nonsense"]
    rows = [tx(n, f"{rng.randint(0, 4999)}.{rng.randint(0, 99):02d}", type=rng.choice(["pos_purchase", "refund"]), direction=rng.choice(["debit", "credit"]), instrument_id=rng.choice([1, 2, None]), category_id=rng.choice(cats), is_deleted=rng.random() < 0.12) for n in range(80)]
    c = classify.classified(frame(spark, rows))
    total = reports.period_report(c, START, END, "SAR").where("measure = 'spend'").first()["base"]
    by_category = reports.category_breakdown(c, categories(spark), START, END, "SAR").agg(F.sum("base")).first()[0]
    parts = reports.instrument_breakdown(c, START, END, "SAR")
    assert by_category == total
    assert parts.where("NOT is_total").agg(F.sum("base")).first()[0] == total == parts.where("is_total").first()["base"]


def test_duplicates_see_their_batch(spark):
    at = datetime(2026, 7, 1, 10)
    make = lambda n, minutes, **k: tx(n, "25", masked_ref="****1", merchant_text="A", at=at + timedelta(minutes=minutes), **k)
    history = frame(spark, [make(1, 0), make(2, 500, reference="R")])
    batch = frame(spark, [make(10, 15), make(11, 16), make(12, 200, reference="R"), make(13, 5, type="fee") | {"merchant_text": "B"}])
    got = {r["id"]: (r["duplicate_of"], r["tier"]) for r in duplicates.batch_decisions(batch, history).collect()}
    assert got == {10: (1, "amount_and_time"), 11: (10, "amount_and_time"), 12: (2, "reference")}
    flags = {r["id"]: r["duplicate_of"] for r in duplicates.flag_pairs(duplicates.batch_decisions(batch, history)).collect()}
    assert flags[1] == 10


def test_exact_new(spark):
    schema = "provider_id bigint, sms_provider_id bigint, content_hmac string"
    batch = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b"), (4, None, None), (5, 9, "c")], schema)
    history = spark.createDataFrame([(0, 9, "z")], schema)
    assert {r["provider_id"] for r in duplicates.exact_new(batch, history).collect()} == {1, 3, 4}


def test_filter_facets(spark):
    rows = frame(spark, [tx(1, "10", merchant_text="Café Panda"), tx(2, "10", "EUR", merchant_text="PANDA"), tx(3, "99", merchant_text="panda"), tx(4, "10", merchant_text=None)])
    f = filters.TransactionFilter(text="panda", min_amount=Decimal(-5), max_amount=Decimal(20))
    assert f.active_facets == 2
    out = {r["id"]: (r["kept"], r["not_comparable"]) for r in f.apply(rows).collect()}
    assert out == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}
    assert not filters.TransactionFilter(text=" ").is_active


def test_merchant_tiers(spark):
    merchants = spark.createDataFrame([(1, "PANDA MARKET CITY EAST MALL"), (2, "QAFE LATTE HOUSE"), (3, "BARE"), (4, "INTERNATIONAL")], "id bigint, merchant_key string")
    aliases = spark.createDataFrame([(1, "PNDA", "latin")], "merchant_id bigint, alias_key string, script string")
    rules = spark.createDataFrame([(1, 1, "groceries", "user", True), (2, 2, "dining", "seed", True), (4, 4, "dining", "seed", True)], "id bigint, merchant_id bigint, category_id string, source string, is_enabled boolean")
    c = matching.merchant_candidates(merchants, aliases, rules, categories(spark))
    texts = spark.createDataFrame([(1, "PNDA"), (2, "QAFE LATTE HOUSE"), (3, "BARE"), (4, "MALL EAST CITY MARKET PANDA"), (5, "INTERNATOINAL"), (6, "ZZZZZZ"), (7, "QAFE QAFE LATTE HOUSE"), (8, None)], "id bigint, key string")
    got = {r["id"]: (r["tier"], r["merchant_id"], r["auto_apply"]) for r in matching.match_merchants(texts, c).collect()}
    assert got == {1: ("exact_user", 1, True), 2: ("exact_seed", 2, True), 3: ("none", 3, False), 4: ("token", 1, True), 5: ("edit", 4, False)}


def test_close_pairs_miss_none_and_skip_common_pieces(spark):
    from ledgerloom.functions.similarity import osa_distance

    rng = random.Random(5)

    def edited(s):
        for _ in range(rng.randint(0, len(s) // 10)):
            i, c = rng.randrange(len(s)), rng.choice("AB C")
            s = rng.choice([s[:i] + c + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + s[i : i + 2][::-1] + s[i + 2 :]])
        return s

    names = ["".join(rng.choice("AB CDEF") for _ in range(n)) for n in (8, 9, 10, 11, 18, 19, 20, 21, 25, 28, 29, 30, 31, 33, 37, 39, 40, 41, 52) for _ in range(4)]
    keys = sorted({edited(s) for s in names for _ in range(6)})
    hashed = lambda xs, c, h: spark.createDataFrame([(x,) for x in xs], f"{c} string").withColumn(h, F.xxhash64(c))
    left, right = hashed(keys, "key", "k"), hashed(names, "name", "n")
    pairs = matching.close_pairs(left.select("key"), right.select("name")).join(left, "k").join(right, "n").select("key", "name")
    got = {(r["key"], r["name"]) for r in pairs.collect()}
    wanted = {(k, n) for k in keys for n in names if k != n and osa_distance(k, n) <= max(len(k), len(n)) // 10}
    assert len(wanted) > 200 and wanted <= got
    # names of one beginning and numbers far apart: each name meets at most itself
    shops = hashed([f"LARGE RING {i * 1111:07d}" for i in range(300)], "name", "n")
    met = matching.close_pairs(shops.select(F.concat(F.lit("LARGE RING "), F.reverse(F.substring("name", 12, 7))).alias("key")), shops.select("name"))
    assert met.count() < 1000


def test_matching_broadcasts_no_table_by_its_file_size(spark, tmp_path):
    spark.range(20000).select("id", F.concat(F.lit("SHOP "), F.col("id")).alias("merchant_key")).write.parquet(f"{tmp_path}/merchants")
    merchants = spark.read.parquet(f"{tmp_path}/merchants")
    rules = merchants.select("id", F.col("id").alias("merchant_id"), F.lit("groceries").alias("category_id"), F.lit("seed").alias("source"), F.lit(True).alias("is_enabled"))
    c = matching.merchant_candidates(merchants, merchants.select(F.col("id").alias("merchant_id"), F.col("merchant_key").alias("alias_key")), rules, categories(spark))
    texts = merchants.select("id", F.reverse("merchant_key").alias("key"))
    plan = matching.match_merchants(texts, c)._jdf.queryExecution().executedPlan().toString()
    # what is broadcast is the categories' or lengths' tables, which were cut or are local
    assert plan.count("BroadcastExchange") <= 4 and "SortMergeJoin" in plan


def test_keys_of_a_length_that_no_name_has_meet_none(spark):
    # digests of 32 characters beside short names: not even a hash of them is made
    keys = spark.range(500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("key"))
    names = spark.range(500).select(F.concat(F.lit("SHOP NUMBER "), F.col("id")).alias("name"))
    lengths = [(32, 13), (32, 14), (32, 15)]
    assert all(abs(m - r) > max(m, r) // 10 for m, r in lengths)
    assert matching.close_pairs(keys, names).count() == 0


def test_rows_shuffled_for_keys_without_a_near_name_follow_the_input(spark):
    context = spark.sparkContext

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    def rows(n):
        merchants = spark.range(n).select("id", F.concat(F.lit("LARGE RING "), F.col("id")).alias("merchant_key"))
        rules = merchants.select("id", F.col("id").alias("merchant_id"), F.lit("groceries").alias("category_id"), F.lit("seed").alias("source"), F.lit(True).alias("is_enabled"))
        c = matching.merchant_candidates(merchants, spark.createDataFrame([], "merchant_id bigint, alias_key string"), rules, categories(spark))
        before = shuffled()
        assert matching.match_merchants(spark.range(n).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("key")), c).count() == 0
        return sum(v for k, v in shuffled().items() if k not in before)

    # a key, a name and a rule go through a dozen joins; pieces of the keys were 177 rows a key
    few, many = rows(500), rows(2000)
    assert many < 30 * 2000 and many < 4.4 * few
