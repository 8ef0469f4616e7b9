"""Ingestion: replays, fresh checkpoints, failures, duplicates, categories, import, rescan and live queries."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import sanitize
from ledgerloom.operators import categorise, duplicates, matching
from ledgerloom.plans.ledger import categories
from ledgerloom.schema import RAW_MESSAGE
from ledgerloom.sources import rule_pack
from ledgerloom.streaming import backfill, ingest

from .test_changes import FULL, PACK
from .test_ledger import frame, tx

KEYS = "provider_id bigint, sms_provider_id bigint, content_hmac string"


def one_by_one(batch, history):
    hashes, ids = ({r[k] for r in history if r[k] is not None} for k in (2, 1))
    kept = []
    for n, i, h in batch:
        if h not in hashes and i not in ids:
            kept.append(n)
            hashes |= {h} - {None}
            ids |= {i} - {None}
    return kept


def kept(spark, batch, history):
    return sorted(r["provider_id"] for r in duplicates.exact_new(spark.createDataFrame(batch, KEYS), spark.createDataFrame(history, KEYS)).collect())


def test_what_is_dropped_drops_no_other(spark):
    assert kept(spark, [(2, 1, "h2"), (3, 3, "h2")], [(1, 1, "h1")]) == [3]
    assert kept(spark, [], []) == []
    assert kept(spark, [(1, None, None), (2, None, None)], [(0, None, None)]) == [1, 2]


@pytest.mark.parametrize("seed", range(2))
def test_new_messages_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    make = lambda n: (n, rng.choice([None, *range(25)]), rng.choice([None, *(f"h{k}" for k in range(25))]))
    history, batch = [make(-n) for n in range(5)], [make(n) for n in range(1, 60)]
    assert kept(spark, batch, history) == one_by_one(batch, history)


def test_a_chain_of_keys(spark):
    batch = [(n, n // 2, f"h{(n + 1) // 2}") for n in range(7)]
    assert kept(spark, batch, []) == one_by_one(batch, [])


def test_a_long_chain_takes_as_many_jobs_as_a_short_one(spark):
    batch = [(n, n // 2, f"h{(n + 1) // 2}") for n in range(10_000)]
    rows = spark.createDataFrame(batch, KEYS)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for size in (100, 10_000):
        spark.sparkContext.setJobGroup(f"chain {size}", "")
        got = [r["provider_id"] for r in duplicates.exact_new(rows.where(F.col("provider_id") < size), rows.where("false")).collect()]
        jobs.append(len(tracker.getJobIdsForGroup(f"chain {size}")))
        assert sorted(got) == one_by_one(batch[:size], [])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize(("seed", "most"), [(0, 500_000), (1, 0)])
def test_chains_as_one_by_one(spark, monkeypatch, seed, most):
    monkeypatch.setattr(duplicates, "ROUNDS", 1)
    monkeypatch.setattr(duplicates, "MOST_IN_ONE_PASS", most)
    rng = random.Random(seed)
    batch = [(n, rng.choice([None, *range(40)]), rng.choice([None, *(f"h{k}" for k in range(40))])) for n in range(120)]
    assert kept(spark, batch, batch[:0] + [(-1, 3, "h3")]) == one_by_one(batch, [(-1, 3, "h3")])


@pytest.fixture
def job(tmp_path):
    return ingest.Ingest(f"{tmp_path}/out", rule_pack.load_pack(json.dumps(PACK)), b"k")


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, RAW_MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def run(spark, tmp_path, job, checkpoint, **options):
    ingest.start(spark, f"{tmp_path}/in", job, f"{tmp_path}/{checkpoint}", **options).awaitTermination()


def test_stream_replay_writes_nothing_twice(spark, tmp_path, job):
    at = datetime(2026, 7, 31)
    rows = [(1, "KESTREL", FULL, at), (2, "KESTREL", FULL, at), (3, "KESTREL", "card 4111 1111 1111 1111 statement", at), (None, "KESTREL", "x", at), (4, "OTHER", "hello", at), (5, "KESTREL", "Sign-in number for member M55", at), (6, "KESTREL", FULL.replace("18.40", "-18.40"), at)]
    put(spark, tmp_path, rows)
    for checkpoint in ("a", "a", "b"):  # the third run replays everything
        run(spark, tmp_path, job, checkpoint)
    found = {r["sms_provider_id"]: r for r in job.messages(spark).collect()}
    assert set(found) == {1, 3, 5, 6}  # the second message repeats the first; other senders are not kept
    assert job.messages(spark).count() == 4
    assert found[3]["pan_redacted"]
    assert "4111" not in found[3]["sanitized_body"]
    assert found[5]["sanitized_body"] is None
    assert (found[6]["classification"], found[6]["unparsed_reason"]) == ("financial_unparsed", "required_field_missing")
    assert [r["id"] for r in job.transactions(spark).collect()] == [1]
    once = {"transaction": 1, "duplicate": 1, "review": 2, "ignored": 1, "not_financial": 1, "failed": 1}
    again = {"duplicate": 5, "not_financial": 1, "failed": 1}
    assert {r["outcome"]: r["n"] for r in job.counters(spark).collect()} == {k: once.get(k, 0) + again.get(k, 0) for k in once}


def test_a_fresh_checkpoint_leaves_older_rows(spark, tmp_path, job):
    put(spark, tmp_path, [(1, "KESTREL", FULL, datetime(2026, 7, 1))])
    run(spark, tmp_path, job, "a")
    cursor = ingest.first_cursor(spark, f"{tmp_path}/in")
    put(spark, tmp_path, [(2, "KESTREL", FULL.replace("18.40", "5.00"), datetime(2026, 7, 2))])
    run(spark, tmp_path, job, "b", after_id=cursor)
    assert sorted(r["id"] for r in job.transactions(spark).collect()) == [1, 2]
    assert len({r["run"] for r in job.ingested(spark).select("run").collect()}) == 2


def test_a_row_that_fails_holds_up_no_other(spark, tmp_path, job, monkeypatch):
    bad = ingest.Ingest(job.folder, job.pack, job.hmac_key)
    put(spark, tmp_path, [(1, "KESTREL", FULL, datetime(2026, 7, 1)), (2, "KESTREL", "card 4111 1111 1111 1111", datetime(2026, 7, 1))])
    plain = sanitize._redact

    def fails(text, find):
        if "4111" in text:
            raise RuntimeError(text)
        return plain(text, find)

    with monkeypatch.context() as m:
        m.setattr(sanitize, "sanitize_text", lambda t, p=(), f=fails, c=sanitize._cards: (f(t, c)[0], False))
        run(spark, tmp_path, bad, "a")
    assert [(r["provider_id"], r["error"]) for r in job.dead_letters(spark).collect()] == [(2, "RuntimeError")]
    assert [r["id"] for r in job.transactions(spark).collect()] == [1]
    job.retry(spark)
    job.retry(spark)
    assert sorted(r["sms_provider_id"] for r in job.messages(spark).collect()) == [1, 2]


def known_merchants(spark):
    merchants = spark.createDataFrame([(1, "TEALEAF CAFE"), (2, "BARE")], "id bigint, merchant_key string")
    aliases = spark.createDataFrame([], "merchant_id bigint, alias_key string, script string")
    rules = spark.createDataFrame([(1, 1, "dining", "seed", True)], "id bigint, merchant_id bigint, category_id string, source string, is_enabled boolean")
    return merchants, matching.merchant_candidates(merchants, aliases, rules, categories(spark))


def test_duplicates_and_categories_of_new_transactions(spark, tmp_path, job):
    job = ingest.Ingest(job.folder, job.pack, job.hmac_key, candidates=lambda s: known_merchants(s)[1])
    later = FULL.replace("08:41", "08:50")
    put(spark, tmp_path, [(1, "KESTREL", FULL, datetime(2026, 7, 1))])
    run(spark, tmp_path, job, "a")
    put(spark, tmp_path, [(2, "KESTREL", later, datetime(2026, 7, 1)), (3, "KESTREL", FULL.replace("TEALEAF CAFE", "Nowhere Shop"), datetime(2026, 7, 1)), (4, "KESTREL", FULL.replace("TEALEAF CAFE", "bare"), datetime(2026, 7, 1))])
    run(spark, tmp_path, job, "a")
    got = {r["id"]: r for r in job.transactions(spark).collect()}
    assert {i: r["duplicate_of"] for i, r in got.items()} == {1: 2, 2: 1, 3: None, 4: None}
    assert {i: r["category_id"] for i, r in got.items()} == {1: "dining", 2: "dining", 3: None, 4: None}
    assert {i: r["review_reason"] for i, r in got.items()} == {1: "possible_duplicate", 2: "possible_duplicate", 3: "unknown_merchant", 4: "known_merchant_without_rule"}
    assert {i: r["merchant_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: None, 4: 2}
    assert {r["outcome"]: r["n"] for r in job.counters(spark).collect()} == {"transaction": 3, "flagged": 1}
    after = categorise.ensure_merchants(known_merchants(spark)[0], job.transactions(spark))
    assert sorted(tuple(r) for r in after.collect()) == [(1, "TEALEAF CAFE"), (2, "BARE"), (3, "NOWHERE SHOP")]


def test_the_user_s_category_stays(spark):
    rows = frame(spark, [tx(1, "1", merchant_text="Tealeaf Cafe", category_id="groceries")]).withColumn("category_source", F.lit("user"))
    assert categorise.categorise(rows, known_merchants(spark)[1]).first()["category_id"] == "groceries"


def test_import_rescan_and_live_query(spark, tmp_path, job):
    put(spark, tmp_path, [(1, "KESTREL", FULL, datetime(2026, 6, 1)), (2, "KESTREL", FULL.replace("18.40", "10.00"), datetime(2026, 7, 2))])
    cursor = ingest.first_cursor(spark, f"{tmp_path}/in")
    assert cursor == 2
    put(spark, tmp_path, [(3, "KESTREL", FULL.replace("18.40", "20.00"), datetime(2026, 7, 30)), (4, "OTHER", "hello", datetime(2026, 7, 30))])
    run(spark, tmp_path, job, "a", after_id=cursor)
    ids = lambda: sorted(r["id"] for r in job.transactions(spark).collect())
    assert ids() == [3]  # a first run reads nothing that was there before
    q = backfill.start_import(spark, f"{tmp_path}/in", job, f"{tmp_path}/b", datetime(2026, 7, 1))
    q.awaitTermination()
    assert ids() == [2, 3]
    assert (backfill.import_state(q), backfill.import_state(None)) == ("completed", "idle")
    messages = spark.read.schema(RAW_MESSAGE).parquet(f"{tmp_path}/in")
    backfill.rescan(messages, job, datetime(2026, 1, 1), bank="no such bank")
    assert ids() == [2, 3]
    backfill.rescan(messages, job, datetime(2026, 1, 1), bank="kestrel")
    backfill.rescan(messages, job, datetime(2026, 1, 1))
    assert ids() == [1, 2, 3]
    seen = []
    backfill.watch(spark, job, lambda t: t.agg(F.count("transaction").alias("n")), lambda df, _: seen.append(df.first()["n"]), f"{tmp_path}/c").awaitTermination()
    assert seen == [3]


def test_only_new_messages_are_parsed(spark, tmp_path):
    rows = [(1, "BANK", "Hello 12", None), (2, "BANK", "Hello  12", None), (3, "OTHER", "Hello 12", None)]
    pack = rule_pack.RulePack("p", "1", (rule_pack.Bank("b", {}, (), ("^BANK$",), ()),))
    job = ingest.Ingest(str(tmp_path / "out"), pack, b"k")
    messages, _, _ = job.process(spark.createDataFrame(rows, RAW_MESSAGE), job.ingested(spark))
    got = {r["provider_id"]: (r["outcome"], r["classification"]) for r in messages.collect()}
    assert got == {1: ("review", "financial_unparsed"), 2: ("duplicate", None), 3: ("not_financial", "not_financial")}
