import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontam

from .brute import contaminated, docs, words10

ITEMS = "item_id bigint, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [*"abcdef", "Über", "学习"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 12, 25, 40])] + [(100, None), (101, " .,"), (7, "q r s t u v w x y z a")]
    rows = []
    for i in range(80):
        t = text(rng.randint(0, 60))
        if i % 2:
            item = rng.choice(items)[1] or ""
            cut = item[rng.randint(0, 4) :]
            t = f"{t} {cut.upper() if i % 4 == 1 else cut} {text(5)}"
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, "!!"), (903, rows[1][1])]
    got = decontam.contamination(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: contaminated(t, items) for i, t in rows}
    assert len(got) == len(rows)


def test_common_passage_and_rare_terms(spark):
    passage = "the quick brown fox jumps over the lazy dog near the river bank today"
    items = [(1, passage), (2, "alpha beta gamma"), (None, "delta epsilon")]
    rows = [(1, f"zz {passage} zz"), (2, passage[:30]), (3, "so ALPHA, beta; gamma!"), (4, "delta epsilon"), (5, "the the the the the the the the the the the"), (6, " ".join(passage.split()[:10]))]
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {1: (14, ["1"]), 2: (0, []), 3: (3, ["2"]), 4: (2, []), 5: (0, []), 6: (10, ["1"])}


def test_proximity_finds_shuffled_words(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], ITEMS)
    rows = docs(spark, [(1, "ten nine eight seven six five four three two one"), (2, "one two apple pear"), (3, None)])
    assert {r["doc_id"] for r in decontam.proximity_matches(decontam.document_words(rows), items).collect()} == {1}


def test_proximity_of_nulls_and_repeated_rows(spark):
    phrase = " ".join(f"w{i}" for i in range(10))
    rows = docs(spark, [(1, phrase), (1, phrase), (1, phrase + " end"), (None, phrase), (2, None), (3, "")])
    items = spark.createDataFrame([(None, phrase), (None, phrase), (7, None), (8, "")], ITEMS)
    got = decontam.proximity_matches(decontam.document_words(rows), items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["position"], r["shared"]) for r in got) == [(0, 0, 0, 10), (1, 0, 0, 10), (1, 0, 0, 10)]


def test_drop_keeps_columns_and_clean_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], ITEMS)
    rows = docs(spark, [(1, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "clean"), (2, None), (2, "alpha beta gamma")]).withColumns({c: F.lit("x") for c in ("item_id", "words", "__id", "__hash", "__text_hash", "text_hash")})
    kept = decontam.drop_contaminated(rows, items)
    assert kept.columns == rows.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [(2, None), (None, "clean")]


def test_empty_tables(spark):
    items, rows = spark.createDataFrame([(1, "a b")], ITEMS), docs(spark, [(1, "a b"), (2, "c")])
    assert decontam.contamination(rows.where("false"), items).count() == 0
    assert [r["n_hit"] for r in decontam.contamination(rows, items.where("false")).collect()] == [0, 0]


def near(rows, items, min_terms=8):
    """{(doc, item): (shared, start)} by looking at every window of every item and every stretch of every text."""
    out = {}
    for d, text in rows:
        w = words10(text)
        for item, t in items:
            v = words10(t)
            windows = [set(v[i : i + 10]) for i in range(max(1, len(v) - 9))] if v else []
            hits = [(len(x & set(w[q : q + 19])), -q) for x in windows for q in range(len(w)) if len(x & set(w[q : q + 19])) >= min(min_terms, len(x))]
            if hits:
                out[d, item] = (max(hits)[0], -max(hits)[1])
    return out


def found_near(spark, rows, items):
    got = decontam.proximity_matches(decontam.document_words(docs(spark, rows)), spark.createDataFrame(items, ITEMS)).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
    return {(r["doc_id"], r["item_id"]): (r["shared"], r["position"]) for r in got}


def near_tables(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 5, 9, 10, 15, 30])] + [(50, None), (None, "solo duo")]
    rows = [(900, None), (901, ""), (902, "duo x solo")]
    for i in range(60):
        v = rng.choice(items)[1] or ""
        v = v.split()[rng.randint(0, 3) :]
        for _ in range(rng.randint(0, 4)):
            v.insert(rng.randint(0, len(v)), rng.choice(["gone", rng.choice(words)]))
        if v and i % 3 == 0:
            v[rng.randrange(len(v))] = "other"
        if i % 4 == 0:
            rng.shuffle(v)
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) + " " + " ".join(v)))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_proximity_matches_brute_force(spark, seed):
    rows, items = near_tables(seed)
    wanted = near(rows, items)
    assert wanted
    assert found_near(spark, rows, items) == wanted


def test_proximity_without_the_rarest_word(spark):
    item = [f"t{i}" for i in range(10)]
    long = [f"u{i}" for i in range(15)]
    rows = [(1, " ".join([*item[:9], "else"])), (2, " ".join([*long[:7], "else", *long[8:]])), (3, "t9 t9"), (4, " ".join(item[:7]))]
    items = [(1, " ".join(item)), (2, " ".join(long))]
    assert found_near(spark, rows, items) == near(rows, items) == {(1, 1): (9, 0), (2, 2): (9, 0)}


def test_proximity_of_every_row(spark):
    rows = docs(spark, [(1, "beta alpha"), (1, "clean"), (None, "alpha beta"), (2, None)])
    got = decontam.proximity(rows, spark.createDataFrame([(7, "alpha beta"), (None, "beta alpha")], ITEMS)).collect()
    assert sorted(((r["doc_id"], r["shared"], r["items"]) for r in got), key=str) == sorted([(1, 2, ["7"]), (1, 0, []), (None, 2, ["7"]), (2, 0, [])], key=str)


def shuffled(spark):
    """Bytes that the stages so far have written for shuffles."""
    context = spark.sparkContext
    store, gateway = context._jsc.sc().statusStore(), context._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_ANCHORS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, items = near_tables(3)
        got = decontam.contamination(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
        wanted = {i: contaminated(t, items) for i, t in rows}
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: (n, hit, [x for x in found if x != "None"]) for i, (n, hit, found) in wanted.items()}
        assert found_near(spark, rows, items) == near(rows, items)
        rng = random.Random(4)
        words = [f"{rng.getrandbits(40):x}" for _ in range(20_000)]
        before = shuffled(spark)
        found = decontam.matches(decontam.document_words(docs(spark, [(1, " ".join(words))])), spark.createDataFrame([(1, " ".join(words[1000:1012]))], ITEMS)).collect()
        assert (min(r["first"] for r in found), max(r["last"] for r in found)) == (1000, 1011)
        assert shuffled(spark) - before < 5_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
