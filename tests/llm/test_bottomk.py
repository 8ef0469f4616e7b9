import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bottomk

from .brute import docs, sha


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rows_of(seed=4, n=40):
    rng = random.Random(seed)
    rows = [(3 * i + 5, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 50, 120])))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, "😀é学x"), (903, rows[5][1]), (904, "ab")]


def test_edited_texts_and_exact_likeness(spark):
    rows = sorted(rows_of())
    got = {r["doc_id"]: r for r in bottomk.edited_neighbours(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert sha(got[i]["edited"]) == sha(edited)
        for other, name in ((edited, "near_edited"), (after, "near_next")):  # exact: fewer than K shingles
            a, b = shingles(t), shingles(other)
            assert got[i][name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_likeness_of_long_texts(spark):
    rng = random.Random(9)
    a = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:2000] + [f"v{i}" for i in range(2000)]))]
    r = bottomk.edited_neighbours(docs(spark, rows)).where("doc_id = 1").first()
    assert r["near_next"] == pytest.approx(1 / 3, abs=0.13)
    s = docs(spark, rows).select("doc_id", bottomk.sketch(F.col("text")).alias("s"))
    n = {x["doc_id"]: x["n"] for x in s.select("doc_id", bottomk.distinct_shingles(F.col("s")).alias("n")).collect()}
    assert n[1] == pytest.approx(3996, rel=0.3)


def test_merge_equals_sketch_of_all(spark):
    rows = [r for r in rows_of(7, 20) if r[1]]
    s = docs(spark, rows).select(F.lit(1).alias("k"), bottomk.sketch(F.col("text"), 16).alias("sketch"))
    merged = bottomk.merge_groups(s, ["k"], k=16, salts=3).first()["sketch"]
    every = sorted({h for r in s.collect() for h in r["sketch"]})
    assert merged == every[:16]


def test_merge_of_nulls_repeats_and_clashing_names(spark):
    rows = [(1, [5, 9]), (1, [5, 9]), (1, None), (1, [2]), (None, [7]), (None, [7, 8]), (2, None), (2, []), (3, [])]
    s = spark.createDataFrame(rows, "`__h` int, sketch array<bigint>").withColumn("__r", F.lit(0)).withColumn("more", F.lit("x"))
    merged = bottomk.merge_groups(s, ["__h", "__r"], k=2, salts=2)
    assert merged.columns == ["__h", "__r", "sketch"]
    assert {r["__h"]: r["sketch"] for r in merged.collect()} == {1: [2, 5], None: [7, 8], 2: [], 3: []}
    assert bottomk.merge_groups(s.limit(0), ["__h"]).count() == 0


def test_containment(spark):
    words = [f"w{i}" for i in range(60)]
    r = spark.createDataFrame([(" ".join(words), " ".join(words[:30]))], "a string, b string").select(bottomk.sketch(F.col("a")).alias("a"), bottomk.sketch(F.col("b")).alias("b"))
    got = r.select(bottomk.containment(F.col("b"), F.col("a")).alias("in"), bottomk.containment(F.col("a"), F.col("b")).alias("part")).first()
    assert got["in"] == pytest.approx(1.0)
    assert got["part"] == pytest.approx(26 / 56)


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_row_at_any_number_of_buckets(spark, buckets):
    ids = [5, 7, 7, 8, 20, 21, 22, 40]
    rows = docs(spark, [(i, f"t{k}") for k, i in enumerate(ids)])
    got = bottomk.with_next(rows, ["doc_id"], buckets).select("doc_id", "next_doc_id").collect()
    assert sorted((r["doc_id"], r["next_doc_id"]) for r in got) == sorted(zip(ids, ids[1:] + ids[:1], strict=True))


def test_edges(spark):
    one = bottomk.edited_neighbours(docs(spark, [(1, "abcd")]).withColumn("sketch", F.lit("x"))).first()
    assert (one["edited"], one["near_next"]) == ("abab", 1.0)
    assert bottomk.edited_neighbours(docs(spark, [(1, "x")]).where("false")).count() == 0
    nulls = bottomk.edited_neighbours(docs(spark, [(None, "abcd"), (None, "abcd"), (2, "xy")]))
    assert sorted(r["edited"] for r in nulls.collect()) == ["abab", "abxy", "xa"]
