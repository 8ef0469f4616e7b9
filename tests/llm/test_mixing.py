import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing

from .brute import DOCS, size, targets


def table(spark, seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["B", "b", "é", None])
        text = None if i % 50 == 0 else " \t".join(["w"] * rng.choice([0, 1, 3, 10, 40]))
        rows.append((i, text, "en", source, 0))
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_sources_reach_their_targets(spark, block_rows):
    rows, df = table(spark)
    got = {r["doc_id"]: r for r in mixing.copies(df, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    has, taken = {}, {}
    for i, text, _, source, _ in rows:
        n = size(text)
        assert (got[i]["size"], got[i]["source"]) == (n, source)
        assert got[i]["taken"] == got[i]["copies"] * n <= 3 * n
        has[source] = has.get(source, 0) + n
        taken[source] = taken.get(source, 0) + got[i]["taken"]
    wanted = targets(has)
    assert sum(wanted.values()) == pytest.approx(sum(has.values()))
    for i, _, _, source, _ in rows:
        assert got[i]["source_size"] == has[source]
        assert got[i]["target"] == pytest.approx(wanted[source])
    for source in has:
        assert abs(taken[source] - wanted[source]) <= 40  # the largest document


def test_reruns_agree_whatever_the_partitions(spark):
    _, df = table(spark)
    pick = lambda d: sorted((r["doc_id"], r["copies"]) for r in mixing.copies(d, block_rows=64).collect())
    assert pick(df) == pick(df.repartition(7, "text"))


def test_rounding_keeps_expectations():
    import numpy as np

    rng = np.random.default_rng(0)
    p, s = np.array([0.3, 0.5, 0.9, 0.2, 0.6]), np.array([10.0, 7, 5, 3, 1])
    mean = np.zeros(5)
    for _ in range(4000):
        q, left = mixing.pivotal(p, s, rng.random(5))
        assert q @ s == pytest.approx(p @ s)
        assert all(x in (0.0, 1.0) for i, x in enumerate(q) if i != left)
        mean += q / 4000
    assert mean == pytest.approx(p, abs=0.04)


@pytest.mark.parametrize("fraction", [0.15, 0.5, 0.8])
@pytest.mark.parametrize("documents", [1, 3, 40])
def test_whole_rounding_keeps_expectations(fraction, documents):
    import numpy as np

    rng = np.random.default_rng(documents)
    size = np.sort(rng.integers(2, 60, documents).astype(float))[::-1]
    mean, words, runs, miss = np.zeros(documents), 0.0, 8000, []
    for _ in range(runs):
        p = mixing.settle_all(np.full(documents, fraction), size, rng)
        assert set(p.tolist()) <= {0.0, 1.0}
        mean += p / runs
        words += p @ size / runs
        miss.append(abs(p @ size - fraction * size.sum()))
    assert mean == pytest.approx(np.full(documents, fraction), abs=0.025)
    assert words == pytest.approx(fraction * size.sum(), rel=0.05 if documents == 1 else 0.02)
    assert max(miss) <= size[0]
    if documents == 40:
        assert np.quantile(miss, 0.95) <= 25


def test_mix_keeps_columns_and_tells_repeated_ids_apart(spark):
    rows = [(1, "a b c", "en", "x", 5), (1, "a b", "en", "x", 3), (1, "a b", "en", "x", 3), (None, "q", "en", None, 1), (2, None, "en", "y", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("size", "rank", "row", "doc", "hash", "__size", "__n")})
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copies", "taken"]
    assert all(r["copies"] > 0 and r["taken"] == r["copies"] * size(r["text"]) for r in out.collect())


def test_columns_of_the_result_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "x", 5)], DOCS).withColumn("Copies", F.lit(9)).withColumn("taken", F.lit("t"))
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
    assert [(r["copies"], r["taken"]) for r in out.collect()] == [(1, 3)]


def test_equal_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b", "en", "x", 3)] * 30 + [(None, "c d e f", "en", "y", 7)] * 10, DOCS)
    out = mixing.mix(df).collect()
    assert sum(r["taken"] for r in out if r["source"] == "x") == pytest.approx(500 / 7, abs=2)
    assert sum(r["taken"] for r in out if r["source"] == "y") == pytest.approx(200 / 7, abs=4)


def test_equal_rows_spread_over_blocks(spark):
    n, block_rows = 1_000_000, 1024
    sized = spark.range(n, numPartitions=8).select(F.monotonically_increasing_id().alias("row"), F.lit(7).cast("long").alias("doc_id"), F.lit(5).cast("long").alias("hash"), F.lit("x").alias("source"), F.lit(3).cast("long").alias("size"))
    numbered = mixing._numbered(sized)
    assert numbered.select("number").distinct().count() == n
    assert numbered.agg(F.max("number")).first()[0] == n
    blocks = -(-n // block_rows)
    dealt = mixing.dealt(numbered.withColumns({"n": F.lit(n), "rank": F.lit(1)}), 0, block_rows).groupBy("block").count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == blocks
    assert max(sizes) < 1.3 * block_rows


def test_equal_rows_agree_whatever_the_partitions(spark):
    rows = [(i % 3, "a b c", "en", "x", 5) for i in range(300)] + [(None, "d e", "en", "y", 3)] * 50
    df = spark.createDataFrame(rows, DOCS)
    runs = [sorted(map(tuple, mixing.copies(df.repartition(p), block_rows=16).collect()), key=repr) for p in (1, 5)]
    assert runs[0] == runs[1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.copies(none).count() == 0
    assert mixing.mix(none).count() == 0
    nothing = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)
    assert [r["taken"] for r in mixing.copies(nothing).collect()] == [0, 0]
    assert mixing.mix(nothing).count() == 0
