import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.operators import components as graph

from .brute import docs, linked
from .brute import simhash as plain_simhash

WORDS = [f"w{i}" for i in range(400)]


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randint(1, 300))]
        rows.append((len(rows) + 10, " ".join(base)))
        if i % 3 == 0:  # near copies, one word changed or added
            for _ in range(3):
                near = list(base)
                near[rng.randrange(len(near))] = rng.choice(WORDS)
                rows.append((len(rows) + 10, " ".join(near).upper()))
        if i % 10 == 0:
            rows.append((len(rows) + 10, " ".join(base)))
    return [*rows, (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "Über straße 学 习 über"), (7, "x " * 5000)]


def test_components_match_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).withColumn("hex", simhash.fingerprint_hex()).collect()}
    prints = {i: plain_simhash(t) for i, t in rows}
    assert {i: r["hex"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == linked(prints)
    assert got[1]["component_id"] == got[2]["component_id"] == got[3]["component_id"] == 1
    assert got[4]["component_id"] == got[5]["component_id"] == 4


@pytest.mark.parametrize("n", [1, 10_000, 10**7, 10**10])
def test_every_close_pair_shares_a_cell(n):
    masks, rng = simhash.cell_masks(n), random.Random(n)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        x, y = (int(v) for v in simhash._counts(np.array([a, b], np.uint64)))
        assert (x ^ y).bit_count() <= 4
        assert any(x & m == y & m for m in masks)


def test_vectors_are_the_counts_of_segments(spark):
    rng = random.Random(8)
    prints = [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(50))]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "fp bigint").select("fp", simhash.counts(F.col("fp")).alias("v")).collect()
    assert {r["fp"]: r["v"] for r in rows} == dict(zip(signed, simhash._counts(np.array(prints, np.uint64)).view(np.int64).tolist(), strict=True))
    plain = lambda p: [(p >> 2 * i & 3).bit_count() for i in range(32)]
    for a, b in zip(prints, prints[1:], strict=False):
        x, y = (int(v) for v in simhash._counts(np.array([a, b], np.uint64)))
        assert (x ^ y).bit_count() == sum(abs(m - n) for m, n in zip(plain(a), plain(b), strict=True)) <= (a ^ b).bit_count()


@pytest.mark.parametrize("n", [2, 90, 1500])
def test_cells_connect_as_all_pairs_do(n):
    rng = random.Random(n)
    prints = {rng.getrandbits(64)}
    while len(prints) < n:
        p = rng.choice(sorted(prints)) if rng.random() < 0.8 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    label = simhash.join_cell(np.array(prints, np.uint64))
    wanted = linked(dict(enumerate(prints)))
    same = lambda g: {frozenset(i for i in range(n) if g[i] == k) for k in {g[i] for i in range(n)}}
    roots = {i: int(label[label[i]]) for i in range(n)}
    assert same(roots) == same(wanted)


def test_blocks_of_large_cells_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        p = rng.choice([centre, rng.choice(sorted(prints))])
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), cell_rows=40)
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    groups, wanted = {}, {}
    for i, low in linked(dict(enumerate(prints))).items():
        groups.setdefault(found.get(signed[i], signed[i]), set()).add(i)
        wanted.setdefault(low, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_ids_null_and_repeated_and_extra_columns(spark):
    same = "a b c d e f g h"
    rows = docs(spark, [(None, same), (9, same), (9, same), (None, "only this one has no id at all"), (8, None)]).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit("y"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 9), (9, 9), (9, 9), (None, None), (8, 8)], key=str)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["8", "9", "None"]


def test_rows_that_share_an_id(spark):
    one, other = "a b c d e f g h", "quite another text of eight words it is"
    rows = docs(spark, [(1, one), (1, other), (2, other), (None, one), (3, "third one here is alone too"), (None, "no id, a b"), (None, "no id, a b")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (None, None), (None, None)], key=str)
    clash = rows.withColumn("__id", F.lit(1)).withColumn("__hash", F.lit("h")).withColumn("first", F.lit(2)).withColumn("row", F.lit(3))
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(((r["doc_id"], r["text"], r["__hash"]) for r in kept.collect()), key=str) == sorted([(1, one, "h"), (1, other, "h"), (3, "third one here is alone too", "h"), (None, "no id, a b", "h")], key=str)


def test_empty_table(spark):
    none = docs(spark, [(1, "x")]).where("false")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(400).tolist()
    edges = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(1000, 1001), (1001, 1001), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(400), 0) | {1000: 1000, 1001: 1000}


def test_near_copies_of_one_text_are_not_compared_with_each_other(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 500:
        p = centre
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << bit
        prints.add(p)
    far = centre
    for bit in range(7):
        far ^= 1 << bit
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in [*sorted(prints), far]]
    rows = spark.createDataFrame([(0, 0, 501, p) for p in signed], "layer int, cell bigint, count bigint, fp bigint")
    direct, pairs = simhash._large_cells(rows, 100)
    assert direct.count() == 500
    assert pairs.where("block = 1").select("fp").distinct().count() == 1
    assert pairs.where("block = 0").count() == 501
