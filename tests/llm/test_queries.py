"""The registered queries: SQL where there is some, else brute force over whole small tables."""

import math
import zlib
from collections import defaultdict
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from ledgerloom.llm import queries as llm_queries

from .brute import contaminated, linked, personal, sha, simhash, size, targets

QUERIES, ORACLES = llm_queries.queries(), llm_queries.oracle_sql()
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in wanted.fetchall()), key=repr)


@pytest.mark.parametrize(("name", "at"), [("op1_toxicity", 0.3), ("op4_quality", 0.7)])
def test_classifiers(spark, documents, name, at):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _, _ in documents]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at) for r in got)


def test_op5(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op5_bottomk"](spark, SF).collect()}
    by_text = defaultdict(set)
    for k, (i, t, _) in enumerate(documents):
        t, after = t or "", documents[(k + 1) % len(documents)][1] or ""
        half = len(t) // 2
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + after[:half]))
        by_text[t].add(got[i]["fingerprint"])
        assert 0 <= got[i]["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())


def test_op6(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op6_mixing"](spark, SF).collect()}
    has, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, source in documents:
        largest[source] = max(largest[source], size(t))
        assert got[i]["size"] == size(t)
        assert got[i]["taken"] <= 3 * size(t)
        has[source] += size(t)
        taken[source] += got[i]["taken"]
    for source, wanted in targets(has).items():
        assert abs(taken[source] - wanted) <= largest[source]


def test_op7(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op7_pii"](spark, SF).collect()}
    for i, t, _ in documents:
        spans = personal(t)
        assert tuple(got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        told = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert got[i]["base_sha256"] == sha(",".join(told))
        assert set(told) <= set(got[i]["spans"].split(",")) | {""}


def test_op8(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op8_simhash"](spark, SF).collect()}
    prints = {i: simhash(t) for i, t, _ in documents}
    assert {i: got[i]["fingerprint"] for i in prints} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: got[i]["component_id"] for i in prints} == linked(prints)


def test_op10_brute_force_agrees_with_sql_on_some(spark, documents, duck):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op10_decontamination"](spark, SF).collect()}
    short = [(i, t) for i, t, _ in documents if len(t or "") < 400]
    assert short
    for i, t in short:
        n, hit, found = contaminated(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(found), sha(",".join(found)))
