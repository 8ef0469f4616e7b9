"""Every stage of the pipeline against a plain version of it, on what its predecessor kept."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.shared import table

from .brute import DOCS, contaminated, linked, personal, simhash, size, targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('steps')}"
    docs, out = table(spark, SF, "documents"), {"documents": table(spark, SF, "documents")}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert steps[name].columns == steps["documents"].columns


def test_quality_drops_what_scores_low(spark, steps):
    scores = {r["doc_id"]: r["score"] for r in quality_scores(steps["documents"], table(spark, SF, "labels")).collect()}
    assert set(rows(steps["quality"])) == {i for i, s in scores.items() if s >= 0.7}
    assert 0 < len(rows(steps["quality"])) < len(scores)


def test_one_document_of_each_group_stays(steps):
    groups = linked({i: simhash(r["text"]) for i, r in rows(steps["quality"]).items()})
    assert set(rows(steps["near_duplicates"])) == set(groups.values())


def test_no_benchmark_passage_is_left(spark, steps):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    before, after = rows(steps["near_duplicates"]), rows(steps["decontamination"])
    # brute force is quadratic, so long texts are looked at through the words that can match
    known = {w for _, t in items for w in (t or "").lower().split()}
    few = [i for i, r in before.items() if sum(w.lower() in known for w in (r["text"] or "").split()) < 400]
    assert {i for i in few if i in after} == {i for i in few if not contaminated(before[i]["text"], items)[1]}


def test_personal_data_is_replaced(steps):
    before, after = rows(steps["decontamination"]), rows(steps["personal_data"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert personal(r["text"]) == []
        if r["text"] == before[i]["text"]:
            assert r == before[i]
        else:
            assert r["n_chars"] == len(r["text"])
    assert any(r["text"] != before[i]["text"] for i, r in after.items())


def test_mixing_comes_near_the_targets(steps):
    before, has, taken = rows(steps["personal_data"]), defaultdict(int), defaultdict(int)
    for r in before.values():
        has[r["source"]] += size(r["text"])
    for i, r in rows(steps["mixing"]).items():
        assert r["text"] == before[i]["text"]
        assert r["taken"] == r["copies"] * size(r["text"])
        assert 1 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    largest = max(size(r["text"]) for r in before.values())
    for source, wanted in targets(has).items():
        assert abs(taken[source] - wanted) <= largest + 1


def test_run_gives_the_same_rows(spark, steps):
    pick = lambda df: sorted((r["doc_id"], r["copies"]) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, SF)) == pick(steps["mixing"])


def test_empty_and_odd_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    odd = [(1, None, None, None, None), (None, None, "en", "a", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "w " * 1000, "en", "a", 2000)]
    labels, items = "doc_id bigint, quality int, toxic int", "item_id bigint, text string"
    spark.createDataFrame([(3, 1, 0), (2, 0, None), (None, 1, 1)], labels).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "x y")], items).write.parquet(f"{folder}/benchmark.parquet")
    for table_rows in (odd, []):
        docs = spark.createDataFrame(table_rows, DOCS)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{len(table_rows)}-{k}")
            docs = spark.read.parquet(f"{folder}/{len(table_rows)}-{k}")
        assert docs.count() <= len(table_rows)


CLASHING = ("__quality_score", "__id", "__hash", "__text_hash", "__base", "__wide", "__spans", "__votes", "__anchors", "__all", "__size", "__n", "__fp", "row", "doc", "found", "all", "hash", "size", "rank", "first", "fp", "own", "component", "words", "key", "items", "label", "odd.name", "Copies_")


def test_columns_of_any_name_stay(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, f"text {i} write to a{i}@b.de please", "en", "a", 30) for i in range(12)] + [(None, "alpha beta", "en", None, 10)]
    docs = spark.createDataFrame(rows, DOCS)
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        out.write.parquet(f"{folder}/{k}")
        kept = spark.read.parquet(f"{folder}/{k}").collect()
        for r in kept:
            assert all(r[c] == f"{i}-{-1 if r['doc_id'] is None else r['doc_id']}" for i, c in enumerate(CLASHING)), name
        if kept:
            docs = spark.read.parquet(f"{folder}/{k}")
