import dataclasses
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import features, linear, quality, toxicity
from ledgerloom.llm.shared import table

from .brute import docs

LABELS = "doc_id bigint, quality int, toxic int"


def tokens(text):
    """(token, first bytes) of the feature module's definition, by a regular expression."""
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+|[^\x00\x09-\x0d\x20-\x20" + rb"0-9a-z\x80-\xff]+", data)


def test_equal_tokens_have_equal_hashes_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(features, "PIECE_BYTES", 64)
    rng = random.Random(3)
    words = ["a", "A", "über", "x-y", "...", "word", "Word", "😀", "l" * 40, "12"]
    texts = [None, "", " ", *(" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(50))]
    owner, hashes, _ = features.token_hashes(texts)
    wanted = [(i, t) for i, text in enumerate(texts) for t in tokens(text)]
    assert owner.tolist() == [i for i, _ in wanted]
    by_token = {}
    for (_, t), h in zip(wanted, hashes.tolist(), strict=True):
        assert by_token.setdefault(t, h) == h
    assert len(set(by_token.values())) == len(by_token)


def test_scores_do_not_depend_on_slices(monkeypatch):
    texts = ["one two three", None, "", "x " * 5000, "one two three"]
    spec = quality.SPEC
    w = np.random.default_rng(0).normal(size=1 << spec.ftrl.bits)
    whole = features.dot_rows(*spec.rows(texts), w)
    monkeypatch.setattr(linear, "SLICE_CHARS", 3)
    parts = np.concatenate([features.dot_rows(*spec.rows(p), w) for p in linear._slices(texts)])
    assert parts == pytest.approx(whole)
    assert whole[0] == pytest.approx(whole[4])
    assert whole[1] == whole[2] == 0


def test_sparse_dot_product_matches_brute_force():
    texts = ["a b a b", "a a a", "c"]
    ptr, ids, value = features.sparse_rows(texts, 18, 2)
    # a, b, "a b", "b a": counts 2, 2, 2, 1
    assert sorted(value[ptr[0] : ptr[1]].tolist()) == pytest.approx(sorted(np.sqrt([2, 2, 2, 1]) / np.sqrt(7)))
    # a three times, "a a" twice, two tokens equal to the one before
    assert sorted(value[ptr[1] : ptr[2]].tolist()) == pytest.approx(sorted(np.sqrt([3, 2, 2]) / np.sqrt(7)))
    assert ptr[3] - ptr[2] == 1


@pytest.mark.parametrize(("module", "label", "recall", "false_alarms"), [("quality", "quality", 0.98, 0.1), ("toxicity", "toxic", 0.85, 0.02)])
def test_held_out_accuracy(spark, module, label, recall, false_alarms):
    """Labelled documents that no training saw: share of 1s found, share of 0s taken for 1s, ranking."""
    folder = "/root/testdata/sf0.1"
    scores = {"quality": quality.quality_scores, "toxicity": toxicity.toxicity_scores}[module]
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = scores(documents, labels).join(labels.where(f"{label} IS NOT NULL"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    y, s = np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])
    told = np.array([r["predicted"] for r in rows])
    assert told[y == 1].mean() >= recall
    assert told[y == 0].mean() <= false_alarms
    good, bad = s[y == 1], s[y == 0]
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc >= 0.98


def test_rows_columns_and_edges(spark):
    rows = [(i, f"good text number {i} of plain prose") for i in range(0, 80, 2)] + [(i, f"spam !!! spam {i} buy buy buy") for i in range(1, 80, 2)]
    extra = [(None, "good text"), (500, None), (501, ""), (502, "spam " * 50_000), (0, rows[0][1])]
    df = docs(spark, [*rows, *extra]).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2 ^ 1, i % 2) for i in range(80)] + [(None, 1, 1), (3, None, None), (5, 7, 7)], LABELS)
    for scores, at in ((quality.quality_scores, 0.7), (toxicity.toxicity_scores, 0.3)):
        got = scores(df, labels).collect()
        assert len(got) == len(rows) + len(extra)
        for r in got:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert 0 <= r["score"] <= 1
            assert r["predicted"] == (r["score"] >= at)
        by_id = {}
        for r in got:
            by_id.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(by_id[0]) == 1
        assert by_id[500] == by_id[501]
        assert scores(df.where("false"), labels).count() == 0
        assert {r["score"] for r in scores(df, labels.where("false")).collect()} == {0.5}
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns


def test_held_out_labels_are_not_learnt(spark):
    """The model stays the same if only held-out labels change."""
    df = docs(spark, [(i, f"w{i % 7} w{i % 5} {'bad' if i % 2 else 'fine'}") for i in range(200)])
    flip = lambda on: spark.createDataFrame([(i, (i % 2) ^ (on and zlib.crc32(str(i).encode()) % 4 == 2), 0) for i in range(200)], LABELS)
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality_scores(df, flip(on)).collect()} for on in (False, True))
    assert a == b


def test_swapping_group_names():
    assert toxicity.swap_identity_terms("Two Women met a Muslim") == "Two men met a christian"
    assert toxicity.swap_identity_terms("womens manual") is None


def test_counterfactual_penalty_narrows_the_gap_between_groups(spark):
    """With group names that go with toxic labels, the penalty makes scores depend less on the name."""
    rng = random.Random(4)
    fill = [f"w{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(1200):
        toxic = i % 2
        group = "muslims" if toxic and rng.random() < 0.8 else rng.choice(["christians", "atheists"])
        rows.append((i, " ".join([*rng.sample(fill, 6), group, "scum" if toxic and rng.random() < 0.7 else "friends"])))
        marks.append((i, 0, toxic))
    probes = [(10_000 + k, " ".join([*rng.sample(fill, 6), "muslims", "friends"])) for k in range(100)]
    other = [(20_000 + k, t.replace("muslims", "christians")) for k, (_, t) in enumerate(probes)]
    labels = spark.createDataFrame(marks, LABELS)
    gap = {}
    for penalty in (0.0, toxicity.SPEC.penalty):
        spec = dataclasses.replace(toxicity.SPEC, penalty=penalty)
        s = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs(spark, [*rows, *probes, *other]), labels, spec).collect()}
        gap[penalty] = np.mean([abs(s[10_000 + k] - s[20_000 + k]) for k in range(100)])
    assert gap[toxicity.SPEC.penalty] < 0.6 * gap[0.0]


def test_rows_do_not_depend_on_slices(monkeypatch):
    import numpy as np

    texts = ["one two three", None, "", "two two", "é " * 40, "x"]
    spec = linear.LinearSpec(prefixes=(2,))
    whole = spec.rows(texts)
    monkeypatch.setattr(linear, "SLICE_CHARS", 5)
    assert all(np.array_equal(a, b) for a, b in zip(linear._sliced_rows(spec, texts), whole, strict=True))
    assert [len(x) for x in linear._sliced_rows(spec, [])] == [len(x) for x in spec.rows([])]
