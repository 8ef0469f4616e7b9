import math

import numpy as np
import pytest

from ledgerloom.llm import whitening
from ledgerloom.llm.queries import op12_whitening

VECTORS = "vec_id bigint, embedding array<double>, i string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], VECTORS)


def check(got, rows):
    """Compares with numpy; rows are those that remain."""
    xs = [tuple(math.floor(64 * float(e)) + 1_000_000 for e in v) for _, v in rows]
    fit = np.array(sorted(set(xs)), dtype=object)
    n, d = fit.shape
    sums = fit.sum(axis=0)
    centred = np.array([[float(n * e - s) / n for e, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, d)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert len(got) == len(rows) * k
    assert {i for i, _ in rows} == set(by_id)
    signs = {}
    for (i, _), x in zip(rows, xs, strict=True):
        off = [n * e - s for e, s in zip(x, sums, strict=True)]
        for c in range(1, k + 1):
            r = by_id[i][c][0]
            assert (r["n"], r["deviation"]) == (n, sum(e * e for e in off))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-4, abs=1e-12)
            if values[c - 1] <= 1e-10 * values[0]:
                assert r["whitened"] is None
                continue
            assert r["identity_error"] < 1e-4
            own = float(np.array(off, float) / n @ vectors[:, c - 1] / math.sqrt(values[c - 1]))
            sign = signs.setdefault(c, np.sign(own * r["whitened"])) if abs(own) > 1e-3 else signs.get(c, np.sign(own * r["whitened"]))
            assert r["whitened"] == pytest.approx(sign * own, abs=1e-6)


def test_query(spark, sf_dir):
    got = op12_whitening(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(got, [(r[0], r[1]) for r in rows])


def test_blocks_repeats_and_dropped_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 4)
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=9) * np.arange(1, 10)).tolist()) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(30)] + [(None, good[1][1])]
    odd = [(500, None), (501, [1.0] * 8 + [None]), (502, [math.nan] + [1.0] * 8), (503, [math.inf] + [1.0] * 8), (504, [1.0]), (505, []), (506, [1e300] + [0.0] * 8)]
    got = whitening.whiten(table(spark, good + odd).repartition(5)).collect()
    check(got, good)


def test_components_without_variance(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [a, b, 0.5]) for i, (a, b) in enumerate(rng.normal(size=(20, 2)).tolist())]
    got = whitening.whiten(table(spark, rows)).collect()
    check(got, rows)
    assert sum(r["whitened"] is None for r in got) == 20


def test_one_vector_and_none(spark):
    got = whitening.whiten(table(spark, [(1, [0.1, 0.2]), (2, [0.1, 0.2])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
