"""Distributed fitting and scoring of hashed linear classifiers.

Fitting: a bounded sample of labelled documents is dealt to shards; each shard runs FTRL from the
common state, and the states are averaged by feature, weighted by how much of the feature each
shard saw (iterative parameter mixing, McDonald et al. 2010). The common state has 2**bits entries
at any corpus size, which bounds what the driver holds and what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from .ftrl import Ftrl, FtrlParams, sigmoid, train_rows
from .shared import cut, held_out

#: Most labelled documents that a classifier is fitted on (expected size of the hash sample).
MAX_TRAIN_ROWS = 20_000
#: Texts are scored in slices of about so many characters, which bounds a worker's memory.
SLICE_CHARS = 1 << 21


@dataclass(frozen=True)
class LinearSpec:
    ftrl: FtrlParams = field(default_factory=FtrlParams)
    ngrams: int = 2
    prefixes: tuple[int, ...] = ()
    presence: bool = False
    max_shards: int = 16
    rows_per_shard: int = 1000
    rounds: int = 3
    seed: int = 17
    counterfactual: Callable[[str], str | None] | None = None
    penalty: float = 0.0
    max_train_rows: int = MAX_TRAIN_ROWS

    def rows(self, texts: list[str | None]):
        return features.sparse_rows(texts, self.ftrl.bits, self.ngrams, self.prefixes, self.presence)


def training_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Labelled, not held-out documents: (doc_id, text, y), a hash sample of about ``max_rows`` at most.

    Null labels, null ids and labels other than 0 and 1 are left out; of several labels for one
    id the largest counts. The labels kept are at most about ``max_rows``, so they may be broadcast.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    return documents.select("doc_id", "text").join(F.broadcast(usable), "doc_id")


def _contrasts(spec: LinearSpec, texts: list[str | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if spec.counterfactual is None:
        return {}
    swapped = {i: s for i, t in enumerate(texts) if t and (s := spec.counterfactual(t)) is not None}
    out = {}
    for i, other in swapped.items():
        ptr, ids, value = spec.rows([texts[i], other])
        f, place = np.unique(ids, return_inverse=True)
        v = np.zeros(len(f), np.float32)
        np.add.at(v, place[: ptr[1]], value[: ptr[1]])
        np.subtract.at(v, place[ptr[1] :], value[ptr[1] :])
        keep = v != 0
        if keep.any():
            out[i] = f[keep], v[keep]
    return out


def _sliced_rows(spec: LinearSpec, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``spec.rows``, made of a slice of the texts at a time, so only the sparse rows of all are held at once."""
    parts = [spec.rows(part) for part in _slices(texts)]
    if not parts:
        return spec.rows([])
    shift = np.cumsum([0, *(len(ids) for _, ids, _ in parts)])
    ptr = np.concatenate([[0], *(p[1:] + at for (p, _, _), at in zip(parts, shift, strict=False))])
    return ptr, np.concatenate([x for _, x, _ in parts]), np.concatenate([x for _, _, x in parts])


def _train_shard(spec: LinearSpec, start, round_no: int, key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"])
    state = Ftrl(spec.ftrl)
    if start is not None:
        state.z, state.n = (x.copy() for x in start.value)
    before = state.n.copy()
    texts = pdf["text"].tolist()
    train_rows(state, _sliced_rows(spec, texts), pdf["y"].to_numpy(float), spec.ftrl.epochs, spec.seed + 1000 * round_no + int(key[0]), _contrasts(spec, texts), spec.penalty)
    seen = np.flatnonzero(state.n > before)
    return pd.DataFrame({"feature": seen, "z": state.z[seen], "n": state.n[seen], "gain": (state.n - before)[seen]})


def _shard_trainer(spec: LinearSpec, start, round_no: int):
    def train(key, pdf):
        return _train_shard(spec, start, round_no, key, pdf)

    return train


def fit(sample: DataFrame, spec: LinearSpec) -> np.ndarray:
    """Weights by feature, the bias last, from a ``training_sample``; zeros for an empty one."""
    spark = sample.sparkSession
    sample = cut(sample)
    n_shards = min(spec.max_shards, max(1, sample.count() // spec.rows_per_shard))
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(n_shards)))
    state, start = Ftrl(spec.ftrl), None
    for round_no in range(spec.rounds):

        shards = dealt.groupBy("shard").applyInPandas(_shard_trainer(spec, start, round_no), "feature long, z double, n double, gain double")
        mixed = shards.groupBy("feature").agg(*(F.expr(f"sum({x} * gain) / sum(gain)").alias(x) for x in ("z", "n"))).toPandas()
        at = mixed["feature"].to_numpy()
        state.z[at], state.n[at] = mixed["z"].to_numpy(), mixed["n"].to_numpy()
        start = spark.sparkContext.broadcast((state.z, state.n))
    return state.dense()


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        if size > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def score(documents: DataFrame, weights: np.ndarray, spec: LinearSpec, text: str = "text") -> Column:
    """Probability of label 1 for the whole text; an empty or null text gets the bias."""
    model = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = model.value
        for texts in batches:
            logits = [features.dot_rows(*spec.rows(part), w) for part in _slices(texts.tolist())]
            yield pd.Series(sigmoid(np.concatenate(logits or [np.zeros(0)]) + float(w[-1])))

    return probability(F.col(text))
