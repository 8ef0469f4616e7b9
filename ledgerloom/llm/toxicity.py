"""Counterfactual-regularised toxicity classifier.

Training adds, for every labelled text that names a group, the text with its group names swapped
for others of the same kind, and penalises the squared change of the log-odds (counterfactual
logit pairing, Garg et al. 2019). Words and word beginnings are features, present or absent.

A null or empty text has the bias as its score. Repeated rows get equal scores. No document or no
label: the model is zero and scores are 0.5. Further columns of the input stay out of the result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import FtrlParams
from .linear import LinearSpec, fit, score, training_sample
from .shared import held_out

#: Names of groups by kind; a name is swapped for the next one of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_NEXT = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)


def swap_identity_terms(text: str) -> str | None:
    """The text with each group name swapped, or None if it has none."""
    swapped, n = _TERM.subn(lambda m: _NEXT[m[0].lower()], text)
    return swapped if n else None


SPEC = LinearSpec(
    ftrl=FtrlParams(alpha=1.0, l1=4.0, l2=0.1, epochs=3),
    ngrams=1,
    prefixes=(4, 6, 7),
    presence=True,
    counterfactual=swap_identity_terms,
    penalty=1.0,
)
TOXIC_AT = 0.3


def toxicity_scores(documents: DataFrame, labels: DataFrame, spec: LinearSpec = SPEC, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    weights = fit(training_sample(documents, labels, "toxic", spec.max_train_rows), spec)
    scored = documents.select("doc_id", held_out().alias("held_out"), score(documents, weights, spec).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_at).cast("int"))
