"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL, scored as sparse dot products.

Tokens are runs of word or of punctuation characters, so decoration, table bars and repeated
tokens are n-grams like any others. A null or empty text has the bias as its score. Repeated rows
get equal scores. No document or no label: the model is zero and scores are 0.5. Further columns
of the input stay out of scores, and as they are, whatever their names, in what ``keep_good`` returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import unused
from .ftrl import FtrlParams
from .linear import LinearSpec, fit, score, training_sample
from .shared import held_out

SPEC = LinearSpec(ftrl=FtrlParams(alpha=1.0, l1=0.05, l2=0.1, epochs=2), ngrams=2)
KEEP_AT = 0.7


def quality_scores(documents: DataFrame, labels: DataFrame, spec: LinearSpec = SPEC, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    weights = fit(training_sample(documents, labels, "quality", spec.max_train_rows), spec)
    scored = documents.select("doc_id", held_out().alias("held_out"), score(documents, weights, spec).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, spec: LinearSpec = SPEC, keep_at: float = KEEP_AT) -> DataFrame:
    """Rows of ``documents`` that score at least ``keep_at``, all columns as they were."""
    weights = fit(training_sample(documents, labels, "quality", spec.max_train_rows), spec)
    (kept,) = unused(documents, "__quality_score")
    scored = documents.withColumn(kept, score(documents, weights, spec))
    return scored.where(F.col(kept) >= keep_at).drop(kept)
