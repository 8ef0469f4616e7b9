"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size. The
fractional parts are rounded by the pivotal method (Deville & Tille 1998) in a form weighted by
document size: two fractions exchange words until one is 0 or 1, in a random direction that keeps
both expectations, so the words taken from the source never change on the way. Blocks of documents
are rounded in parallel; each leaves one unsettled document, and these meet in the next level of a
reduction tree, until a source has one block left. There the largest unsettled document exchanges with
all smaller ones together, as with one partner, as long as they have the words to settle it either way,
else with the next largest; so what is left at the very end is the smallest document, or few could take
part. It is rounded at random, with its fraction as the chance. Every step keeps every document's
expectation; a source misses its target by less than the document that is left at the end.

Nulls: a null text has size 0; null sources form one source, ranked last. Documents of size 0 are
taken 0 times. Repeated rows are separate documents; ties are ordered by hash, id and size, so
reruns agree. Further columns are ignored, or kept as they are where documents are returned. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import numbered
from .shared import cut, shared_dir

WORD_BREAK = r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK_ROWS = 1024
#: More sources than this are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return F.coalesce(F.when(text.isNull(), 0).otherwise(F.size(words)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, rank, target) from rows with (source, size).

    The targets share the total size by weight; a target above ``most_copies`` times its source's
    size stops there, and the excess is shared again by weight among the others.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(numbered(sources, F.col("source").asc_nulls_last(), name="rank").withColumn("rank", F.col("rank") - 1).withColumn("weight", weight))
    most = F.col("source_size") * float(most_copies)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, capped = None, None
    while True:
        above = F.lit(False) if level is None else most < level * F.col("weight")
        now = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most).otherwise(0.0)).alias("words"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if now["n"] == capped or not now["weight"]:
            break
        capped, level = None if level is None else now["n"], (total - now["words"]) / now["weight"]
    return ranked.withColumn("target", F.least(most, (level or 0.0) * F.col("weight"))).drop("weight")


def pivotal(fraction: np.ndarray, size: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in (0, 1); the sum of fraction * size stays. Returns them and the place of the one left, or -1."""
    p, s = fraction.tolist(), size.tolist()
    held = 0 if p else -1
    for j in range(1, len(p)):
        if held < 0:
            held = j
            continue
        a, b = p[held], p[j]
        up = min((1 - a) * s[held], b * s[j])
        down = min(a * s[held], (1 - b) * s[j])
        if chance[j] * (up + down) < down:
            to_one, to_zero = (1 - a) * s[held] <= up, b * s[j] <= up
            p[held], p[j] = (1.0 if to_one else a + up / s[held]), (0.0 if to_zero else b - up / s[j])
            held_done, other_done = to_one, to_zero
        else:
            to_zero, to_one = a * s[held] <= down, (1 - b) * s[j] <= down
            p[held], p[j] = (0.0 if to_zero else a - down / s[held]), (1.0 if to_one else b + down / s[j])
            held_done, other_done = to_zero, to_one
        if held_done:
            held = -1 if other_done else j
    return np.array(p), held


def settle_all(fraction: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds all fractions of documents that are sorted by size, the largest first; their expectations stay."""
    p = fraction.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        k, others = open_[0], open_[1:]
        words = size[others].sum()
        gains, loses = (1 - p[k]) * size[k], p[k] * size[k]
        if p[others].min() * words < gains or (1 - p[others].max()) * words < loses:
            others = others[:1]
            words = size[others[0]]
            gains, loses = min(gains, p[others[0]] * words), min(loses, (1 - p[others[0]]) * words)
        moved = gains if rng.random() * (gains + loses) < loses else -loses
        p[k] += moved / size[k]
        p[others] -= moved / words
        p[np.abs(p) < 1e-9] = 0.0
        p[np.abs(p - 1) < 1e-9] = 1.0
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    if len(open_):
        p[open_] = float(rng.random() < p[open_[0]])
    return p


_ROWS = "row long, doc_id long, hash long, number long, rank long, size long, base long, fraction double, copies long"


def _round_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    level, rank, block = (int(x) for x in key[:3])
    pdf = pdf.sort_values(["size", "order", "doc_id", "hash", "number"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    rng = np.random.default_rng([level, rank, block])
    size = pdf["size"].to_numpy(float)
    fraction = pdf["fraction"].to_numpy()
    p, left = (settle_all(fraction, size, rng), -1) if key[3] else pivotal(fraction, size, rng.random(len(pdf)))
    copies = pd.Series(np.rint(p).astype(np.int64) + pdf["base"].to_numpy(), dtype="Int64")
    if left >= 0:
        copies[left] = pd.NA
    return pdf[["row", "doc_id", "hash", "number", "rank", "size", "base"]].assign(fraction=p, copies=copies)


def dealt(rows: DataFrame, level: int, block_rows: int) -> DataFrame:
    """Rows with the block in which they are rounded at a level, by a hash of what tells them apart."""
    order = F.xxhash64(F.lit(level), "doc_id", "size", "hash", "number")
    blocks = F.greatest(F.ceil(F.col("n") / float(block_rows)), F.lit(1))
    return rows.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.col("order")), blocks)).withColumn("level", F.lit(level)).withColumn("last", blocks == 1)


def _round_level(rows: DataFrame, level: int, block_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Rounds in blocks: (settled rows, one unsettled row a block, how many unsettled)."""
    done = cut(dealt(rows, level, block_rows).groupBy("level", "rank", "block", "last").applyInPandas(_round_block, _ROWS))
    open_ = done.where(F.col("copies").isNull())
    return done.where(F.col("copies").isNotNull()), open_, open_.count()


def _sized() -> list[Column]:
    """What the mix needs of a document: a number of its row, id, a hash of the text, source and size."""
    hashed = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash")
    return [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), hashed, F.col("source"), word_count(F.col("text")).alias("size")]


def _numbered(sized: DataFrame) -> DataFrame:
    """Adds ``number``, which tells equal rows apart, from 1; so they spread over blocks as other rows do.

    Rows are counted in their partition first, so that no task gets all rows that are equal. Which of them has
    which number depends on the partitions, but as they are equal, results do not.
    """
    named = sized.withColumns({"part": F.shiftright("row", 33), "same": F.xxhash64("doc_id", "size", "hash")})
    counts = named.groupBy("same", "part").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("same", "part", before.alias("before")).where("before > 0")
    inside = named.withColumn("number", F.row_number().over(Window.partitionBy("same", "part").orderBy("row")).cast("long"))
    return inside.join(earlier, ["same", "part"], "left").withColumn("number", F.col("number") + F.coalesce("before", F.lit(0))).drop("same", "part", "before")


def _copies(sized: DataFrame, weights: tuple[float, ...], most_copies: int, block_rows: int) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken) for the rows of ``sized``."""
    targets = source_targets(sized, weights, most_copies)
    sized = _numbered(sized)
    if targets.count() <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = sized.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.abs(share - F.round(share)) < 1e-12
    base = F.when(whole, F.round(share)).otherwise(F.floor(share)).cast("long")
    ready = rows.select("row", "doc_id", "hash", "number", "rank", F.col("docs").alias("n"), "size", base.alias("base"), F.when(whole | (F.col("size") == 0), 0.0).otherwise(share - F.floor(share)).alias("fraction"))
    fixed = ready.where(F.col("fraction") == 0).select("row", "doc_id", "rank", "size", F.col("base").alias("copies"))
    settled, unsettled, left = _round_level(ready.where(F.col("fraction") > 0), 0, block_rows)
    out, level = fixed.unionByName(settled.select("row", "doc_id", "rank", "size", "copies")), 0
    while left:
        level += 1
        n = unsettled.groupBy("rank").agg(F.count("*").alias("n"))
        settled, unsettled, left = _round_level(unsettled.drop("copies").join(n, "rank"), level, block_rows)
        out = out.unionByName(settled.select("row", "doc_id", "rank", "size", "copies"))
    return out.join(targets, "rank").select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = MOST_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``documents``."""
    return _copies(cut(documents.select(*_sized())), weights, most_copies, block_rows).drop("row")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """The documents taken at least once, with all their columns, ``copies`` and ``taken``.

    Columns of these two names in ``documents`` are replaced. Rows are numbered when they are written to the
    shared folder, so rows that share an id, or are equal, are told apart, and are dealt once, by that number.
    """
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    kept = [c for c in documents.columns if c.lower() not in ("copies", "taken")]
    doc = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc")
    documents.select(doc, *_sized()).write.parquet(folder)
    stored = spark.read.parquet(folder)
    chosen = _copies(cut(stored.drop("doc")), weights, most_copies, BLOCK_ROWS).where("copies > 0").select("row", "copies", "taken")
    return stored.select("row", "doc").join(chosen, "row").select("doc.*", "copies", "taken")
