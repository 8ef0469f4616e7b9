"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is cut into 32 segments of two bits and each segment mapped to its bit count,
0, 1 or 2. The Manhattan distance of two count vectors never exceeds the Hamming distance of the
fingerprints, so pairs whose vectors are further apart than the threshold cannot link. A vector is held
in unary code (00, 01, 11), in which its Manhattan distance is a count of differing bits.

The grid: the 32 counts are dealt to blocks, THRESHOLD + k of them. Vectors at a distance within the
threshold differ in at most THRESHOLD blocks, so k blocks have equal counts; each layer of the grid takes
k blocks, and its cells are their counts. Within a cell the sum of all counts is the coordinate of a
range join, what passes is compared by the Manhattan distance of whole vectors, and what passes that on
the bits. The number of blocks follows the number of fingerprints, so cells stay small; every pair
within the threshold meets in some cell at any size. Shorter segments make finer cells: README has
measured figures for segments of 8, 4 and 2 bits.

In a cell larger than ``CELL_ROWS``, the fingerprint nearest to the majority of its bits is the pivot.
What links to the pivot is connected by that, so only pairs with one that does not are compared, in
blocks, each pair of blocks a task of its own. Copies of one text with few changes thus cost as much
as they are. A cell yields one edge for each fingerprint that links to others, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.lineage import unused
from .shared import cut, shuffle_partitions, spread

SHINGLE_WORDS = 4
SEED = 42
THRESHOLD = 4
CELL_ROWS = 16_384
#: More large cells than this are joined by a shuffle.
MAX_BROADCAST_CELLS = 100_000
#: Side of the rows of a cell that is compared as a whole.
WHOLE = -1
#: Every other bit: the lower ones of the segments.
LOWER = 0x5555555555555555
SEGMENTS = 32


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; 0 for no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle_words + 1)
    last = ends[-1:] if len(words) < shingle_words else ends[shingle_words - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash(text: str = "text"):
    """Column of fingerprints, as signed longs."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint_of(t) for t in texts), np.uint64, len(texts)).view(np.int64))

    return fingerprints(F.col(text))


def counts(fp: Column) -> Column:
    """Vector of the bit counts of the 32 segments, in unary code."""
    low, high = fp.bitwiseAND(F.lit(LOWER)), F.shiftright(fp, 1).bitwiseAND(F.lit(LOWER))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _counts(fps: np.ndarray) -> np.ndarray:
    low, high = fps & np.uint64(LOWER), (fps >> np.uint64(1)) & np.uint64(LOWER)
    return low | high | ((low & high) << np.uint64(1))


def cell_masks(n: int, threshold: int = THRESHOLD, cell_rows: int = CELL_ROWS) -> list[int]:
    """One mask for each layer of the grid: the segments whose counts must be equal.

    The counts of two random segments are equal with a chance of 3/8, so that part of a cell's side.
    """
    for blocks in range(threshold + 1, 2 * threshold + 5):
        edges = [SEGMENTS * i // blocks for i in range(blocks + 1)]
        equal = blocks - threshold
        if n <= cell_rows // 4 * (8 / 3) ** (equal * (SEGMENTS // blocks)) or blocks == 2 * threshold + 4:
            parts = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
            return [sum(c) for c in combinations(parts, equal)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining places i and j pairwise: each place gets the smallest place it is connected with."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _links(fps: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, those that link: by the Manhattan distance of the count vectors first, then on the bits."""
    near = np.bitwise_count(vectors[i] ^ vectors[j]) <= threshold
    i, j = i[near], j[near]
    same = np.bitwise_count(fps[i] ^ fps[j]) <= threshold
    return i[same], j[same]


def join_cell(fps: np.ndarray, threshold: int = THRESHOLD, side: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint of a cell, the place of one that it is connected with (its own, if with none).

    ``side``: only pairs of different sides are compared, if given.
    """
    n = len(fps)
    total = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(total, kind="stable")
    sorted_fps, vectors, total = fps[order], _counts(fps[order]), total[order]
    sides = None if side is None else side[order]
    reach = np.searchsorted(total, total + threshold, "right")
    label, step = np.arange(n), max(1, (1 << 20) // n)
    for s in range(0, n, step):
        e = min(n, s + step)
        close = np.bitwise_count(vectors[s:e, None] ^ vectors[None, s : reach[e - 1]]) <= threshold
        i, j = np.nonzero(close)
        keep = (i < j) if sides is None else (i < j) & (sides[s + i] != sides[s + j])
        label = _connect(label, *_links(sorted_fps, vectors, s + i[keep], s + j[keep], threshold))
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _join_small(fps: np.ndarray, ends: np.ndarray, label: np.ndarray, threshold: int) -> np.ndarray:
    """Labels after joining cells of a few rows, all at once: each row with the next, the one after, and so on.

    ``ends`` has the end of the cell for the rows of small cells, 0 for others.
    """
    vectors, at, gap = _counts(fps), np.flatnonzero(ends), 1
    while len(at := at[at + gap < ends[at]]):
        label = _connect(label, *_links(fps, vectors, at, at + gap, threshold))
        gap += 1
    return label


def _match_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within the cells of one partition: small cells all at once, larger ones one by one."""
    parts = [x for x in batches if len(x)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    columns = [rows[c].to_numpy() for c in ("layer", "cell", "pair")]
    order = np.lexsort((rows["fp"].to_numpy(), *columns[::-1]))
    keys = [c[order] for c in columns]
    fps, block = rows["fp"].to_numpy()[order].view(np.uint64), rows["block"].to_numpy()[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order))
    few = (ends - starts <= 64) & (block[starts] == WHOLE)
    label = _join_small(fps, np.repeat(np.where(few, ends, 0), ends - starts), np.arange(len(fps)), THRESHOLD)
    for s, e in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
        side = block[s:e]
        if side[0] == WHOLE or not (side == side[0]).all():  # else a block that meets nothing
            label[s:e] = s + join_cell(fps[s:e], THRESHOLD, None if side[0] == WHOLE else side)
    linked = np.flatnonzero(label != np.arange(len(label)))
    if len(linked):
        yield pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)})


def _pivots(rows: DataFrame) -> DataFrame:
    """(layer, cell, pivot): the fingerprint of each cell that is nearest to the majority of its bits."""
    bit = lambda i: F.shiftright("fp", i).bitwiseAND(F.lit(1))
    sums = rows.groupBy("layer", "cell").agg(F.count("*").alias("n"), *(F.sum(bit(i)).alias(f"bit{i}") for i in range(64)))
    majority = reduce(lambda x, y: x.bitwiseOR(y), (F.when(2 * F.col(f"bit{i}") > F.col("n"), F.lit(_signed(1 << i))).otherwise(F.lit(0)) for i in range(64)))
    near = rows.join(spread(sums.select("layer", "cell", majority.alias("majority"))), ["layer", "cell"])
    best = near.groupBy("layer", "cell").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("majority"))), "fp")).alias("p"))
    return spread(best.select("layer", "cell", F.col("p.fp").alias("pivot")))


def _large_cells(rows: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of (layer, cell, count, fp) in large cells: (links to the pivots, the pairs of blocks that are left to compare)."""
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= THRESHOLD
    joined = cut(rows.join(_pivots(rows), ["layer", "cell"]).withColumn("far", ~near))
    direct = joined.where("NOT far").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    far = spread(joined.where("far").groupBy("layer", "cell").agg(F.count("*").alias("n_far")))
    half = cell_rows / 2
    open_ = joined.join(far, ["layer", "cell"]).withColumn("blocks", F.ceil(F.col("count") / half)).withColumn("far_blocks", F.ceil(F.col("n_far") / half))
    own, other = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.pmod(F.xxhash64("fp"), F.col("far_blocks"))
    zero = F.lit(0).cast("long")
    # a pair of blocks: any rows on side 0, rows far from the pivot on side 1
    left = open_.withColumn("x", F.explode(F.sequence(zero, F.col("far_blocks") - 1))).withColumn("pair", own * F.col("far_blocks") + F.col("x")).withColumn("block", F.lit(0))
    right = open_.where("far").withColumn("x", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("pair", F.col("x") * F.col("far_blocks") + other).withColumn("block", F.lit(1))
    return direct, left.unionByName(right).select(*_DEALT)


_DEALT = ("layer", "cell", "pair", "block", "fp")


def links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all of ``prints`` (fp, distinct) within the threshold."""
    spark = prints.sparkSession
    n = prints.count()
    masks = cell_masks(n)
    layers = F.explode(F.array(*(F.struct(F.lit(i).alias("layer"), counts(F.col("fp")).bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(masks))))
    dealt = prints.select("fp", layers.alias("x")).select("fp", "x.layer", "x.cell")
    large = cut(dealt.groupBy("layer", "cell").count().where(F.col("count") > cell_rows))
    n_large, direct = large.count(), None
    if n_large:
        cells = F.broadcast(large) if n_large <= MAX_BROADCAST_CELLS else large
        counted = dealt.join(cells, ["layer", "cell"], "left")
        direct, pairs = _large_cells(cut(counted.where("count IS NOT NULL")), cell_rows)
        dealt = counted.where("count IS NULL")
    whole = dealt.withColumn("pair", F.lit(0).cast("long")).withColumn("block", F.lit(WHOLE)).select(*_DEALT)
    rows = whole.unionByName(pairs) if n_large else whole
    parts = max(shuffle_partitions(spark), n * len(masks) // 1_000_000)
    found = rows.repartition(parts, "layer", "cell", "pair").mapInPandas(_match_cells, "a long, b long")
    return found.unionByName(direct) if n_large else found


def _grouped(prints: DataFrame, first: Column) -> DataFrame:
    """(fp, first): the least ``first`` of each component of the fingerprints of ``prints``."""
    distinct = cut(prints.groupBy("fp").agg(first.alias("own")))
    labels = components(links(distinct.select("fp")))
    named = cut(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("component", "fp").alias("component")))
    least = spread(named.groupBy("component").agg(F.min("own").alias("first")))
    return spread(named.join(least, "component").select("fp", "first"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``documents``.

    Null and empty texts have fingerprint 0 and link like any other. A row without doc_id links too, but
    names no component: if none of a component has an id, its id is null. Repeated rows come back as often
    as they are; rows that share an id but no fingerprint are told apart. Other columns are ignored.
    """
    prints = cut(documents.select("doc_id", simhash().alias("fp")))
    return prints.join(_grouped(prints, F.min("doc_id")), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def fingerprint_hex(fp="fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates; all columns as they were.

    It is the one with the smallest doc_id, a null id coming last, and of several texts with that id the
    one of the smallest hash. Of repeated rows, equal in id and text, any one stays.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"))
    prints = cut(documents.select(first.alias("row"), simhash().alias("fp")))
    kept = _grouped(prints, F.min("row")).select("first").distinct()
    id_key, text_key = unused(documents, "__id", "__hash")
    # both keys are never null, so the join and the removal of repeated rows share one exchange
    wanted = kept.select(F.xxhash64("first.doc_id").alias(id_key), F.col("first.hash").alias(text_key))
    keyed = documents.withColumn(id_key, F.xxhash64("doc_id")).withColumn(text_key, F.coalesce(F.xxhash64("text"), F.lit(0)))
    return keyed.join(wanted, [id_key, text_key], "left_semi").dropDuplicates([id_key, text_key]).drop(id_key, text_key)
