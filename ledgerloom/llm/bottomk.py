"""Bottom-k sketches of word shingles: mergeable fingerprints of documents.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles
(Broder 1997; Cohen and Kaplan 2007). The sketch of a union is the k smallest of two sketches, so
parts can be sketched apart. From sketches follow estimates of the resemblance, of containment and
of the number of distinct shingles; they are exact while a text has at most k shingles.

Everything is column expressions. Null texts count as empty; an empty text has an empty sketch. A
text of fewer than ``SHINGLE_WORDS`` words is one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import unused
from .shared import lower_ascii, shuffle_partitions

SHINGLE_WORDS = 5
K = 128
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of text that one task sorts to find each document's next one.
BUCKET_BYTES = 32 << 20
#: Most buckets; the driver holds a bound of each. Beyond, buckets grow, and their sort spills.
MAX_BUCKETS = 10_000


def sketch(text: Column, k: int = K, shingle_words: int = SHINGLE_WORDS) -> Column:
    words = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.transform(F.array(hashes), lambda h: F.when(F.size(h) < shingle_words, F.when(F.size(h) > 0, F.array(F.xxhash64(h)))).otherwise(_shingles(h, shingle_words)))
    found = F.coalesce(starts[0], F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def _shingles(h: Column, n: int) -> Column:
    return F.transform(F.slice(h, F.lit(1), F.size(h) - (n - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, n))))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index of the shingle sets; 1 for two empty sets."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(merge(a, b, k)).cast("double"))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fewer than k."""
    last = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r / (1 + r) * (n + m) / n))


def hex_string(s: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge_groups(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K, salts: int = 32) -> DataFrame:
    """(keys, sketch): the sketch of each group's union. Salted, so a hot key is reduced in parts first.

    Null keys are one group, as in any grouping. Null and empty sketches add nothing; a group of only such
    ones has an empty sketch. Repeated sketches count once. No rows give no groups. Other columns are left out.
    """
    hash_, salt, rank = unused(sketches.select(*keys), "__h", "__salt", "__r")
    h = sketches.select(*keys, F.explode_outer(column).alias(hash_))
    salted = h.withColumn(salt, F.pmod(F.xxhash64(hash_), F.lit(salts))).dropDuplicates([*keys, salt, hash_])
    first = Window.partitionBy(*keys, salt).orderBy(hash_)
    part = salted.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k)
    every = Window.partitionBy(*keys).orderBy(F.col(hash_).asc_nulls_last())
    top = part.withColumn(rank, F.row_number().over(every)).where(F.col(rank) <= k)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(hash_)).alias(column))


def with_next(documents: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Adds, for each of ``columns``, ``next_<column>`` of the row next by doc_id; after the last comes the first.

    Ids are split at quantiles into buckets, as many as the bytes of the texts ask for, whose bounds are the
    only thing the driver sees; rows that share an id are in one bucket. Each bucket is sorted in a task of its own and also gets the rows of the next bucket's first id.
    Rows that share an id are ordered by the hash of their text; null ids come first.
    """
    n = buckets or min(MAX_BUCKETS, max(2 * shuffle_partitions(documents.sparkSession), documents.agg(F.ceil(F.sum(F.octet_length("text")) / BUCKET_BYTES).alias("n")).first()["n"] or 0))
    cuts = ", ".join(str((i + 1) / n) for i in range(n - 1)) or "0.5"
    ids = documents.agg(F.expr(f"percentile_approx(doc_id, array({cuts}), {max(10_000, 10 * n)})").alias("q"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted(set(ids["q"] or []) - {ids["low"]})
    # bounds are ids that occur, so a bucket's first id is its bound, and the first bucket's is the lowest or null
    bucket, opens = F.lit(0), F.lit(False)
    if bounds:
        known = F.array(*(F.lit(b).cast("long") for b in bounds))
        steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))))
        bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
        opens = F.coalesce(F.get(known, bucket - 1) == F.col("doc_id"), F.lit(False))
    lowest = F.col("doc_id").isNull() if ids["nulls"] else F.coalesce(F.col("doc_id") == F.lit(ids["low"]).cast("long"), F.lit(False))
    before = F.when(lowest, F.lit(len(bounds))).when(opens, bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    places = F.when(before.isNull(), F.array(own)).otherwise(F.array(own, F.struct(before.alias("bucket"), F.lit(1).alias("guest"))))
    dealt = documents.withColumn("__place", F.explode(places)).withColumn("__bucket", F.col("__place.bucket")).withColumn("__guest", F.col("__place.guest"))
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # a task for each bucket: a hash of the numbers would put several into some
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("__bucket").cast("int"))
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("__guest = 0").drop("__place", "__bucket", "__guest")


def edited_neighbours(documents: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next) for every row.

    The edited text keeps the first half of a text (the longer one) and replaces the rest by as
    many characters of the next document, or all it has. A single row is its own next.
    """
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(plain.withColumn("sketch", sketch(F.col("text"), k)), ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    out = out.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return out.withColumn("near_edited", resemblance(F.col("sketch"), F.col("edited_sketch"), k)).withColumn("near_next", resemblance(F.col("sketch"), F.col("next_sketch"), k))
