"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of consecutive words. For every window the term that is rarest in
the training corpus is its anchor. The index stores, for each anchor term, a posting for every
occurrence in the training documents: document, position, and the words around it. Windows meet
the postings of their rarest terms in one join on the term; there the lists of the other terms,
shifted by their offsets, are intersected outwards from the anchor, first with the next neighbour,
as part of the join, then as far as the words agree. The index is laid out by document, so an
intersection never needs a second shuffle, and common terms are never looked up unless a window
has no rarer one.

Everything is DataFrame operations. Words are compared as text; hashes only speed up the join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import unused
from .shared import cut, lower_ascii, shared_dir

#: What separates words, after lower-casing A-Z: everything but 0-9, a-z and non-ASCII characters.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Consecutive words of a document within which a proximity match lies: WINDOW - 1 on either side of a word.
STRETCH = 2 * WINDOW - 1
#: Up to so many distinct test terms or anchors are broadcast (about 50 and 400 bytes each); beyond, joins shuffle.
MAX_BROADCAST_TERMS = 500_000
MAX_BROADCAST_ANCHORS = 100_000


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), WORD_BREAK), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def document_words(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words) of every row, written once to the shared folder: all steps read the words from there.

    Texts are split into words once; reading words back costs less than splitting again.
    """
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    rows = documents.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("text_hash"), words_of(F.col("text")).alias("words"))
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, copy, n, position, term, before, after): one row a word of a test item.

    ``copy`` tells apart items that share an id; ``before`` and ``after`` are up to WINDOW - 1 words.
    """
    items = benchmark.select("item_id", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("copy"), words_of(F.col("text")).alias("words")).dropDuplicates(["item_id", "copy"])
    at = items.select("item_id", "copy", "words", F.size("words").alias("n"), F.posexplode("words").alias("position", "term"))
    return at.select("item_id", "copy", "n", "position", "term", *_around(WINDOW - 1)).withColumn("key", F.xxhash64("term"))


def _around(reach: int) -> list[Column]:
    """The words before (nearest first) and after a position, as arrays of up to ``reach``."""
    low = F.greatest(F.col("position") - reach, F.lit(0))
    before = F.reverse(F.slice("words", low + 1, F.col("position") - low)).alias("before")
    after = F.slice("words", F.col("position") + 2, F.lit(reach)).alias("after")
    return [before, after]


def term_frequencies(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, frequency): how often each test term occurs in the whole corpus."""
    keys = _small(terms.select("key").distinct(), MAX_BROADCAST_TERMS)
    seen = words.select(F.explode("words").alias("term")).select(F.xxhash64("term").alias("key")).join(keys, "key")
    return seen.groupBy("key").agg(F.count("*").alias("frequency"))


def anchors(words: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The places in test items that are the rarest term of some window; ties go to the leftmost."""
    terms = cut(item_terms(benchmark))
    rated = terms.join(term_frequencies(words, terms), "key", "left").withColumn("rarity", F.struct(F.coalesce("frequency", F.lit(0)).alias("f"), F.col("position").alias("p")))
    ahead = Window.partitionBy("item_id", "copy").orderBy("position").rowsBetween(0, window - 1)
    whole = F.col("position") <= F.greatest(F.col("n") - window, F.lit(0))
    best = rated.withColumn("best", F.min("rarity").over(ahead)).where(whole).select("item_id", "copy", F.col("best.p").alias("position"), F.col("best.f").alias("frequency")).distinct()
    # a window with a term that no document has cannot occur
    best = best.where(F.col("frequency") > 0).drop("frequency")
    same = F.expr("t.item_id <=> b.item_id AND t.copy = b.copy AND t.position = b.position")  # items without id too
    return cut(terms.alias("t").join(best.alias("b"), same, "left_semi"))


def _agree(mine: str, other: str) -> Column:
    """How many leading words of two lists are equal, up to WINDOW - 1."""
    run = F.lit(0)
    for i in range(WINDOW - 1, 0, -1):
        run = F.when(F.get(mine, F.lit(i - 1)) == F.get(other, F.lit(i - 1)), F.lit(1) + run).otherwise(F.lit(0))
    return run


def matches(words: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Exact phrase matches in ``document_words``: (doc_id, text_hash, item_id, first, last), word positions of the document.

    A match is a stretch of words that equals a stretch of the item, has the item's rarest term of
    some window in it, and is at least as long as a window (or as the whole item, if shorter).
    """
    wanted = anchors(words, benchmark).select("key", "item_id", "n", F.col("term").alias("item_term"), F.col("position").alias("item_position"), F.col("before").alias("item_before"), F.col("after").alias("item_after"))
    index = cut(postings(words, wanted, WINDOW - 1))
    wanted = _small(wanted, MAX_BROADCAST_ANCHORS)
    # the nearest neighbours' lists first: every window has the anchor's left or right neighbour
    left = F.get("item_before", F.lit(0)) == F.get("before", F.lit(0))
    right = F.get("item_after", F.lit(0)) == F.get("after", F.lit(0))
    neighbour = (F.col("n") == 1) | F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))
    near = index.join(wanted.alias("w"), (index["key"] == F.col("w.key")) & (F.col("term") == F.col("item_term")) & neighbour)
    spread = near.select("doc_id", "text_hash", "item_id", "n", "position", _agree("before", "item_before").alias("left"), _agree("after", "item_after").alias("right"))
    long_enough = F.col("left") + F.col("right") + 1 >= F.least(F.lit(WINDOW), F.col("n"))
    return spread.where(long_enough).select("doc_id", "text_hash", "item_id", (F.col("position") - F.col("left")).alias("first"), (F.col("position") + F.col("right")).alias("last"))


def postings(words: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_hash, key, term, position, before, after): the index of the terms whose keys are in ``wanted``.

    A posting carries up to ``reach`` words on each side, never the document, so the index grows
    with the length of a text, not with its square. With more keys than are broadcast, postings are
    cut out before the shuffle that drops the other terms.
    """
    keys = wanted.select("key").distinct()
    if keys.count() <= MAX_BROADCAST_TERMS:
        at = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("position", "term")).withColumn("key", F.xxhash64("term"))
        return at.join(F.broadcast(keys), "key", "left_semi").select("doc_id", "text_hash", "key", "term", "position", *_around(reach))

    def posting(i: Column) -> Column:
        low = F.greatest(i - reach, F.lit(0))
        before, after = F.slice("words", low + 1, i - low), F.slice("words", i + 2, F.lit(reach))
        return F.struct(i.alias("position"), F.get("words", i).alias("term"), F.reverse(before).alias("before"), after.alias("after"))

    # made inside the generator: a projection above it would be put off until after the join, and the whole text shuffled
    places = F.when(F.size("words") > 0, F.transform(F.sequence(F.lit(0), F.size("words") - 1), posting))
    at = words.select("doc_id", "text_hash", F.explode(places).alias("x")).select("doc_id", "text_hash", F.xxhash64("x.term").alias("key"), "x.term", "x.position", "x.before", "x.after")
    return at.join(keys, "key", "left_semi")


def proximity_anchors(words: DataFrame, benchmark: DataFrame, min_terms: int, window: int = WINDOW) -> DataFrame:
    """(key, item_term, item_id, item_words, need): the terms by which a window of an item is looked up.

    ``need`` of the d distinct terms of a window must occur, so at most d - need are missing and one
    of any d - need + 1 is there; the rarest are taken. Terms in no document count, but are not looked up.
    """
    terms = cut(item_terms(benchmark))
    rated = terms.join(term_frequencies(words, terms), "key", "left").withColumn("rated", F.struct(F.coalesce("frequency", F.lit(0)).alias("f"), "term"))
    ahead = Window.partitionBy("item_id", "copy").orderBy("position").rowsBetween(0, window - 1)
    whole = F.col("position") <= F.greatest(F.col("n") - window, F.lit(0))
    windows = rated.withColumn("rated", F.collect_set("rated").over(ahead)).where(whole).select("item_id", F.array_sort("rated").alias("rated"))
    sized = windows.withColumn("need", F.least(F.lit(min_terms), F.size("rated"))).withColumn("item_words", F.array_sort(F.transform("rated", lambda r: r["term"])))
    chosen = sized.select("item_id", "item_words", "need", F.explode(F.slice("rated", F.lit(1), F.size("rated") - F.col("need") + 1)).alias("a")).where("a.f > 0")
    return cut(chosen.select(F.xxhash64("a.term").alias("key"), F.col("a.term").alias("item_term"), "item_id", "item_words", "need").distinct())


def proximity_matches(words: DataFrame, benchmark: DataFrame, min_terms: int = 8) -> DataFrame:
    """(doc_id, text_hash, item_id, position, shared): of ``document_words``, texts that have ``min_terms`` or more of the
    distinct words of a window of an item, in any order, within STRETCH consecutive words.

    One row a text and item: the most words any window shares with any stretch, and where the first
    such stretch begins. A window of fewer distinct words needs all of them. The terms that windows
    are looked up by depend on the corpus, the result does not. Texts and items without words match
    nothing; items without id are one item. Equal texts of one id are one row, of different ids a row each.
    """
    wanted = proximity_anchors(words, benchmark, min_terms)
    index = postings(words, wanted, STRETCH - 1)
    if wanted.count() > MAX_BROADCAST_ANCHORS:
        index = cut(index)
    wanted = _small(wanted, MAX_BROADCAST_ANCHORS)
    met = index.join(wanted.alias("w"), (index["key"] == F.col("w.key")) & (F.col("term") == F.col("item_term")))
    around = F.concat(F.reverse("before"), F.array("term"), "after")
    near = met.where(F.size(F.array_intersect("item_words", around)) >= F.col("need"))
    # every stretch that has this posting, by its start
    stretch = lambda i: F.struct(F.size(F.array_intersect("item_words", F.slice(around, i + 1, F.lit(STRETCH)))).alias("shared"), (F.size("before") - F.col("position") - i).alias("back"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("before")), stretch))
    found = near.select("doc_id", "text_hash", "item_id", "need", best.alias("best")).where(F.col("best.shared") >= F.col("need"))
    most = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best"))
    return most.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("position"), F.col("best.shared").alias("shared"))


def proximity(documents: DataFrame, benchmark: DataFrame, min_terms: int = 8) -> DataFrame:
    """(doc_id, text_hash, shared, items) for every row of ``documents``: ``proximity_matches`` by text.

    ``shared`` is the most words shared with any item, 0 without a match. Nulls, repeated rows and
    items without id are treated as in ``contamination``.
    """
    words = document_words(documents)
    hit = proximity_matches(words, benchmark, min_terms)
    found = hit.groupBy("doc_id", "text_hash").agg(F.max("shared").alias("shared"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    joined = words.select("doc_id", "text_hash").alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_hash = f.text_hash"), "left")
    return joined.select("d.doc_id", "d.text_hash", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) for every row of ``documents``.

    ``n_hit`` counts the words inside any match, ``items`` are the matched item ids as sorted
    strings. Null and empty texts have no words and no hits; null or empty items match nothing; an
    item without id counts for hits but is no entry of ``items``. Repeated rows get equal results;
    rows that share an id but not a text get their own. Other columns are ignored.
    """
    words = document_words(documents)
    hit = matches(words, benchmark)
    spans = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    places = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    found = spans.select("doc_id", "text_hash", places.alias("n_hit"), "items")
    counted = words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    joined = counted.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_hash = f.text_hash"), "left")
    return joined.select("d.doc_id", "d.text_hash", "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``documents`` without any match, all columns as they were, whatever their names."""
    id_, hash_, text_hash = unused(documents, "__id", "__hash", "__text_hash")
    hit = matches(document_words(documents), benchmark).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    marked = documents.withColumn(text_hash, F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    met = (F.col("doc_id").eqNullSafe(F.col(id_))) & (F.col(text_hash) == F.col(hash_))
    return marked.join(hit, met, "left_anti").drop(text_hash)
