"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bottomk import edited_neighbours, hex_string
from .bpe import describe_documents
from .chat import format_conversations, read_back
from .decontam import contamination, proximity
from .merkle import manifest, proof
from .mixing import copies
from .pii import personal_data, spans_text
from .quality import quality_scores
from .shared import shared_dir, table
from .simhash import fingerprint_hex, near_duplicates
from .toxicity import toxicity_scores
from .url_lists import filter_captures, host_of
from .warc import forget, read_pages, write_archive, write_warc
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _number(text, start: int = 1):
    """A number from 0 to 65535 that follows from a text, the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 4), 16, 10).cast("int")


def _day(n):
    return F.timestamp_add("DAY", n, F.lit("2024-01-01").cast("timestamp_ntz"))


def dated_entries(hosts: DataFrame) -> DataFrame:
    """A list log made from host names: hosts blocked and removed again, domains blocked, mirrors allowed."""
    n, day = _number(F.col("host")), _number(F.col("host"), 5) % 240
    domain = F.regexp_replace("host", "^[^.]*[.]", "")
    entry = lambda list_name, kind, value, action, at, when: F.when(when, F.struct(F.lit(list_name).alias("list_name"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), at.alias("listed_at")))
    entries = F.array(
        entry("hosts", "host", F.col("host"), "block", _day(day), n % 3 == 0),
        entry("hosts", "host", F.col("host"), "remove", _day(day + 60), n % 3 == 0),
        entry("domains", "domain", domain, "block", _day(day), (n % 4 == 1) & (F.size(F.split("host", "[.]")) > 3)),
        entry("mirrors", "host", F.col("host"), "allow", _day(day + 30), n % 5 == 2),
    )
    return hosts.select(F.explode(entries).alias("e")).where("e IS NOT NULL").select("e.*")


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(_number(F.col("page_id").cast("string")) % 365))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    return filter_captures(captures, dated_entries(hosts))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive = write_archive(table(spark, sf_dir, "pages"), folder)
    try:
        write_warc(spark, archive, f"{folder}/files")
    finally:
        forget(spark, archive)
    return read_pages(spark, f"{folder}/files")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_neighbours(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        hex_string(F.col("sketch")).alias("fingerprint"),
        hex_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return rows.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t"))
    rows = rows.unionByName(extra.select("conv_id", "t.turn", "t.role", "t.text"))
    read = read_back(format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "shared", F.size("items").cast("long").alias("n_items"), items, (F.col("shared") > 0).alias("near"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.replace("text", F.lit("\n"), F.lit(""))
    found = manifest(table(spark, sf_dir, "documents"), tampered, F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    proof_sha = F.sha2(proof(F.col("lefts"), F.col("rights")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof_sha, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_url_lists": op2_url_lists,
        "op3_warc": op3_warc,
        "op4_quality": op4_quality,
        "op5_bottomk": op5_bottomk,
        "op6_mixing": op6_mixing,
        "op7_pii": op7_pii,
        "op8_simhash": op8_simhash,
        "op9_chat": op9_chat,
        "op10_decontamination": op10_decontamination,
        "op10_proximity": op10_proximity,
        "op11_bpe": op11_bpe,
        "op12_whitening": op12_whitening,
        "op13_merkle": op13_merkle,
    }


_OP2 = r"""
WITH captures AS (
    SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS INTEGER) % 365 AS INTEGER)) AS fetched_at,
        nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host
    FROM pages
), hosts AS (
    SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n, CAST('0x' || substr(md5(host), 5, 4) AS INTEGER) % 240 AS day,
        regexp_replace(host, '^[^.]*[.]', '') AS domain, len(string_split(host, '.')) AS labels
    FROM captures WHERE host IS NOT NULL
), entries AS (
    SELECT 'hosts' AS list_name, 'host' AS kind, host AS value, 'block' AS action, day FROM hosts WHERE n % 3 = 0
    UNION ALL SELECT 'hosts', 'host', host, 'remove', day + 60 FROM hosts WHERE n % 3 = 0
    UNION ALL SELECT 'domains', 'domain', domain, 'block', day FROM hosts WHERE n % 4 = 1 AND labels > 3
    UNION ALL SELECT 'mirrors', 'host', host, 'allow', day + 30 FROM hosts WHERE n % 5 = 2
), one AS (
    SELECT list_name, kind, value, day, max_by(action, CASE action WHEN 'remove' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS action FROM entries GROUP BY ALL
), held AS (
    SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS valid_from,
        TIMESTAMP '2024-01-01' + to_days(CAST(lead(day) OVER (PARTITION BY list_name, kind, value ORDER BY day) AS INTEGER)) AS valid_to
    FROM one
), met AS (
    SELECT c.page_id, c.url, c.fetched_at, c.host, h.list_name, h.kind, h.value, h.valid_from, h.action,
        CASE WHEN h.kind = 'host' THEN 1000 ELSE len(string_split(h.value, '.')) END AS s
    FROM captures c LEFT JOIN held h ON h.action <> 'remove' AND c.fetched_at >= h.valid_from AND (h.valid_to IS NULL OR c.fetched_at < h.valid_to)
        AND (h.kind = 'host' AND h.value = c.host OR h.kind = 'domain' AND (c.host = h.value OR suffix(c.host, '.' || h.value)))
)
SELECT page_id, url, fetched_at, host, n_active, CASE WHEN action = 'block' THEN 'block' ELSE 'allow' END AS decision, list_name, kind, value, valid_from
FROM (
    SELECT *, count(action) OVER (PARTITION BY page_id) AS n_active,
        row_number() OVER (PARTITION BY page_id ORDER BY s DESC NULLS LAST, CASE WHEN action = 'block' THEN 1 ELSE 0 END DESC, valid_from DESC, list_name DESC) AS r
    FROM met
) WHERE r = 1
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(floor(CAST('0x' || substr(digest, {at}, 5) AS INTEGER) / {power}) AS INTEGER) % 32 + 1, 1)"
_BASE32 = " || ".join(_DIGIT.format(at=5 * i + 1, power=32**j) for i in range(8) for j in (3, 2, 1, 0))
_OP3 = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_OP9 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
        coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length(text)) + sum(CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 29 + length(role) END) AS chars,
        bool_or(regexp_matches(text, '</?s>|\[/?INST\]|</?<?/?SYS>>')) AS clash,
        sum(len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[ESC\]|<</?SYS>>')) + len(regexp_extract_all(text, '\\'))) AS codes
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(chars + CASE WHEN clash THEN 5 + codes ELSE 0 END AS BIGINT) AS formatted_chars
FROM c
"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT grams.doc_id, grams.i, grams.n, win.item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_prepend(CAST(ord(c) AS UBIGINT), list_transform(range(8), lambda i: CAST(1000 AS UBIGINT)))))),
    lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, CAST(3988292384 AS UBIGINT)) ELSE crc >> 1 END))"""


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a forest: name_s (tree, pos, n, node and its siblings) for each level, for (tree, pos, node) of ``leaves``."""
    out = [f"{name}_0 AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(levels):
        run = "PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
        out += [
            f"{name}_s{k} AS (SELECT *, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k})",
            f"{name}_{k + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node, (max(n) + 2) // 3 AS n FROM {name}_{k} GROUP BY tree, pos // 3)",
        ]
    return ", ".join(out)


def _fold_sql(name: str, rows: str, levels: int) -> str:
    """CTEs that carry ``proof`` and ``folded`` of (tree, pos) rows up the levels; the last is name_up."""
    out, at = [], rows
    for k in range(levels):
        to = f"{name}_up" if k == levels - 1 else f"{name}_u{k}"
        out.append(f"{to} AS (SELECT u.* REPLACE (proof || l || r AS proof, CASE WHEN s.n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded) FROM {at} u JOIN {name}_s{k} s ON s.tree = u.tree AND s.pos = u.pos // {3**k})")
        at = to
    return ", ".join(out)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


#: Enough for 3 ** 12 documents of one source and 3 ** 6 sources.
_LEVELS, _SOURCE_LEVELS = 12, 6
_FIELDS = " || ".join(_field_sql(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_OP13 = f"""
WITH base AS (
    SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({_FIELDS} || {_field_sql("text")}) AS leaf,
        CASE WHEN {_CRC32} % 2 = 0 THEN sha256({_FIELDS} || {_field_sql("replace(text, chr(10), '')")}) END AS other
    FROM documents
), placed AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
{_tree_sql("t", "placed", _LEVELS)},
started AS (SELECT doc_id, leaf, tree, pos, '' AS proof, coalesce(other, leaf) AS folded FROM placed),
{_fold_sql("t", "started", _LEVELS)},
sources AS (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM t_{_LEVELS}),
{_tree_sql("s", "sources", _SOURCE_LEVELS)},
met AS (SELECT u.doc_id, u.leaf, u.proof, u.folded, '' AS tree, o.pos, o.node AS subroot FROM t_up u JOIN sources o ON o.name = u.tree),
{_fold_sql("s", "met", _SOURCE_LEVELS)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM s_up, s_{_SOURCE_LEVELS}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_lists": _OP2,
        "op3_warc": _OP3,
        "op9_chat": _OP9,
        "op10_decontamination": _OP10,
        "op13_merkle": _OP13,
    }
