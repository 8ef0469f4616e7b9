import base64
import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.llm import warc

PAGES = "page_id bigint, url string, html string"
ROWS = [
    (5, "http://a.b/1", "<p>é😀</p>"),
    (3, "http://a.b/2", "<p>é😀</p>"),
    (9, None, "<p>é😀</p>"),
    (7, "http://a.b/3\r\nX: y", None),
    (8, "http://a.b/4", ""),
    (1, "http://a.b/5", "line\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n"),
    (2, "http://a.b/6", "x" * 300_000),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def wanted(rows):
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    return {i: (len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows}


def read(spark, tmp_path, rows, **options):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, PAGES)
    archive = warc.write_archive(df, **options)
    folder = f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}"
    warc.write_warc(spark, archive, folder)
    warc.forget(spark, archive)
    return archive, folder, warc.read_pages(spark, folder)


def test_pages_read_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES).withColumn("payload", F.lit("x")).withColumn("address", F.lit(1))
    archive, _, pages = read(spark, tmp_path, df)
    assert {r[0]: tuple(r)[1:] for r in pages.collect()} == wanted(ROWS)
    assert warc.read_payloads(spark, archive).count() == len({h or "" for _, _, h in ROWS})


def test_records_are_reconstructed_byte_for_byte(spark, tmp_path):
    archive, folder, _ = read(spark, tmp_path, ROWS)
    records = {r["page_id"]: r for r in warc.warc_records(spark, archive).collect()}
    html = {i: (h or "").encode() for i, _, h in ROWS}
    for i, (_, said, kind, first) in wanted(ROWS).items():
        head, _, block = records[i]["header"].encode().partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        assert (fields["WARC-Type"], fields["WARC-Payload-Digest"]) == (kind, f"sha1:{said}")
        assert (warc.page_of(fields["WARC-Record-ID"]), warc.page_of(fields.get("WARC-Refers-To"))) == (i, first)
        payload = bytes(records[i]["payload"])
        assert int(fields["Content-Length"]) == len(block) + len(payload)
        assert payload == (html[i] if kind == "response" else b"")
    files = warc.read_warc(spark, folder).collect()
    assert sorted(r["payload_digest"] for r in files) == sorted(v[1] for v in wanted(ROWS).values())
    assert sorted(bytes(r["payload"]) for r in files if r["record_type"] == "response") == sorted(set(html.values()))


def test_payloads_are_dealt_once(spark):
    archive = warc.write_archive(spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('page ', id % 900), 200) AS html"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.warc_records(spark, archive)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan[plan.index("SortMergeJoin") :]
    assert joined.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in joined


def test_changed_bytes_are_an_error(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame(ROWS, PAGES))
    bad = f"file://{tmp_path}/payloads"
    spark.read.parquet(archive.payloads).withColumn("payload", F.when(F.octet_length("payload") > 9, F.encode(F.lit("tampered"), "UTF-8")).otherwise(F.col("payload"))).write.parquet(bad)
    with pytest.raises(PySparkException, match="does not match its digest"):
        warc.warc_records(spark, warc.Archive(archive.headers, bad)).collect()


@pytest.mark.parametrize("change", [(b"<p>", b"<q>"), (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:X"), (b"Content-Length: 13\r\n\r\n<p>", b"Content-Length: 12\r\n\r\n<p>")])
def test_a_corrupt_record_is_an_error(spark, tmp_path, change):
    archive = warc.write_archive(spark.createDataFrame(ROWS[:1], PAGES))
    warc.write_warc(spark, archive, f"file://{tmp_path}/a", compression="none")
    (tmp_path / "b").mkdir()
    for f in (tmp_path / "a").glob("part-*"):
        (tmp_path / "b" / f.name).write_bytes(f.read_bytes().replace(*change))
    with pytest.raises(PySparkException):
        warc.read_pages(spark, f"file://{tmp_path}/b").collect()


def test_parse_of_streams():
    record = b"WARC/1.1\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcde\r\n\r\n"
    whole = gzip.compress(record) + gzip.compress(record * 3)
    assert [p for _, _, p in warc._parse(warc._chunks(whole))] == [b"abcde"] * 4
    assert [p for _, _, p in warc._parse(iter([record[:9], record[9:30], record[30:] + record]))] == [b"abcde"] * 2
    assert list(warc._parse(iter([]))) == []
    with pytest.raises(ValueError, match="truncated"):
        list(warc._parse(iter([record[:-9]])))


@pytest.mark.parametrize("n", [0, 1, -1, (1 << 63) - 1, -(1 << 63)])
def test_ids_of_records(spark, n):
    assert warc.page_of(spark.range(1).select(warc._record_id(F.lit(n).cast("long")).alias("x")).first()["x"]) == n


def test_null_ids_repeats_small_and_empty(spark, tmp_path):
    rows = [(None, "u", "same"), (4, "u", "same"), (4, "u", "same"), (6, "u", "tiny")]
    got = sorted(map(tuple, read(spark, tmp_path, rows)[2].select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (6, "response", None)], key=str)
    all_kept = read(spark, tmp_path, rows, min_bytes=100)[2]
    assert {r["record_type"] for r in all_kept.collect()} == {"response"}
    only_null = read(spark, tmp_path, [(None, "u", "x"), (None, "u", "x")])[2]
    assert [r["record_type"] for r in only_null.collect()] == ["response", "response"]
    assert read(spark, tmp_path, [])[2].count() == 0


def test_files_and_buckets_are_sized_by_bytes(spark, tmp_path, monkeypatch):
    for name, value in (("FILE_BYTES", 40_000), ("BUCKET_BYTES", 50_000)):
        monkeypatch.setattr(warc, name, value)
    pages = spark.range(400).selectExpr("id AS page_id", "'http://x.y/' AS url", "repeat(CAST(id + 1000 AS STRING), 250) AS html")
    archive = warc.write_archive(pages, f"{tmp_path}/a")
    assert len(list((tmp_path / "a/payloads").glob("*.parquet"))) >= 400_000 // 50_000
    warc.write_warc(spark, archive, f"file://{tmp_path}/files", compression="none")
    warc.forget(spark, archive)
    sizes = [p.stat().st_size for p in (tmp_path / "files").glob("part-*")]
    assert max(sizes) < 2 * 40_000
    assert warc.read_pages(spark, f"file://{tmp_path}/files").count() == 400
