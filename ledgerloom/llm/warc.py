"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, and verified when read: bytes that no longer match
their address are an error. The exact header block of every record is stored apart. A join on the
address reconstructs the original records, byte for byte, and ``write_warc`` writes them as WARC files.
Of equal payloads the record with the smallest page_id is the response and the others are revisits that
name it.

The payloads are dealt by their address once: copies are removed in the tasks that read them and again
where equal addresses meet, so a payload that a third of all pages have is no more than a row a task.
They are stored in buckets of the address, so the join that reconstructs the records deals only headers.
``read_warc`` and ``read_pages`` parse the files as streams; what a task holds is one compressed file, of
at most ``FILE_RECORDS`` records, and a few records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir, shuffle_partitions, spread

_EOL = "\r\n"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
RECORD_DATE = "2024-01-01T00:00:00Z"
#: Most records of a file, and the bytes of payloads that a file and a bucket of payloads shall have about.
FILE_RECORDS, FILE_BYTES, BUCKET_BYTES = 100_000, 256 << 20, 128 << 20
#: Spark's own limit of buckets.
MAX_BUCKETS = 100_000
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Archive:
    """Folders of a written archive, and the name under which the session knows the payloads as a bucketed table."""

    headers: str
    payloads: str
    table: str | None = None


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *_BASE32)


def _record_id(page_id: Column) -> Column:
    """A URN that holds the page_id: a UUID of the free form (version 8); its last group tells a null from a zero."""
    h = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0)).cast("long")), 16, "0"))
    part = lambda at, n: F.substring(h, at, n)
    tail = F.when(page_id.isNull(), "f" * 12).otherwise("0" * 12)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), F.lit("00-"), tail, F.lit(">"))


def page_of(record_id: str | None) -> int | None:
    """The page_id of a record's URN."""
    if record_id is None:
        return None
    a, b, c, d, e = record_id.removeprefix("<urn:uuid:").removesuffix(">").split("-")
    n = int(a + b + c[1:] + d[1], 16)
    return None if e != "0" * 12 else n - (1 << 64) if n >> 63 else n


def _header_block(record_type: Column, refers_to: Column) -> Column:
    """The WARC header and the HTTP header of a record, up to its payload; a revisit has no payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL * 2))
    length = F.octet_length(http) + F.when(record_type == "response", F.col("payload_bytes")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {RECORD_DATE}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(record_type == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(record_type == "revisit", F.concat(F.lit("WARC-Refers-To: "), _record_id(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL * 2), http)


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> Archive:
    """Archives (page_id, url, html); a null html is an empty payload.

    Payloads of fewer than ``min_bytes`` are all responses. A null page_id ranks after all ids and
    has no record to name in its revisits. Repeated rows are records of their own; of equal rows
    with the smallest id, all are responses, stored once. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    keyed = cut(keyed)
    first = spread(keyed.groupBy("address").agg(F.min("page_id").alias("first_id")))
    joined = keyed.join(first, "address")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") != F.col("first_id")) | ((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNull() & F.col("first_id").isNotNull())
    typed = joined.withColumn("record_type", F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response"))
    typed = typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id")))
    headers = typed.select("page_id", "address", "payload_bytes", "payload_digest", "record_type", "refers_to", _header_block(F.col("record_type"), F.col("refers_to")).alias("header"))
    headers.write.parquet(f"{folder}/headers")
    # equal addresses have equal bytes, so any row of an address will do
    table = f"warc_payloads_{uuid.uuid4().hex}"
    kept = rows.select(F.sha2("payload", 256).alias("address"), "payload").dropDuplicates(["address"])
    stored = keyed.groupBy("address").agg(F.first("payload_bytes").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = min(MAX_BUCKETS, max(shuffle_partitions(spark), -(-stored // BUCKET_BYTES)))
    kept.write.bucketBy(buckets, "address").format("parquet").option("compression", "zstd").option("path", f"{folder}/payloads").saveAsTable(table)
    return Archive(f"{folder}/headers", f"{folder}/payloads", table)


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.parquet(archive.headers)


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """(address, payload), each verified against its address."""
    known = archive.table is not None and spark.catalog.tableExists(archive.table)
    rows = spark.table(archive.table) if known else spark.read.parquet(archive.payloads)
    good = F.sha2("payload", 256) == F.col("address")
    return rows.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("address")))))


def warc_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record_type, refers_to, header, payload): the records, reconstructed by a join.

    The record is the header block, the payload and two line ends. A revisit has no payload.
    """
    headers = read_headers(spark, archive).select("page_id", "address", "record_type", "refers_to", "header")
    full = headers.where("record_type = 'response'").join(read_payloads(spark, archive), "address").drop("address")
    return full.unionByName(headers.where("record_type = 'revisit'").drop("address").withColumn("payload", F.lit(b"")))


def write_warc(spark: SparkSession, archive: Archive, folder: str, compression: str = "gzip") -> None:
    """Writes the records as WARC files; a record and the blank lines after it are one line of Spark's text sink.

    Payloads are UTF-8, as they came from strings. An empty archive gives a folder without records.
    Pages of equal payloads have a record each, and their order in the files is not defined.
    """
    records = warc_records(spark, archive).select(F.concat("header", F.decode("payload", "UTF-8")).alias("value"))
    per_file = records_per_file(read_headers(spark, archive))
    records.write.option("lineSep", _EOL * 2).option("compression", compression).option("maxRecordsPerFile", per_file).text(folder)


def records_per_file(headers: DataFrame) -> int:
    """How many records make up ``FILE_BYTES``, at the mean size of a record's payload and header."""
    size = F.octet_length("header") + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    row = headers.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return max(1, min(FILE_RECORDS, FILE_BYTES * row["n"] // max(1, row["size"])))


def forget(spark: SparkSession, archive: Archive) -> None:
    """Drops the session's name of the payloads; the files stay."""
    if archive.table is not None:
        spark.sql(f"DROP TABLE IF EXISTS {archive.table}")


def _chunks(content: bytes) -> Iterator[bytes]:
    """The content in pieces, decompressed if it is gzip, of one member or several."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[at : at + _CHUNK] for at in range(0, len(content), _CHUNK))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(content):
        piece = content[at : at + _CHUNK]
        while piece:
            yield member.decompress(piece, 4 * _CHUNK)
            if member.eof:
                piece, member = member.unused_data, zlib.decompressobj(31)
            else:
                piece = member.unconsumed_tail
        at += _CHUNK


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC fields, HTTP header, payload) of each record; a file that ends within a record is an error."""
    held, at = b"", 0

    def more() -> None:
        nonlocal held, at
        chunk = next(chunks, None)
        if chunk is None:
            raise ValueError("truncated WARC record")
        held, at = held[at:] + chunk, 0

    while True:
        try:
            while len(held) == at:
                more()
        except ValueError:
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            more()
        fields = dict(line.split(": ", 1) for line in held[at:end].decode().split(_EOL)[1:])
        head, n = end + 4 - at, int(fields["Content-Length"])
        while len(held) - at < head + n + 4:
            more()
        block = held[at + head : at + head + n]
        if held[at + head + n : at + head + n + 4] != b"\r\n\r\n":
            raise ValueError("WARC record of another length than said")
        at += head + n + 4
        http = block.index(b"\r\n\r\n") + 4
        yield fields, block[:http], block[http:]


def _parsed(spark: SparkSession, folder: str, row: Callable[[dict, bytes, bytes], tuple], names: list[str], schema: str) -> DataFrame:
    """A row for each record of the files in a folder, a file in one task."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for fields, http, payload in _parse(_chunks(content)):
                    rows.append(row(fields, http, payload))
                    size += len(payload)
                    if len(rows) >= 4096 or size >= 8 * _CHUNK:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    source = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return source.select("content").mapInPandas(files, schema)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, url, refers_to, payload_digest, payload) of the records of WARC files.

    ``url`` and ``refers_to`` are null for a record without that field; an empty payload is empty, not null. Repeated
    records are all returned. No records give no rows; a cut file, or a record of another length than it says, is an error.
    """

    def row(fields: dict, http: bytes, payload: bytes) -> tuple:
        return fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload

    names = ["record_id", "record_type", "url", "refers_to", "payload_digest", "payload"]
    return _parsed(spark, folder, row, names, "record_id string, record_type string, url string, refers_to string, payload_digest string, payload binary")


def _page_row(fields: dict, http: bytes, payload: bytes) -> tuple:
    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
    if kind == "response" and (length != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said):
        raise ValueError(f"header and payload of {fields['WARC-Record-ID']} disagree")
    refers_to = page_of(fields.get("WARC-Refers-To"))
    return page_of(fields["WARC-Record-ID"]), length, said, kind, refers_to


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of WARC files.

    All of it is parsed from the records. A response's payload must have the length and digest that its
    headers say; a revisit has what they say of the payload it stands for.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = _parsed(spark, folder, lambda *x: tuple(map(str_or_none, _page_row(*x))), names, ", ".join(f"{n} string" for n in names))
    return rows.select(*(F.col(n).cast("long").alias(n) if n in ("page_id", "payload_bytes", "refers_to") else n for n in names))


def str_or_none(x: object) -> str | None:
    """Numbers go through Arrow as text, since a pandas column of long numbers cannot hold nulls."""
    return None if x is None else str(x)
