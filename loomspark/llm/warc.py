"""Web archives: pages written as WARC records in segments, and archives read back whole.

Writing: a page's HTML becomes an HTTP message with chunked transfer framing, in a record of type response; of pages
with equal payloads only the one with the smallest key is written as response, the others as revisit records that
refer to it. A block longer than ``segment`` bytes is cut: the first part stays in the response record, continuation
records carry the others with the origin's identifier, their number and, in the last, the total length. Spark's text
writer puts the records of a partition into gzipped archives (records end in CR LF CR LF, which is its line separator).

Reading: archives, gzipped or not, are read as binary files. Records of one segment are complete; the segments of others are grouped
by origin identifier, ordered by number and verified against the total length before the transfer framing is decoded
and the payload's digest is checked.

A group of equal payloads is found by its digest and length with partial aggregation, so a payload that a third of all
pages share costs one row per task; its pages are then joined to one row.

Defined results: a null HTML is an empty payload; rows with a null key are responses of their own and keep the null;
repeated rows of the smallest key are all responses; an empty table gives an empty result; other columns are ignored.
Segments that are missing, doubled or of another total length raise an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.text import in_arrow, shared_folder

SEGMENT = 1 << 14
CHUNK = 4096
END = "\r\n\r\n"
#: Rows of an archive: with ``SEGMENT`` a bound of its size.
RECORDS = 4_000

_RECORD = "key string, type string, refers string, digest string, size long, origin string, number int, total long, block binary"


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def cut(data: bytes, size: int) -> list[bytes]:
    """Parts of ``size`` bytes or up to three more, so that each ends with a whole character: archives are written as text."""
    parts, at = [], 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        parts.append(data[at:end])
        at = end
    return parts


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in cut(data, size)) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The content of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk of another length than announced")
        at = end + 4 + size


def _identifier(key: str | None, number: int) -> str:
    name = f"page:{'' if key is None else key}:{number}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": "2024-01-01T00:00:00Z"} | fields | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def records(key: str | None, row: str, url: str, html: str, first: str | None, first_url: str, revisit: bool, segment: int) -> Iterator[bytes]:
    """The records of one page; ``row`` tells repeated rows apart."""
    payload = html.encode()
    own = {"WARC-Record-ID": _identifier(row, 1), "WARC-Target-URI": url.replace("\r", "").replace("\n", ""), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Payload-Length": str(len(payload)), "X-Page": "" if key is None else key}
    if revisit:
        yield _record("revisit", own | {"WARC-Refers-To-Target-URI": first_url.replace("\r", "").replace("\n", ""), "X-Refers-To-Page": str(first), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b"")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = cut(block, segment)
    for i, part in enumerate(parts, 1):
        number = {"WARC-Segment-Number": str(i)} if len(parts) > 1 else {}
        if i == len(parts) and i > 1:
            number["WARC-Segment-Total-Length"] = str(len(block))
        if i == 1:
            yield _record("response", own | number, part)
        else:
            yield _record("continuation", {"WARC-Record-ID": _identifier(row, i), "WARC-Segment-Origin-ID": own["WARC-Record-ID"]} | number, part)


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, least: int = 0) -> None:
    """Write ``pages`` to archives under ``path``. Payloads below ``least`` bytes are always responses."""
    body = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(key).alias("k"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), body.alias("h")).withColumns({"d": F.sha1(F.encode("h", "utf-8")), "n": F.octet_length("h")})
    groups = base.filter(F.col("k").isNotNull() & (F.col("n") >= least)).groupBy("d", "n").agg(F.min(F.struct("k", "u")).alias("first"), F.count("*").alias("m"))
    joined = base.join(groups.filter("m > 1").select("d", "n", F.col("first.k").alias("first"), F.col("first.u").alias("first_url")), ["d", "n"], "left")
    rows = joined.select(F.col("k").cast("string"), F.monotonically_increasing_id().cast("string").alias("row"), "u", "h", F.col("first").cast("string").alias("first"), "first_url", F.coalesce(F.col("k") != F.col("first"), F.lit(False)).alias("revisit"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [x.decode() for x in records(r["k"], f"{r['k']}:{r['row']}", r["u"], r["h"], r["first"], r["first_url"] or "", r["revisit"], segment)]
                if len(out) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    in_arrow(rows, encode, "value string").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, gzipped as a whole, record by record, or not at all."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        head = archive[at:end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) != size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("record of another length than announced")
        yield fields, block
        at = end + 8 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for f, block in parse(bytes(content)):
                    number = int(f.get("warc-segment-number", 1))
                    origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if "warc-segment-number" in f else None)
                    total = f.get("warc-segment-total-length")
                    rows.append((f.get("x-page") or None, f["warc-type"], f.get("x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:"), int(f.get("x-payload-length", 0)), origin, number, int(total) if total else None, block))
                    if len(rows) >= 500:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "type", "refers", "digest", "size", "origin", "number", "total", "block"], dtype=object)
    return out


def reassembled(found: DataFrame) -> DataFrame:
    """Records with whole blocks: segments grouped by origin, ordered by number, their total length verified."""
    groups = found.filter("origin IS NOT NULL").groupBy("origin").agg(
        F.min_by(F.struct("key", "type", "refers", "digest", "size"), "number").alias("f"),
        F.max_by("total", "number").alias("total"),
        F.expr("listagg(block, X'') WITHIN GROUP (ORDER BY number)").alias("block"),
        ((F.min("number") == 1) & (F.max("number") == F.count("*")) & (F.size(F.collect_set("number")) == F.count("*"))).alias("sound"),
    )
    checked = F.when(F.col("sound") & (F.octet_length("block") == F.col("total")), F.col("block")).otherwise(F.raise_error(F.lit("segments missing, doubled or of another total length")).cast("binary"))
    whole = groups.select("f.key", "f.type", "f.refers", "f.digest", "f.size", checked.alias("block"))
    return found.filter("origin IS NULL").select("key", "type", "refers", "digest", "size", "block").unionByName(whole)


def payloads(whole: DataFrame) -> DataFrame:
    """(key, type, refers, digest, size, payload): the transfer framing decoded; payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["type"] != "response":
                    r["payload"] = None
                else:
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    r["payload"] = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    own = digest(r["payload"])
                    if own != r["digest"]:
                        raise ValueError("payload of another digest than announced")
                    r["digest"], r["size"] = own, len(r["payload"])
                del r["block"]
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("payload", pa.binary())]))

    return in_arrow(whole, run, "key string, type string, refers string, digest string, size long, payload binary")


def round_trip(pages: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archives."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    write(pages, path, segment=segment)
    kind: T.DataType = pages.schema["page_id"].dataType
    read = payloads(reassembled(read_records(spark, path)))
    return read.select(F.col("key").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))


#: DuckDB SQL for ``round_trip``: base32 is five bits a letter, four letters for five hexadecimal digits.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS digest FROM p),
f AS (SELECT digest, n, min(page_id) AS first FROM d GROUP BY digest, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest, CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
FROM d JOIN f ON d.digest = f.digest AND d.n = f.n
"""
