"""WARC archives: pages to records with revisits and segments, and back: segments put together, chunks decoded, digests checked.

A record whose block is longer than a segment goes on in continuation records. Reading groups those by the record they continue, orders
them by number, checks the total length, and takes the transfer framing off. What doesn't fit is told in `problem`, not dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored, table, tidied

SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
FILE_BYTES = 64 << 20  # of records in a file, about: a file is read by one task
BROADCAST_BYTES = 16 << 20  # of repeated digests, with the first page's id and address, up to which they are broadcast
LEAST_BYTES = 0  # of payloads that are told by revisits
DATE = "2000-01-01T00:00:00Z"  # pages have no date; the format wants one
END, BASE32 = "\r\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# -- writing -----------------------------------------------------------------------------------


def base32(hexadecimal: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits."""
    out = []
    for i in range(4):
        five = F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 10).cast("long")
        out += [F.substr(F.lit(BASE32), (F.shiftright(five, bits).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for bits in range(35, -1, -5)]
    return F.concat(*out)


def _urn(*parts: Column) -> Column:
    """A record's name, from what tells it from others."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _pieces(data: Column, size: int) -> Column:
    """Bytes (as a string that may end inside a character) cut into pieces of `size`; none of the empty one."""
    raw = data.cast("binary")
    starts = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(raw, at, F.lit(size)).cast("string"))


def _chunked(data: Column, size: int) -> Column:
    piece = lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(END), p, F.lit(END))
    return F.concat(F.array_join(F.transform(_pieces(data, size), piece), ""), F.lit(f"0{END}{END}"))


def _header(name: str, value: Column) -> Column:
    """A header line; the empty text where there is no value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def described(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, payload as a string of bytes) with record_id, digest, refers_to and original, the last two of revisits only.

    Of equal payloads of `least` bytes or more the row with the smallest page_id is the response (no page_id comes last; of rows with one
    page_id that with the smallest url, no url first; of rows that are the same any one). Only digests and copies of whole rows are
    shuffled, as long as few digests are repeated; those are sent to the pages.
    """
    key = ["sha", "page_id", "url"]
    named = pages.withColumn("sha", F.sha2(F.col("payload").cast("binary"), 256))
    copies = named.where(F.octet_length("payload") >= least).groupBy(*key).agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "copies")).alias("first")
    repeated = copies.groupBy("sha").agg(first, F.sum("copies").alias("n")).where("n > 1").select("sha", "first.page_id", "first.url", "first.copies")
    repeated = stored(repeated.select("sha", *[F.col(c).alias(f"first_{c}") for c in ("page_id", "url", "copies")]), shared_dir(pages.sparkSession), "repeated")
    size = repeated.agg(F.sum(F.lit(200) + F.coalesce(F.octet_length("first_url"), F.lit(0)))).first()[0] or 0
    out = named.join(F.broadcast(repeated) if size <= BROADCAST_BYTES else repeated, "sha", "left")
    is_first = F.col("first_copies").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_page_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    out = out.withColumn("copy", F.when(is_first | F.col("first_copies").isNull(), F.lit(1)))
    if not repeated.where("first_copies > 1").isEmpty():
        same = out.where(is_first & (F.col("first_copies") > 1)).groupBy(*key, "first_page_id", "first_url", "first_copies").agg(F.max("payload").alias("payload"))
        same = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("first_copies").cast("int"))))
        out = out.where(~(is_first & (F.col("first_copies") > 1))).unionByName(same)
    again = F.coalesce(F.col("copy") > 1, F.lit(True))
    name = lambda page, url: _urn("sha", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")))
    own = F.when(again, _urn("sha", F.monotonically_increasing_id().cast("string"), F.lit("revisit"))).otherwise(name(F.col("page_id"), F.col("url")))
    return out.select(
        "page_id", "url", "payload", own.alias("record_id"), base32(F.sha1(F.col("payload").cast("binary"))).alias("digest"),
        F.when(again, name(F.col("first_page_id"), F.col("first_url"))).alias("refers_to"), F.when(again, F.col("first_page_id")).alias("original"),
    )


def records_of(pages: DataFrame, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, date: str = DATE) -> DataFrame:
    """A column `record` of whole WARC records of `described` pages, without the two line ends behind each."""
    revisit = F.col("refers_to").isNotNull()
    head = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    block = F.when(revisit, F.lit(head + END)).otherwise(F.concat(F.lit(f"{head}Transfer-Encoding: chunked{END}{END}"), _chunked(F.col("payload"), chunk)))
    rows = pages.withColumn("block", block).withColumn("length", F.octet_length("block"))
    rows = rows.select("*", F.posexplode(F.when(F.col("length") > segment, _pieces(F.col("block"), segment)).otherwise(F.array("block"))).alias("at", "piece"))
    parts, first = F.ceil(F.col("length") / segment), F.col("at") == 0
    many = F.col("length") > segment
    only_first = lambda c: F.when(first, c)
    headers = (
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(_urn(F.col("record_id"), F.col("at").cast("string")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        _header("WARC-Payload-Digest", only_first(F.concat(F.lit("sha1:"), F.col("digest")))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Segment-Number", F.when(many, F.col("at") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _header("WARC-Segment-Total-Length", F.when(many & (F.col("at") == parts - 1), F.col("length"))),
        _header("Page-ID", only_first(F.col("page_id"))),
        _header("Content-Type", only_first(F.lit("application/http; msgtype=response"))),
        _header("Content-Length", F.octet_length("piece")),
    )
    return rows.select(F.concat(*headers, F.lit(END), F.col("piece")).alias("record"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, least: int = LEAST_BYTES) -> None:
    """Writes pages (page_id, url, payload) as gzipped WARC files to a folder: records with two line ends behind each.

    A null payload is the empty one; null ids and addresses have no header. Characters that would end a header become %20.
    """
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    mean = plain.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    each = max(1, int(FILE_BYTES // (mean + 1024)))
    out = records_of(described(plain, least), segment, chunk)
    out.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", each).mode("overwrite").text(path)


# -- reading -----------------------------------------------------------------------------------

RECORD = "record_id string, type string, uri string, digest string, refers_to string, number int, origin string, total long, page_id long, block binary, cut boolean"
_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("number", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("page_id", pa.int64()), ("block", pa.binary()), ("cut", pa.bool_())])
_NUMBER = re.compile(r"-?\d+\Z")


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """The bytes of a file, a part at a time; gzip files may have any number of members."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + (1 << 20)]) for i in range(0, len(data), 1 << 20))
        return
    at, left = 0, b""
    while at < len(data) or left:
        unpack = zlib.decompressobj(47)
        while not unpack.eof and (left or at < len(data)):
            part, at, left = left or bytes(data[at : at + (1 << 18)]), at if left else at + (1 << 18), b""
            yield unpack.decompress(part)
        left = unpack.unused_data


def parsed(data: memoryview) -> Iterator[dict]:
    """The records of a file; one that is cut off at the file's end has what is there of its block."""
    parts, held = _unpacked(data), bytearray()

    def upto(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while upto(2) and held[:2] == b"\r\n":
            del held[:2]
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not upto(seen + 1):
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        number = lambda name, f=fields: int(f[name]) if _NUMBER.match(f.get(name, "")) else None
        size = max(0, number("content-length") or 0)
        there = upto(end + 4 + size)
        yield {
            "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "refers_to": fields.get("warc-refers-to"), "number": number("warc-segment-number"), "origin": fields.get("warc-segment-origin-id"), "total": number("warc-segment-total-length"),
            "page_id": number("page-id"), "block": bytes(held[end + 4 : end + 4 + size]), "cut": not there,
        }
        del held[: end + 4 + size]


def records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """The records (RECORD) of all files in a folder; only those with a segment number, or only those without, if `segmented` is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for record in parsed(memoryview(content.as_buffer())):
                    if segmented is None or segmented == (record["number"] is not None):
                        out.append(record)
                        size += len(record["block"]) + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, _RECORD)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _RECORD)

    return small_batches(spark.read.format("binaryFile").load(path).select("content")).mapInArrow(tidied(run), RECORD)


def reassembled(spark: SparkSession, path: str) -> DataFrame:
    """RECORD's columns but number, origin, total and block, with blocks (array in order), numbers, total and cut: a row for each whole record.

    Only records with a segment number are shuffled, by the record that they continue.
    """
    facts = ["record_id", "type", "uri", "digest", "refers_to", "page_id"]
    alone = records(spark, path, False).select(*facts, F.array("block").alias("blocks"), F.lit(None).cast("array<int>").alias("numbers"), "total", "cut")
    parts = records(spark, path, True)
    first = lambda c: F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c)
    whole = parts.groupBy(F.coalesce("origin", "record_id").alias("_origin")).agg(*[first(c) for c in facts], F.sort_array(F.collect_list(F.struct("number", "block"))).alias("_parts"), F.max("total").alias("total"), F.max("cut").alias("cut"))
    record_id = F.coalesce("record_id", "_origin").alias("record_id")
    return alone.unionByName(whole.select(record_id, *facts[1:], F.col("_parts.block").alias("blocks"), F.col("_parts.number").alias("numbers"), "total", "cut"))


def unchunked(data: bytes) -> bytes | None:
    """The payload inside chunked transfer framing (extensions and trailers are passed over); None if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(data[at : at + n])
        at += n + 2


def body(block: bytes) -> bytes | None:
    """What an HTTP response carries, without transfer framing."""
    head, gap, data = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return unchunked(data) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\s*$", head.replace(b"\r\n", b"\n")) else data


PAYLOAD = "record_id string, type string, uri string, digest string, refers_to string, page_id long, payload_bytes long, problem string"


def payloads(whole: DataFrame, with_payload: bool = True) -> DataFrame:
    """PAYLOAD of `reassembled` records, and the payload if asked for. problem: what is wrong with a record, else null.

    The digest of a response is that of its payload; a revisit has the one it states, and no payload.
    """

    def judged(row: dict) -> dict:
        out = {k: row[k] for k in ("record_id", "type", "uri", "digest", "refers_to", "page_id")} | {"payload_bytes": None, "problem": None, "payload": None}
        numbers, block = row["numbers"], b"".join(row["blocks"])
        if numbers is not None and (numbers != list(range(1, len(numbers) + 1)) or row["total"] is None):
            return out | {"problem": "segments missing"}
        if numbers is not None and row["total"] != len(block):
            return out | {"problem": "total length differs"}
        if row["cut"]:
            return out | {"problem": "cut off"}
        if row["type"] != "response":
            return out
        found = body(block)
        if found is None:
            return out | {"problem": "broken transfer framing"}
        digest = base64.b32encode(hashlib.sha1(found).digest()).decode()
        said = out["digest"]
        return out | {"digest": digest, "payload_bytes": len(found), "payload": found, "problem": "digest differs" if said and said != digest else None}

    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for n in [x.split()[0] for x in PAYLOAD.split(", ")]] + ([("payload", pa.binary())] if with_payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(row) for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

    return small_batches(whole).mapInArrow(tidied(run), PAYLOAD + (", payload binary" if with_payload else ""))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of all responses and revisits of a folder of archives.

    A revisit takes the size of the response that it refers to; it has a problem if that isn't there or has another digest. Segments
    whose first one is nowhere come out too, as records of no type.
    """
    told = stored(payloads(reassembled(spark, path), False), shared_dir(spark), "told")
    responses, revisits, lone = told.where("type = 'response'"), told.where("type = 'revisit'"), told.where("type is null")
    of = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    lost = F.when(F.col("_digest").isNull(), F.lit("refers to no response")).when(F.col("_digest") != F.col("digest"), F.lit("digest differs"))
    again = revisits.join(of, "refers_to", "left").select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("_page").alias("refers_to"), F.coalesce("problem", lost).alias("problem"))
    whole = responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    stray = lone.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return whole.unionByName(again).unionByName(stray)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all `pages`, written as archives and read back.

    A null html is the empty payload; empty payloads are equal too. Repeated rows are records of their own, all but one of them revisits.
    Rows without page_id never are a response where another row has one; an empty table gives no rows. Other columns are not read. A
    record that doesn't come back whole is an error.
    """
    path = f"{shared_dir(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload")), path)
    found = catalogue(spark, path)
    return found.select("page_id", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
