"""Web archives: writing with chunked framing, segments and revisits; reading back with reassembly."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, release, shared_dir

END = "\r\n"
#: Fixed value: the profile of revisits of equal payloads.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Types of records that hold a page; others, such as warcinfo, request and metadata, are not read unless asked for.
PAGES = ("response", "revisit", "resource")
RECORD = "record_id string, origin_id string, segment int, total long, record_type string, page_id long, refers_to long, target_uri string, declared_digest string, refers_to_id string, block binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]


def _text(x: Column) -> Column:
    """Bytes as a string of the same bytes, whether or not they end inside a character."""
    return x.cast("string")


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def _chunked(payload: Column, size: int) -> Column:
    n = F.octet_length(payload)
    last = F.ceil(n / size).cast("int") - 1
    chunk = lambda k: F.concat(F.lower(F.hex(F.least(F.lit(size), n - k * size))), F.lit(END), _text(F.substring(payload, k * size + 1, F.lit(size))), F.lit(END))
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), chunk), ""))


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, record identifier rid, and first: the smallest page_id of equal payloads
    of `least` bytes or more, with first_rid and first_url, its record's identifier and address.

    The digest's groups are counted before the shuffle; only digests that occur twice are joined back, on a side
    with one row a digest, so a payload that a third of the pages share can be split.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "rid": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))})
    of_first = lambda c: F.min_by(c, "page_id").alias(f"first_{c}")
    twice = p.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), of_first("rid"), of_first("url"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return p.join(twice, "digest", "left")


def write_warc(pages: DataFrame, path: str, *, least: int = 100, chunk: int = 8192, segment: int = 32768, records_a_file: int = 20000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one response or revisit record for each row of `pages` (page_id, url, html) as gzipped archives in `path`.

    A response's block is an HTTP answer whose body is the html in UTF-8 (null: empty), framed in chunks; blocks
    longer than `segment` bytes go on in continuation records. Of records with equal payloads of `least` bytes or
    more, that with the smallest page_id is the response and the others revisit it. Repeated rows with that
    smallest page_id are all responses. A null page_id or url leaves out its header field; a null page_id is never
    the one referred to unless all are null. An empty table writes an empty archive. Other columns are ignored.
    """
    p = with_revisits(pages, least)
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull())
    head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}")
    body = F.concat(head, F.lit(f"Transfer-Encoding: chunked{END}{END}"), _chunked(F.col("payload"), chunk), F.lit(f"0{END}{END}"))
    p = p.withColumns({"revisit": revisit, "block": F.when(revisit, F.concat(head, F.lit(END))).otherwise(body).cast("binary")})
    length = F.octet_length("block")
    p = p.withColumn("parts", F.greatest(F.lit(1), F.ceil(length / segment)).cast("int"))
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("k"))
    again = {"WARC-Refers-To": F.col("first_rid"), "WARC-Refers-To-Target-URI": F.regexp_replace("first_url", r"[\r\n]+", " "), "WARC-Refers-To-Date": F.lit(date), "WARC-Profile": F.lit(SAME_PAYLOAD)}
    part = F.substring(F.col("block"), (F.col("k") - 1) * segment + 1, F.lit(segment))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.when(F.col("k") > 1, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.when(F.col("k") > 1, F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(F.col("rid"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        _field("WARC-Payload-Digest", F.when(F.col("k") == 1, F.concat(F.lit("sha256:"), F.col("digest")))),
        _field("WARC-Page-ID", F.when(F.col("k") == 1, F.col("page_id"))),
        _field("WARC-Refers-To-Page-ID", F.when(F.col("revisit") & (F.col("k") == 1), F.col("first"))),
        *(_field(name, F.when(F.col("revisit") & (F.col("k") == 1), value)) for name, value in again.items()),
        _field("WARC-Segment-Number", F.when(F.col("parts") > 1, F.col("k"))),
        _field("WARC-Segment-Origin-ID", F.when(F.col("k") > 1, F.col("rid"))),
        _field("WARC-Segment-Total-Length", F.when((F.col("k") > 1) & (F.col("k") == F.col("parts")), length)),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(part)),
        F.lit(END),
        _text(part),
    )
    p.select(record.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def inflated(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, piece by piece; raises an error where one is cut short or anything else follows."""
    view, at = memoryview(content), 0
    while at < len(view) or not at:
        member = zlib.decompressobj(47)
        while not member.eof:
            if at >= len(view):
                raise ValueError(f"archive is cut short at byte {at}")
            piece = view[at : at + step]  # what follows a member is copied, so no more than this is handed over
            data = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            if data:
                yield data


def unpack(content: bytes, step: int = 1 << 16) -> bytes:
    """All of it at once."""
    return b"".join(inflated(content, step))


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive that comes in pieces, of which no more than a record is held; raises
    ValueError where the framing is broken."""
    held, at, more = bytearray(), 0, iter(pieces)

    def reach(n: int) -> bool:
        while len(held) < n:
            if (piece := next(more, None)) is None:
                return False
            held.extend(piece)
        return True

    while reach(1):
        looked, end = 0, -1
        while reach(min(looked + 1, 5)) and held.startswith(b"WARC/"[: len(held)]):
            end = held.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(held)
            if end >= 0 or not reach(looked + 1):
                break
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no record header at byte {at}")
        lines = held[:end].decode("utf-8", "replace").split(END)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        if not reach(start + size + 4) or held[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, bytes(held[start : start + size])
        at += start + size + 4
        del held[: start + size + 4]


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive; raises ValueError where the framing is broken."""
    return records([data])


def _parse(batches: Iterator[pa.RecordBatch], segmented: bool, types: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            held = 0
            for f, block in records(inflated(content.as_py())):
                if ("warc-segment-number" in f) != segmented or not segmented and types is not None and f["warc-type"] not in types:
                    continue
                rid = f.get("warc-record-id")
                rows.append((rid, f.get("warc-segment-origin-id", rid), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f["warc-type"], number(f.get("warc-page-id")), number(f.get("warc-refers-to-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), block))
                held += len(block)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def dechunk(body: bytes) -> bytes:
    """Body of chunked transfer framing; extensions and trailers are skipped; raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(chunk)
        at = end + 4 + size


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = []
        for kind, block in zip(batch.column("record_type").to_pylist(), batch.column("block").to_pylist(), strict=True):
            head, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") or re.match(rb"[A-Z]+ \S+ HTTP/", block) else (b"", b"", block)
            framed = any(x.partition(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n"))
            payloads.append(None if kind == "revisit" else dechunk(body) if framed else body)
        keep = [n for n in batch.schema.names if n != "block"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(payloads, pa.binary())], [*keep, "payload"])


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] | None = PAGES) -> DataFrame:
    """Records of the archives in `path`: record_type, page_id, refers_to, target_uri, declared_digest, record_id, refers_to_id,
    payload.

    Archives are gzip files of any number of members, such as one a record. record_id and refers_to_id are the standard fields of
    a record's identifier and of the record that a revisit refers to; page_id and refers_to are those that write_warc()
    adds, and null elsewhere: see responses_of(). Segments are grouped by their origin's identifier, ordered by number and
    joined, and the origin's identifier is that of the whole; a missing or repeated number or a total length that the last segment does not declare so raises an error. Only segmented records are
    shuffled. Chunked framing is decoded. A revisit has a null payload. Records of other `types` are skipped (None: all are
    read; a block that is no HTTP message is its own payload). No archives give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files.mapInArrow(partial(_parse, segmented=False, types=types), RECORD)
    pieces = files.mapInArrow(partial(_parse, segmented=True, types=types), RECORD)
    head = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = pieces.groupBy("origin_id").agg(
        *(head(c) for c in ("record_type", "page_id", "refers_to", "target_uri", "declared_digest", "record_id", "refers_to_id")), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts")
    )
    if types is not None:  # a missing first segment is still an error
        joined = joined.filter(F.col("record_type").isNull() | F.col("record_type").isin(*types))
    block = F.array_join(F.transform("parts", lambda x: _text(x.block)), "").cast("binary")
    joined = joined.withColumn("block", block)
    right = (F.octet_length("block") == F.col("total")) & (F.transform("parts", lambda x: x.segment) == F.sequence(F.lit(1), F.size("parts")))
    joined = joined.withColumn("block", F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), "origin_id")).cast("binary")))
    keep = ["record_type", "page_id", "refers_to", "target_uri", "declared_digest", "record_id", "refers_to_id", "block"]
    schema = "record_type string, page_id long, refers_to long, target_uri string, declared_digest string, record_id string, refers_to_id string, payload binary"
    return whole.select(keep).unionAll(joined.select(keep)).mapInArrow(_decode, schema)


def responses_of(read: DataFrame) -> DataFrame:
    """record_id of each revisit of read_warc() and response_id, the record that holds its payload: the one it refers to by identifier
    or, where it names none that is there, one that declares the same payload digest (the smallest identifier); else null.

    Works on any archive. Identifiers and digests alone are shuffled, and a response that many revisit is on the side with one row
    a key. Revisits without an identifier come out with a null one; equal identifiers of several responses count once.
    """
    revisits = read.filter("record_type = 'revisit'").select("record_id", "refers_to_id", "declared_digest")
    others = read.filter("record_type <> 'revisit' and record_id is not null")
    named = others.select(F.col("record_id").alias("refers_to_id"), F.col("record_id").alias("by_id")).distinct()
    equal = others.groupBy("declared_digest").agg(F.min("record_id").alias("by_digest"))
    both = revisits.join(named, "refers_to_id", "left").join(equal, "declared_digest", "left")
    return both.select("record_id", F.coalesce("by_id", "by_digest").alias("response_id"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes `pages` to an archive in the shared folder, reads it back and describes each record's full payload.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's payload is that of the
    response it refers to, looked up by page_id; the digest found must equal the declared one, else it is an error.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    r = read_warc(spark, path).select("page_id", "record_type", "refers_to", "declared_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("found"))
    r = cut(r)
    delete(spark, path)
    release(spark)  # the shuffles of writing are not needed any more
    asked = r.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared_digest")
    first = r.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "found").agg(F.max("payload_bytes").alias("payload_bytes"))
    found = asked.join(first, [asked.refers_to.eqNullSafe(first.refers_to), asked.declared_digest == first.found], "left").drop(first.refers_to)
    both = r.filter("record_type = 'response'").select("page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "found").unionByName(found.select("page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "found"))
    digest = F.when(F.col("found") == F.col("declared_digest"), F.substring("found", 8, 64)).otherwise(F.raise_error(F.lit("payload differs from its digest")))
    return both.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM q
"""
