"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writing. Of pages with equal payloads of at least `least_revisit` bytes, the one with the least page_id is a response
record and the others are revisit records that name it. Each record is one gzip member. Spark's text writer puts them
down, its "line separator" being a gzip member that holds nothing, so that an archive is a plain chain of members in
whatever store Spark writes to.

Reading. Archives (a chain of members, or plain records) are read as files; a record is taken if its member's check sum,
its header, its length and its payload's digest are right. After a failed check the reader looks for the next member or
version line that starts a sound record, goes on from there, and logs the bytes between as a gap.

Null html is an empty payload, null urls are written empty. Rows with a null page_id are responses and come back with a
null page_id. Repeated ids with equal payloads are all of the kind that their id has. Page ids may be of any type. Columns besides
page_id, url and html are not read, whatever their names. An empty table gives no archive rows and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import scratch_path, settle

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes.
HOLLOW = bytes.fromhex("1f8b08000000000000030300000000" + "0000000000")
END = b"\r\n\r\n"
VERSION = b"WARC/1."
MOST_HEAD = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcPolicy:
    least_revisit: int = 100
    level: int = 6
    date: str = "2026-01-01T00:00:00Z"
    records_per_file: int = 4000
    chunk: int = 1 << 16


def header_value(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def page_urn(page_id: int | str | None) -> str:
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"


def record_bytes(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None, policy: WarcPolicy) -> bytes:
    """One record, its final blank lines included."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {policy.date}", f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block + END


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def packed_records(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, policy: WarcPolicy) -> Column:
    def pack(ids: pa.Array, urls: pa.Array, payloads: pa.Array, digests: pa.Array, refs: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), urls.to_pylist(), payloads, digests.to_pylist(), refs.to_pylist(), strict=True)
        return pa.array([member(record_bytes(i, u, p.as_py().encode("utf-8", "surrogatepass"), d, r, policy), policy.level) for i, u, p, d, r in rows], pa.binary())

    pack.__annotations__ = dict.fromkeys(("ids", "urls", "payloads", "digests", "refs", "return"), pa.Array)
    return F.arrow_udf(pack, "binary")(page_id, url, payload, digest, refers_to)


def write_archives(pages: DataFrame, path: str, policy: WarcPolicy | None = None) -> None:
    """pages: page_id, url, html."""
    policy = policy or WarcPolicy()
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    large = pages.where(F.col("size") >= policy.least_revisit).select("page_id", "digest")
    shared = settle(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    again = large.join(shared, "digest").where("page_id <> first").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct()
    marked = pages.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    body = F.when(F.col("size") > 0, F.col("html")).otherwise("")
    rows = marked.select(packed_records(F.col("page_id"), F.col("url"), body, F.col("digest"), F.col("first"), policy).cast("string").alias("value"))
    rows.write.option("lineSep", HOLLOW.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", policy.records_per_file).text(path)


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: memoryview


def parse(data: memoryview, offset: int = 0) -> Record | None:
    """The record that starts at offset of data (a view of all of some bytes), if it is whole and sound."""
    raw: bytes = data.obj
    line_end = raw.find(b"\r\n", offset, offset + 64)
    if not raw.startswith(VERSION, offset) or line_end < 0:
        return None
    headers, at = {}, line_end + 2
    while not raw.startswith(b"\r\n", at):  # line by line, so that what is no header is given up at once
        line_end = raw.find(b"\r\n", at, offset + MOST_HEAD)
        name, colon, value = raw[at:line_end].partition(b":") if line_end >= 0 else (b"", b"", b"")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass" if b"\xed" in value else "replace")
        at = line_end + 2
    size = headers.get("content-length", "")
    start = at + 2
    if not size.isdigit() or bytes(data[start + int(size) : start + int(size) + len(END)]) != END:
        return None
    record = Record(offset, start + int(size) + len(END), headers, data[start : start + int(size)])
    if not agrees(headers.get("warc-block-digest"), record.block):
        return None
    whole = headers.get("warc-type") in ("response", "resource") and "warc-segment-number" not in headers
    return record if not whole or agrees(headers.get("warc-payload-digest"), payload_of(record)) else None


def agrees(said: str | None, data: bytes | memoryview) -> bool:
    """Whether a digest header (name:value, the value in hexadecimal or base 32) fits; ones that can't be read do."""
    name, _, value = (said or "").strip().partition(":")
    kind = name.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(kind, data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def payload_of(record: Record) -> bytes:
    """What follows the HTTP head; the whole block where there is none."""
    body = bytes(record.block)
    if not body.startswith(b"HTTP/"):
        return body
    cut = body.find(END)
    return body[cut + len(END) :] if cut >= 0 else body


def inflate(data: memoryview, offset: int, chunk: int) -> tuple[bytes, int] | None:
    """A member's content and end, or nothing if it is damaged or cut off."""
    unpack, at, parts = zlib.decompressobj(31), offset, []
    step = min(512, chunk)  # small at first, as most false marks show at once
    try:
        while not unpack.eof:
            if at >= len(data):
                return None
            parts.append(unpack.decompress(data[at : at + step]))
            at, step = min(at + step, len(data)), min(2 * step, chunk)
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def salvage(data: bytes, chunk: int = 1 << 16) -> Iterator[Record | tuple[int, int]]:
    """The sound records of an archive in order, and between them the gaps (start, end) of bytes that were given up."""
    view, at, lost = memoryview(data), 0, None
    ahead = dict.fromkeys((MAGIC, VERSION), -1)  # the next place of each mark, looked for once
    while at < len(data):
        found: list[Record] = []
        if data.startswith(MAGIC, at):
            got = inflate(view, at, chunk)
            end = got[1] if got else at
            sound = got is not None
            if got and got[0]:
                inner, whole = 0, memoryview(got[0])
                while sound and inner < len(whole):
                    record = parse(whole, inner)
                    sound = record is not None
                    if record:
                        inner = record.end
                        found.append(Record(at, end, record.headers, record.block))
                if not sound:
                    found = []
        else:
            record = parse(view, at)
            sound = record is not None
            end = record.end if record else at
            found = [record] if record else []
        if sound:
            if lost is not None:
                yield lost, at
                lost = None
            yield from found
            at = end
            continue
        lost = at if lost is None else lost
        for mark, place in ahead.items():
            if place <= at:
                found_at = data.find(mark, at + 1)
                ahead[mark] = found_at if found_at >= 0 else len(data)
        at = min(ahead.values())
    if lost is not None:
        yield lost, len(data)


READ = "archive string, offset long, length long, kind string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def page_name(urn: str | None) -> str | None:
    """The page that a record id of write_archives names; other ids as they stand."""
    if urn is None or not urn.startswith("<urn:page:"):
        return urn
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) or None


def described(record: Record) -> tuple[str, int | None, str | None, bytes | None]:
    """(kind, bytes and sha256 of the payload, payload). Of revisits, which hold none, the headers say what they can."""
    h = record.headers
    kind = h.get("warc-type", "unknown")
    if kind == "revisit":
        size, digest = h.get("warc-payload-length", ""), h.get("warc-payload-digest", "")
        return kind, int(size) if size.isdigit() else None, digest.removeprefix("sha256:") or None, None
    body = payload_of(record) if kind in ("response", "resource") else bytes(record.block)
    return kind, len(body), hashlib.sha256(body).hexdigest(), body


def read_archives(spark: SparkSession, path: str, payloads: bool = True, policy: WarcPolicy | None = None) -> DataFrame:
    """A row for each sound record, its kind being the record's type, and for each gap (kind gap). Archives may be of any
    writer; one is read whole by its task, as Spark's binaryFile does, so it has 2 GB at most."""
    policy = policy or WarcPolicy()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for x in salvage(content.as_py(), policy.chunk):
                    if isinstance(x, tuple):
                        rows.append((archive.as_py(), x[0], x[1] - x[0], "gap", None, None, None, None, None, None))
                    else:
                        h = x.headers
                        kind, size, digest, body = described(x)
                        held += len(body or b"") * payloads
                        rows.append((archive.as_py(), x.offset, x.end - x.offset, kind, page_name(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, page_name(h.get("warc-refers-to")), body if payloads else None))
                    if len(rows) >= 4000 or held > 1 << 24:
                        yield as_batch(rows, names)
                        rows, held = [], 0
                yield as_batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, READ)


def as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def op8_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path, payloads=False)
    kind = pages.schema["page_id"].dataType
    return found.where("kind <> 'gap'").select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
