"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

write() sums up the payloads (length and SHA-1) without moving them; of equal payloads the
record with the largest page_id is a response and the others revisit it. Records are
plain WARC/1.1 text, each one ended by a blank line pair, and go out through Spark's text
writer with the last line feed as the line separator: files in any file system Spark
writes to. Payloads of a size class go together, as many to a file as keep it within
ARCHIVE_BYTES, so that a reader's task can hold an archive whatever the pages' sizes.

read() parses whole archives (an archive is one row of Spark's reader of binary files, which
holds 2 GB at most, and has to fit a task: that is read()'s limit), plain or in gzip members of a record or more. Of a member's
rows the first has its length in the archive and the others 0. Blocks are taken apart as
HTTP where their content type says so, or where none is given and they begin so. Payload
digests are checked where a record has one of a known algorithm. Where a record fails its
checks (header, length, end marks, payload digest) the reader searches for the next
member or version line from which a record passes, recovers what follows, and logs the
bytes between as a gap. A gzip member that is cut, broken or has a wrong checksum gives the
records before the fault; its gap begins where the last of them had been read. All of this
is linear in the archive.

Defined results: null html is an empty payload; a null page_id is below all others; rows
that repeat page_id and html share a verdict; line breaks in a URL become blanks; an empty
table gives an archive without records; other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import common

#: Upper bytes of a class of payloads with their URLs, and of an archive of such records
#: (headers come on top); a larger payload has an archive of its own.
CLASSES = tuple(1 << k for k in (12, 15, 18, 21, 24))
ARCHIVE_BYTES = 1 << 24
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: Bytes of a gzip member that are inflated at a time.
WINDOW = 1 << 16
RECORDS = (
    "archive string, offset long, length long, kind string, reason string, type string, record_id string, "
    "refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_digest(html: Column) -> Column:
    """base32_sha1() of a string's bytes: 20 bits of the hexadecimal form are four digits."""
    hashed, digits = F.sha1(html), []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(hashed, k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*digits)


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of the pages under path, in a folder for each size class of payloads."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html") + F.octet_length("url")
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("class", F.coalesce(*(F.when(size <= most, k) for k, most in enumerate(CLASSES)), F.lit(len(CLASSES))))
    facts = common.stored(rows.select("page_id", payload_digest(F.col("html")).alias("digest"), "n", "class"), "payloads")
    best = facts.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    revisits = common.stored(
        facts.join(best, "digest")
        .where("page_id IS NOT NULL AND page_id < refers_to OR page_id IS NULL AND refers_to IS NOT NULL")
        .select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "refers_to")
        .distinct(),
        "revisits",
    )
    rows = rows.withColumn("digest", payload_digest(F.col("html")))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    again = F.col("of_digest").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n")
    )
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate("url", "\r\n", "  ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(
            again,
            F.concat(line("WARC-Refers-To", page("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(again, "").otherwise(F.col("html")),
        F.lit("\r\n\r"),
    )
    # At most len(CLASSES) + 1 values, and as many passes over the pages.
    for k in sorted(r["class"] for r in facts.select("class").distinct().collect()) or [0]:
        each = max(1, ARCHIVE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        rows.where(F.col("class") == k).select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", each).text(f"{path}/class-{k}")


class Bad(ValueError):
    """A record that fails a check."""


def digest_fits(field: str, payload: bytes) -> bool:
    """Whether a labelled digest, in base 32 or 16, is the payload's; unknown ones pass."""
    algorithm, _, value = field.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = hashlib.new(algorithm, payload).digest()
    return value.strip().upper().rstrip("=") in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line is at `at`, and where it ends."""
    head_end = data.find(END, at) if data.startswith(VERSION, at) else -1
    if head_end < 0:
        raise Bad("header")
    fields, name = {}, None
    for row in data[at:head_end].split(b"\r\n")[1:]:
        if row[:1] in (b" ", b"\t") and name is not None:  # a folded line goes on with the field
            fields[name] = f"{fields[name]} {row.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = row.partition(b":")
        if not colon:
            raise Bad("header")
        name = name.strip().lower()
        fields[name] = value.strip().decode("utf-8", "replace")
    if not fields.get(b"content-length", "").isdigit() or b"warc-type" not in fields:
        raise Bad("header")
    body = head_end + len(END)
    end = body + int(fields[b"content-length"])
    if end > len(data):
        raise Bad("length")
    if data[end : end + len(END)] != END:
        raise Bad("end marks")
    kind, block = fields.get(b"content-type", "").split(";")[0].strip().lower(), data[body:end]
    sizes: list = []
    payload = block
    if kind == "application/http" or not kind and block.startswith(b"HTTP/"):
        http, found, payload = block.partition(END)
        if not found:
            raise Bad("http header")
        sizes = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get(b"warc-payload-digest")
    if fields[b"warc-type"] != "revisit" and digest and not digest_fits(digest, payload):
        raise Bad("payload digest")
    record = {
        "type": fields[b"warc-type"],
        "record_id": fields.get(b"warc-record-id"),
        "refers_to": fields.get(b"warc-refers-to"),
        "uri": fields.get(b"warc-target-uri"),
        "payload_digest": digest and digest.removeprefix("sha1:"),
        # A revisit has no payload of its own; the size of the one it means is what HTTP says.
        "payload_bytes": int(sizes[0]) if fields[b"warc-type"] == "revisit" and sizes and sizes[0].isdigit() else len(payload),
        "payload": payload,
    }
    return record, end + len(END)


def member_body(data: bytes, at: int) -> int:
    """Where the deflated bytes of the gzip member at `at` begin."""
    flags, k = data[at + 3] if at + 10 <= len(data) else 0xE0, at + 10
    if flags & 0xE0:
        raise Bad("gzip")
    if flags & 4:
        k += 2 + int.from_bytes(data[k : k + 2], "little")
    for flag in (8, 16):  # a name, a comment
        if flags & flag:
            k = data.find(b"\0", k) + 1
            if not k:
                raise Bad("gzip")
    return k + 2 * bool(flags & 2)


def inflated(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int]], int, str | None]:
    """(content of the gzip member at `at`, marks (bytes of it, place they are read at), where the
    member ends, what is wrong with it). A member that breaks off gives what comes before.

    The member is fed in windows, and the window that breaks in ever smaller ones.
    """
    k, out, marks, length = member_body(data, at), [], [], 0
    decoder, crc, step, broken = zlib.decompressobj(-15), 0, WINDOW >> 4, False
    view = memoryview(data)
    while not decoder.eof and k < len(data):
        before = decoder.copy()
        try:
            part = decoder.decompress(view[k : k + step])
        except zlib.error:
            decoder, broken = before, True
            if step == 1:
                return b"".join(out), marks, k, "gzip"
            step = max(1, step // 16)
            continue
        k = min(k + step, len(data))
        step = step if broken else min(WINDOW, 2 * step)
        crc, length = zlib.crc32(part, crc), length + len(part)
        out.append(part)
        marks.append((length, k))
    if not decoder.eof:
        return b"".join(out), marks, k, "gzip ends early"
    k -= len(decoder.unused_data)
    sums = (crc.to_bytes(4, "little") + (length & 0xFFFFFFFF).to_bytes(4, "little"), data[k : k + 8])
    return b"".join(out), marks, min(k + 8, len(data)), None if sums[0] == sums[1] else "gzip checksum"


def parse_at(data: bytes, at: int) -> tuple[list[dict], int, tuple[int, int, str] | None]:
    """(rows of the record or gzip member at `at`, where it ends, what of it is lost).

    What is lost of a member: from where, at least to where, and why.
    """
    if not data.startswith(GZIP, at):
        record, end = parse_record(data, at)
        return [{"kind": "record", "offset": at, "length": end - at} | record], end, None
    inner, marks, end, fault = inflated(data, at)
    rows = list(salvage(inner))
    records = [x for x in rows if x["kind"] == "record"]
    if not records:
        raise Bad(fault or (rows[0]["reason"] if rows else "header"))
    lost = None
    if fault == "gzip checksum":
        lost = (max(at, end - 8), end, fault)
    elif fault:
        # Records end with the last of them; the member's gap is that of the archive.
        last = max(k for k, x in enumerate(rows) if x["kind"] == "record")
        rows, whole = rows[: last + 1], records[-1]["offset"] + records[-1]["length"]
        lost = (next(place for size, place in marks if size >= whole), at + 1, fault)
    return [x | {"offset": at, "length": 0 if k else end - at} for k, x in enumerate(rows)], end, lost


def next_start(data: bytes, at: int) -> int:
    """Where the next version line or gzip member may start, else the end."""
    found = [k for mark in (VERSION, GZIP) if (k := data.find(mark, at)) >= 0]
    return min(found, default=len(data))


def salvage(data: bytes) -> Iterator[dict]:
    """Every record that passes its checks, and the gaps between them."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            rows, end, lost = parse_at(data, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            at = next_start(data, at + 1)
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": min(gap, at), "length": max(0, at - gap), "reason": reason}
            gap = None
        yield from rows
        if lost is None:
            at = end
        else:
            gap, at, reason = lost
            if at < len(data) and not data.startswith((VERSION, GZIP), at):
                at = next_start(data, at)
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": reason}


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "content")
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string())) for n, x in zip(names, RECORDS.split(", "), strict=True)])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found = []
                for row in salvage(content.as_py()):
                    if not with_payload:
                        row["payload"] = None
                    found.append(row | {"archive": name.as_py()})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return files.mapInArrow(parsed, RECORDS)


def page_of(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
