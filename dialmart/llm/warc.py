"""WARC archives: writing response and revisit records, and a reader that salvages damaged files.

The reader checks each gzip member or version line, the header, the block's length and its digests,
by whatever algorithm their labels name.  After a failed check it searches for the next member or
version line that starts a valid record, goes on there, and reports the bytes between as
quarantined.  A member that holds several records is read in the same way inside.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, n_partitions, new_dir
from .files import read_file, write_file

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a writer begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Payloads below this are never revisits.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"

#: Bytes that are inflated at once.
STEP = 1 << 15

_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"WARC/\d\.\d\r?\n")


def _base32(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


_ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def _digest_of(value: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a labelled digest in base 32 or hex; None if it can't be checked."""
    kind, _, text = (value or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    size = _ALGORITHMS.get(kind)
    if size is None:
        return None
    if re.fullmatch("[0-9A-Fa-f]{%d}" % (2 * size), text):
        return kind, text.lower()
    try:
        raw = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (kind, raw.hex()) if len(raw) == size else None


def _agrees(value: str | None, *data: bytes) -> bool:
    """Whether a labelled digest is that of one of the given bytes, or can't be checked."""
    told = _digest_of(value)
    return told is None or any(hashlib.new(told[0], d).hexdigest() == told[1] for d in data)


def record_id(key: int | None) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def _key_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def make_record(key: int | None, url: str | None, payload: bytes, first: int | None, compress: bool = True) -> bytes:
    """One record, as a gzip member of its own if compress; first is the page that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {_base32(payload)}",
        f"WARC-Block-Digest: {_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head[3:3] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    raw = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


class Damaged(ValueError):
    pass


def _header(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    """The fields from a place up to an empty line, and where the block begins."""
    head: dict[str, str] = {}
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            raise Damaged("header end")
        line = raw[at:end].rstrip(b"\r")
        at = end + 1
        if not line:
            return head, at
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()


def _parse(raw: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at a place of uncompressed bytes, and where it ends."""
    start = _START.match(raw, at)
    if not start:
        raise Damaged("version line")
    head, begin = _header(raw, start.end())
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Damaged("length")
    end = begin + int(size)
    if len(raw) < end:
        raise Damaged("block cut short")
    block = raw[begin:end]
    if raw.startswith(b"\r\n\r\n", end):
        end += 4
    elif raw.startswith(b"\n\n", end):
        end += 2
    else:
        raise Damaged("record end")
    if not _agrees(head.get("warc-block-digest"), block):
        raise Damaged("block digest")
    return {"head": head, "block": block}, end


def _member(raw: bytes, at: int) -> tuple[list[tuple], int]:
    """What salvage finds in the gzip member at a place, one record at least, and where the member ends."""
    inflate, parts, to = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and to < len(raw):
            parts.append(inflate.decompress(raw[to : to + STEP]))
            to += STEP
    except zlib.error as error:
        raise Damaged("member") from error
    if not inflate.eof:
        raise Damaged("member cut short")
    found = list(_salvage(b"".join(parts), False))
    if all(f[2] is None for f in found):
        raise Damaged(found[0][3] if found else "empty member")
    return found, min(to, len(raw)) - len(inflate.unused_data)


class _Next:
    """The first place of something at or after one that only grows, so that all bytes are searched once."""

    def __init__(self, find):
        self.find, self.at = find, -1

    def after(self, place: int) -> int | None:
        if self.at is not None and self.at < place:
            found = self.find(place)
            self.at = None if found < 0 else found
        return self.at


def salvage(raw: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) of each record and (start, end, None, reason) of each gap.

    What a gzip member of several records or with gaps holds has the member's start and end; such a record has its
    place among the inflated bytes as inner, and such a gap's reason names it.
    """
    yield from _salvage(raw, True)


def _salvage(raw: bytes, members: bool) -> Iterator[tuple]:
    def version(place: int) -> int:
        found = _START.search(raw, place)
        return found.start() if found else -1

    places = [_Next(version)] + ([_Next(lambda place: raw.find(_MEMBER, place))] if members else [])
    at, lost, why = 0, None, None
    while at < len(raw):
        # both kinds may stand in one file
        try:
            if members and raw.startswith(_MEMBER, at):
                found, end = _member(raw, at)
            else:
                record, end = _parse(raw, at)
                found = [(at, end, record, None)]
        except Damaged as error:
            if lost is None:
                lost, why = at, str(error)
            at = min((p for p in (n.after(at + 1) for n in places) if p is not None), default=len(raw))
            continue
        if lost is not None:
            yield lost, at, None, why
            lost = None
        for a, b, record, reason in found:
            if len(found) > 1:
                record, reason = (record | {"inner": a}, None) if record else (None, f"{reason}, bytes {a} to {b} of the member")
            yield at, end, record, reason
        at = end
    if lost is not None:
        yield lost, len(raw), None, why


def _unchunked(body: bytes) -> bytes:
    """The bytes of a body in chunks, as far as they go."""
    parts, at = [], 0
    while found := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(body, at):
        size = int(found[1], 16)
        parts.append(body[found.end() : found.end() + size])
        at = found.end() + size
        at += 2 if body.startswith(b"\r\n", at) else 1
        if not size:
            break
    return b"".join(parts)


def _payload(record: dict) -> tuple[list[bytes], int | None]:
    """The payload of a record, as it stands and without chunks, and the length that an HTTP header gives.

    Records that are not HTTP messages have their block as payload.
    """
    block = record["block"]
    if not record["head"].get("content-type", "").lower().startswith("application/http"):
        return [block], None
    gap = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: gap.start()], block[gap.end() :]) if gap else (block, b"")
    told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    chunked = re.search(rb"(?im)^transfer-encoding:.*chunked", head)
    return [body, _unchunked(body)] if chunked else [body], int(told[1]) if told else None


RECORDS = (
    "file string, start long, end long, gap string, record_type string, key long, url string,"
    " payload_bytes long, payload_digest string, refers_to long, inner long"
)


def _records(name: str, raw: bytes, with_payload: bool) -> Iterator[tuple]:
    for start, end, record, why in salvage(raw):
        if record is None:
            yield (name, start, end, why, *[None] * 7, None)
            continue
        head = record["head"]
        kind, inner = head.get("warc-type"), record.get("inner")
        bodies, told = _payload(record)
        if kind == "revisit":
            known = _digest_of(head.get("warc-payload-digest"))
            digest = known and (known[1] if known[0] == "sha256" else ":".join(known))
        elif not _agrees(head.get("warc-payload-digest"), *bodies):
            yield (name, start, end, "payload digest", *[None] * 6, inner, None)
            continue
        else:
            digest, told = hashlib.sha256(bodies[0]).hexdigest(), len(bodies[0])
        key, first = _key_of(head.get("warc-record-id")), _key_of(head.get("warc-refers-to"))
        row = (name, start, end, None, kind, key, head.get("warc-target-uri"), told, digest, first, inner)
        yield (*row, bodies[0] if with_payload and kind != "revisit" else None)


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 12
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _schema(with_payload: bool) -> tuple[str, pa.Schema]:
    text = RECORDS + (", payload binary" if with_payload else "")
    fields = [f.split() for f in text.split(",")]
    return text, pa.schema([(n, _KINDS[k]) for n, k in fields])


def _reader(with_payload: bool, load):
    _, schema = _schema(with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = load(batch, i)
                rows, held = [], 0
                for row in _records(name, raw, with_payload):
                    rows.append(row)
                    held += len(row[11] or b"")
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield _to_batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _to_batch(rows, schema)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives that a manifest names in its column file.

    A row is a record, or a gap of quarantined bytes: then gap says what failed and all that a
    record has is null.  payload_bytes and payload_digest (hex SHA-256) are of the full payload: of
    revisits as their headers give them, of other records as counted and checked here.  An empty manifest gives no rows.
    """
    text, _ = _schema(with_payload)
    paths = manifest.select("file").repartition(4 * n_partitions(manifest.sparkSession), "file")
    run = _reader(with_payload, lambda b, i: (b.column(0)[i].as_py(), read_file(b.column(0)[i].as_py())))
    return paths.mapInArrow(run, text)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The same of any archives that Spark can read as binary files, .warc or .warc.gz; these have 2 GB at most."""
    text, _ = _schema(with_payload)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    run = _reader(with_payload, lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py()))
    return files.mapInArrow(run, text)


def write_archives(
    pages: DataFrame, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); the manifest: file, records, bytes.

    A null html is an empty payload, a null url is about:blank.  Of equal payloads of revisit_bytes
    or more the row with the smallest page_id is a response and the others revisit it; shorter
    payloads, rows that repeat the smallest page_id and rows without a page_id are responses.
    Equal payloads are found by SHA-256.  Further columns are left out.  No rows give no archives.
    """
    folder = new_dir(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.when(F.length("payload") >= revisit_bytes, F.sha2("payload", 256)))
    first = (
        rows.where("digest is not null and page_id is not null")
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # a payload without a digest meets nothing, and goes where its page_id says
    key = F.coalesce("digest", F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    linked = rows.join(first, key == F.col("_digest"), "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, size, done = TaskContext.get().partitionId(), [], 0, 0

        def whole() -> pa.RecordBatch:
            ending = "warc.gz" if compress else "warc"
            name = write_file(folder, f"pages-{task:06d}-{done:06d}.{ending}", b"".join(parts))
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(parts)], "bytes": [size]})

        for batch in batches:
            payloads = pc.cast(batch.column(2), pa.large_binary())
            keys, urls, firsts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for i in range(batch.num_rows):
                record = make_record(keys[i], urls[i], payloads[i].as_py(), firsts[i], compress)
                if parts and size + len(record) > archive_bytes:
                    yield whole()
                    parts, size, done = [], 0, done + 1
                parts.append(record)
                size += len(record)
        if parts:
            yield whole()

    return materialize(linked.mapInArrow(run, "file string, records long, bytes long"), "manifest")
