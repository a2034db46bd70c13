"""WARC archives: a writer with revisit records, and a reader that salvages what a damaged archive still holds.

The reader checks each gzip member, version line, header block, length and payload digest. After a failed check it
searches for the next version line in the plain bytes (of the archive, or of the member at hand, which may hold any number
of records) and else for the next gzip member that opens with one, goes on there, and reports the bytes between as a
quarantined gap. Of a member that can't be inflated whole, records in what was inflated are kept if their length and end agree;
those that neither a digest nor a member's checksum proves say so. A member's plain bytes are read piece by piece: its
size doesn't count, only that of its records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, staged
from .files import read_file, write_file
from .textbytes import slices

VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
#: A version line with a header line after it, wherever it stands: damage may have taken the line end before it.
HEAD = re.compile(VERSION.pattern + rb"(?=[A-Za-z-]+:)")
MAGIC = b"\x1f\x8b\x08"
#: Uncompressed bytes after which a task begins another archive file.
ARCHIVE_BYTES = 32 << 20
#: Bytes that are inflated, or searched, at a time; of plain records that are held until their member's end is known; of a header block.
STEP, HOLD, HEADER = 1 << 18, 8 << 20, 1 << 20
#: A version line and the header line's name after it aren't longer.
LINE = 256
DATE = "1970-01-01T00:00:00Z"
RECORDS = "file string, begin bigint, end bigint, inside_begin bigint, inside_end bigint, problem string, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, proved boolean, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record of an HTTP response; a revisit has its HTTP head, but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Found:
    """A record (problem is None) or a quarantined gap: a range of the archive's bytes, and inside a member of several parts, of its plain bytes."""

    begin: int
    end: int
    problem: str | None
    fields: dict[str, str]
    payload: bytes | None = None
    payload_bytes: int | None = None
    inside: tuple[int, int] | None = None
    #: A digest of the payload was given and agrees, or the checksum of the whole member does.
    proved: bool = False


class Damaged(Exception):
    pass


class Incomplete(Exception):
    """More bytes are needed to tell: so many in all."""


def same_digest(payload: bytes, want: str) -> bool:
    """A SHA-1 digest in base32 or hex, in either case."""
    found = hashlib.sha1(payload)
    return want.lower() == found.hexdigest() or want.upper().rstrip("=") == digest32(payload)


def parse_record(data: bytes | bytearray, at: int = 0, ended: bool = True) -> tuple[Found, int]:
    """The record that begins at a place of plain bytes, and where it ends; raises Damaged if a check fails, and Incomplete if it needs more than there is before the end."""
    if not (v := VERSION.match(data, at)):
        if not ended and len(data) - at < LINE:
            raise Incomplete(at + LINE)
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", v.end() - 2)
    if stop < 0:
        if not ended and len(data) - at < HEADER:
            raise Incomplete(len(data) + STEP)
        raise Damaged("header block without an end")
    fields = {}
    # a line that begins with a blank goes on with the one before it
    for line in re.sub(rb"\r\n[ \t]+", b" ", bytes(data[v.end() : stop])).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no length")
    begin, end = stop + 4, stop + 4 + int(fields["content-length"])
    if len(data) < end + 4 and not ended:
        raise Incomplete(end + 4)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record doesn't end where its length says")
    block, payload, size, proved = bytes(data[begin:end]), None, None, False
    if fields.get("warc-type", "").lower() == "revisit":  # of any block, or none
        m = re.search(rb"(?im)^content-length:\s*(\d+)", block.partition(b"\r\n\r\n")[0])
        size = int(m[1]) if m else None
    elif fields.get("content-type", "").lower().startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("no HTTP head")
    else:
        payload = block
    if payload is not None:
        size = len(payload)
        kind, _, want = fields.get("warc-payload-digest", "").partition(":")
        if kind.strip().lower() == "sha1":
            if not (proved := same_digest(payload, want.strip())):
                raise Damaged("payload digest differs")
    return Found(at, end + 4, None, fields, payload, size, proved=proved), end + 4


def _next_member(data: bytes, at: int) -> int:
    """The next place where a gzip member opens with a version line."""
    while (at := data.find(MAGIC, at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 16)[:5] == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def read_stream(pieces: Iterator[bytes]) -> Iterator[Found]:
    """Records and gaps of plain bytes that come in pieces, in order; together they cover them. One record is held at a time."""
    data, base, at, ended = bytearray(), 0, 0, False

    def more(need: int) -> None:
        nonlocal ended
        while not ended and len(data) < need:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                data.extend(piece)

    while True:
        if at > STEP:
            del data[:at]
            base, at = base + at, 0
        more(at + 1)
        if at >= len(data):
            return
        try:
            found, end = parse_record(data, at, ended)
            found.begin, found.end = base + at, base + end
            yield found
            at = end
        except Incomplete as e:
            more(e.args[0])
        except Damaged as e:
            begin, look = base + at, at + 1
            while not (m := HEAD.search(data, look)) and not ended:
                # what is before can't begin a version line
                cut = max(look, len(data) - LINE)
                del data[:cut]
                base, look = base + cut, 0
                more(len(data) + STEP)
            at = m.start() if m else len(data)
            yield Found(begin, base + at, str(e), {})


def read_plain(data: bytes) -> Iterator[Found]:
    """Records and gaps of plain bytes, in order."""
    view = memoryview(data)
    return read_stream(view[k : k + STEP] for k in range(0, len(data), STEP))


class Member:
    """A gzip member's plain bytes in pieces; when they are read, where it ends and what is wrong with it."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end, self.problem = memoryview(data), at, at, None

    def pieces(self) -> Iterator[bytes]:
        if self.data[self.at : self.at + 3] != MAGIC:
            self.problem = "no gzip member"
            return
        z, at = zlib.decompressobj(31), self.at
        while at < len(self.data) and not z.eof:
            given = self.data[at : at + STEP]
            at += len(given)
            while True:
                spare = z.copy()
                try:
                    out = z.decompress(given, STEP)
                except zlib.error as e:
                    self.problem = f"gzip: {e}"
                    # what the bytes before the damage still give
                    try:
                        for k in range(0, len(given), 16):
                            yield spare.decompress(given[k : k + 16])
                    except zlib.error:
                        return
                    return
                if out:
                    yield out
                given = z.unconsumed_tail
                if z.eof or not (given or len(out) == STEP):
                    break
        self.end = at - len(z.unused_data)
        self.problem = None if z.eof else "gzip member cut short"

    def skim(self) -> tuple[int, str | None]:
        """Its end (that of what is lost, if it is damaged) and what is wrong."""
        for _ in self.pieces():
            pass
        return self.told()

    def told(self) -> tuple[int, str | None]:
        return (_next_member(self.data.obj, self.at + 1) if self.problem else self.end), self.problem


def read_archive(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in order of their bytes; together they cover it."""
    if data[:2] != MAGIC[:2] and (VERSION.match(data) or _next_member(data, 0) == len(data)):
        yield from read_plain(data)
        return
    at = 0
    while at < len(data):
        at = yield from _read_member(data, at)


def _read_member(data: bytes, at: int) -> Iterator[Found]:
    """The records and gaps of a member, with the member's range and, if it holds several, their own inside; returns where it ends.

    Records are held back until the member's end is known; if they are large, it is inflated once more to know it.
    """
    member_, known, held, size, alone = Member(data, at), None, [], 0, True

    def placed(x: Found, told: tuple[int, str | None], inside: bool) -> Found:
        x.inside = (x.begin, x.end) if inside else None
        x.begin, x.end, x.proved = at, told[0], x.problem is None and (x.proved or told[1] is None)
        return x

    for x in read_stream(member_.pieces()):
        held.append(x)
        size += len(x.payload or b"")
        if size > HOLD and len(held) > 1:
            known = known or Member(data, at).skim()
            for y in held[:-1]:
                yield placed(y, known, True)
            held, size, alone = held[-1:], len(x.payload or b""), False
    end, problem = known or member_.told()
    if alone and not any(x.problem is None for x in held) and (problem or not held):
        yield Found(at, end, problem or "empty member", {})
        return end
    if problem and held and held[-1].problem:  # the end of what could be inflated
        held[-1].problem = problem
    for x in held:
        yield placed(x, (end, problem), not alone or len(held) > 1 or bool(problem))
    return end


def _write(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = count = 0

        def done() -> pa.RecordBatch:
            # a name of its own: what a task that was tried again has left is in no manifest
            name = f"{uri}/{uuid.uuid4().hex}.warc.gz"
            data = b"".join(parts)
            write_file(name, data)
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([len(data)], pa.int64()), "records": pa.array([count], pa.int64())})

        for b in slices(batches, "payload"):
            col = {n: b.column(j) for j, n in enumerate(b.schema.names)}
            for name, url, payload, digest, kind, refers in zip(*(col[n] for n in ("name", "url", "payload", "digest", "kind", "refers_to")), strict=True):
                p = payload.as_buffer().to_pybytes() if payload.is_valid else b""
                parts.append(member(record(kind.as_py(), name.as_py(), url.as_py(), p, base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers.as_py())))
                size, count = size + len(p), count + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    parts, size, count = [], 0, 0
        if parts:
            yield done()

    return run


PREFIX = "urn:tessera:page:"


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """page_id, url, html -> archives of gzip members under a folder; returns their manifest: file, bytes, records.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads the one with the largest page_id is
    a response and the others revisit it; rows that share that id are all responses. A null id counts as the smallest.
    Texts may be of any length; repeated rows are records each; other columns are ignored; an empty table gives no archive.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # who is a response is told without payloads; these only move to their page's own entry, however many pages share one
    keys = rows.select("page_id", "digest", "size").distinct()
    last = staged(keys.groupBy("digest", "size").agg(F.max("page_id").alias("last")), "last")
    keys = staged(keys.join(last.hint("merge"), ["digest", "size"]).select(F.col("page_id").alias("of"), F.col("digest").alias("d"), F.col("size").alias("s"), "last"), "roles")
    rows = rows.join(keys.hint("merge"), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")))
    name = lambda c: F.concat(F.lit(PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    first = F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select(name("page_id").alias("name"), "url", "payload", "digest", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, name("last")).alias("refers_to"))
    return staged(rows.mapInArrow(_write(uri), "file string, bytes bigint, records bigint"), "manifest")


def _rows(file: str, data: bytes, with_payload: bool) -> Iterator[pa.RecordBatch]:
    def batch(found: list[Found]) -> pa.RecordBatch:
        names = {"warc_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
        cols = {"file": pa.array([file] * len(found), pa.string()), "begin": pa.array([x.begin for x in found], pa.int64()), "end": pa.array([x.end for x in found], pa.int64()), "inside_begin": pa.array([x.inside and x.inside[0] for x in found], pa.int64()), "inside_end": pa.array([x.inside and x.inside[1] for x in found], pa.int64()), "problem": pa.array([x.problem for x in found], pa.string())}
        cols |= {k: pa.array([x.fields.get(v) for x in found], pa.string()) for k, v in names.items()}
        return pa.RecordBatch.from_pydict(cols | {"payload_bytes": pa.array([x.payload_bytes for x in found], pa.int64()), "proved": pa.array([x.proved for x in found], pa.bool_()), "payload": pa.array([x.payload if with_payload else None for x in found], pa.binary())})

    held: list[Found] = []
    for x in read_archive(data):
        held.append(x)
        if len(held) == 500:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The files of a manifest (file) -> RECORDS: records, and gaps, which have a problem and no other field.

    proved is false for a record without a digest in a member without a good checksum, or in no member. An archive without
    a byte gives no row; a file that is listed twice is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                yield from _rows(file, read_file(file), with_payload)

    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("file").repartition(max(n, 8), "file").mapInArrow(run, RECORDS)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All archives under a path that Spark reads (.warc, .warc.gz) -> RECORDS, as read_archives().

    An archive is read as one binary value, which Spark bounds at 2 GB: a larger file is an error of Spark's, not a shorter
    result. An empty archive gives no row; equal files, and repeated records, are rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _rows(file, data.as_buffer().to_pybytes(), with_payload)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """page_id, url, html -> written to archives, and RECORDS read back from them (without payloads).

    One record for each row, repeated and null ids included; texts of any length; other columns are ignored; an empty
    table gives an empty table.
    """
    return read_archives(write_archives(pages, uri or scratch(pages.sparkSession, "warc")), with_payload=False)
