"""WARC archives: a writer of gzip members and a salvage reader.

The reader checks every member and record it meets (checksum, version line, headers, length, digests by the algorithm and
encoding that they name). Where a check fails, it searches on for the next member or version line that passes all of them,
recovers the records from there, and logs the bytes in between as a quarantined gap. The search also goes on within a gzip
member: sound records beside a damaged one come back, and so do those that inflate before the place where a member is cut,
damaged or has a wrong checksum; gaps within a member are logged by its place and their inner places. Members are
inflated as they are read, so memory holds a record (one with a damaged length: the rest of its member), not a member.

Rows: a null html is an empty payload; a null page_id is written and read as null; a repeated row (equal id and
payload) is a response each time; among equal payloads of `least` bytes or more, rows with the smallest page_id (nulls
last) are responses and the others revisit it; an empty table writes nothing. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, shared_dir, small_batches

#: An archive is closed once it has so many bytes; the reader takes one archive per task.
ARCHIVE_BYTES = 32 << 20
#: Digests of repeated payloads that may be broadcast (about 60 bytes each); beyond that they are joined.
BROADCAST_DIGESTS = 100_000
CHUNK = 1 << 18
#: Headers of a record are looked for in so many bytes; longer ones are damage.
HEADERS = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SINGLE = {"warc-type", "warc-record-id", "warc-date", "content-length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed. A revisit has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


MANIFEST = "path string, bytes long, records long"


def write_in_task(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Write a task's rows to archives of its own; an attempt that is lost leaves files that no manifest names."""
    from pyspark import TaskContext

    task, system, done, out = TaskContext.get(), None, [], None
    for batch in batches:
        for page_id, url, html, sha1, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "first", "revisit"))):
            if out is None:
                system, root = fs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                out, size, records = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
            payload = html.encode("utf-8", "surrogatepass") if html else b""
            member = gzip.compress(record_bytes(page_id, url, payload, base32(sha1), first, revisit), 3, mtime=0)
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= archive_bytes:
                out.close()
                done.append((f"{folder}/{name}", size, records))
                out = None
    if out is not None:
        out.close()
        done.append((f"{folder}/{name}", size, records))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), schema)], schema=schema)


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page to archives in `folder` (shared by all executors); returns the manifest, a written
    table of path, bytes, records."""
    small_batches(pages.sparkSession)
    given = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    repeated = materialize(given.filter(large).groupBy("sha1").agg(F.count("*").alias("rows"), F.min("page_id").alias("first")).filter("rows > 1").drop("rows"), "repeated-payloads")
    few = repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    marked = given.join(F.broadcast(repeated) if few else repeated, "sha1", "left")
    later = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False))
    rows = marked.select("page_id", "url", "html", "sha1", "first", later.alias("revisit"))
    return materialize(rows.mapInArrow(partial(write_in_task, folder=folder, archive_bytes=archive_bytes, schema=arrow_schema(MANIFEST)), MANIFEST), "manifest")


class View:
    """Bytes with a size that are read by place."""

    size: int

    def read(self, start: int, n: int) -> bytes:
        raise NotImplementedError

    def find(self, pattern: bytes, start: int) -> int:
        """The first place of a pattern from `start` on, or -1."""
        while start < self.size:
            part = self.read(start, min(CHUNK, self.size - start))
            k = part.find(pattern)
            if k >= 0:
                return start + k
            if start + len(part) >= self.size:
                return -1
            start += max(len(part) - len(pattern) + 1, 1)
        return -1


class Source(View):
    """Random access to a file through one chunk at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, CHUNK))
        return self.held[start - self.at : start - self.at + n]


def pieces(source: Source, start: int, most: int | None = None) -> Iterator[tuple[bytes, int, bool]]:
    """What inflates from the gzip member at `start`, in pieces: (bytes, place in the file after them, whether the member
    ended there with its checksum right). Where inflating fails, smaller steps get all bytes before the failure. With
    `most`, it ends after so many bytes."""
    engine, at, step = zlib.decompressobj(31), start, CHUNK // 8
    while not engine.eof and most != 0:
        part = source.read(at, min(step, source.size - at))
        before = engine.copy()
        try:
            out = engine.decompress(part, CHUNK if most is None else min(CHUNK, most))
        except zlib.error:
            if step == 1:
                return
            engine, step = before, max(1, step // 8)
            continue
        if not part and not out:
            return
        at += len(part) - len(engine.unconsumed_tail) - len(engine.unused_data)
        most = None if most is None else most - len(out)
        yield out, at, engine.eof


class Member(View):
    """What inflates of the gzip member at `start`, read forwards; only a small one is held whole. `whole` tells whether it
    ended with its checksum right, `stop` where in the file it ended or failed."""

    def __init__(self, source: Source, start: int):
        self.source, self.start = source, start
        self.size, self.stop, self.whole, self.at, self.held = 0, start, False, 0, bytearray()
        for piece, self.stop, self.whole in pieces(source, start):
            self.size += len(piece)
            if self.size <= CHUNK:
                self.held += piece
        self.rest = iter(())
        if self.size > CHUNK:
            self.held, self.rest = bytearray(), pieces(source, start)

    def read(self, start: int, n: int) -> bytes:
        while True:
            passed = min(start - self.at, len(self.held))
            del self.held[:passed]
            self.at += passed
            if self.at + len(self.held) >= min(start + n, self.size):
                return bytes(self.held[start - self.at : start - self.at + n])
            self.held += next(self.rest)[0]

    def place(self, inner: int) -> int:
        """The place in the file after the first `inner` bytes that inflate."""
        at = self.start
        for _, at, _ in pieces(self.source, self.start, inner):
            pass
        return at


def digest_holds(stated: str, data: bytes) -> bool | None:
    """Whether a digest as stated (algorithm, colon, base32, hexadecimal or base64) is that of the data; None where the
    algorithm or the encoding isn't known."""
    name, colon, value = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    value = value.strip()
    if not colon or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    own = hashlib.new(name, data).digest()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    bare = value.rstrip("=")
    if len(bare) == -(-8 * len(own) // 5):
        return bare.upper() == base64.b32encode(own).decode().rstrip("=")
    if len(bare) == -(-8 * len(own) // 6):
        return bare.replace("-", "+").replace("_", "/") == base64.b64encode(own).decode().rstrip("=")
    return None


def digest_column(stated: str, payload: bytes, revisit: bool) -> str:
    """The payload's SHA-1 in base32; of a revisit, whose payload isn't there, the one that it states (other algorithms as
    they stand)."""
    if not revisit:
        return base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name, _, value = stated.partition(":")
    if name.lower().replace("-", "") != "sha1":
        return stated
    return base32(value.lower()) if re.fullmatch(r"[0-9a-fA-F]{40}", value) else value.upper()


def parse_record(data: bytes) -> tuple[dict, int] | None:
    """A record at the start of `data` and its length, or None if any check fails. `verified` tells whether a digest of
    the record held."""
    if not data.startswith(VERSION):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        name = name.strip().lower().decode("latin-1")
        if not colon or name in SINGLE and name in fields:  # or the headers of a record that was cut run into the next
            return None
        fields[name] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18 or "warc-type" not in fields:
        return None
    stop = end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[end + 4 : stop]
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    stated, kind = fields.get("warc-payload-digest", ""), fields["warc-type"]
    checks = [digest_holds(fields.get("warc-block-digest", ""), block)]
    if kind in ("response", "resource", "conversion"):
        checks.append(digest_holds(stated, payload))
    if False in checks:
        return None
    return {"fields": fields, "payload": payload, "digest": digest_column(stated, payload, kind == "revisit"), "verified": True in checks}, stop + 4


def record_at(view: View, start: int) -> tuple[dict, int] | None:
    """The record at `start` and where it stops, or None if a check fails; what it needs is read in growing pieces."""
    n = CHUNK // 8
    while True:
        data = view.read(start, min(n, view.size - start))
        if not data.startswith(VERSION):
            return None
        end = data.find(b"\r\n\r\n")
        if end >= 0 or n >= view.size - start or n > HEADERS:
            break
        n *= 2
    length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", data[:end]) if end >= 0 else None
    if not length:
        return None
    need = end + 8 + int(length[1])
    if need > view.size - start:
        return None
    got = parse_record(data[:need] if need <= len(data) else view.read(start, need))
    return got and (got[0], start + got[1])


def records_in(view: View) -> Iterator[tuple[int, int, dict | None]]:
    """(start, stop, record) and (start, stop, None) of gaps, which together cover what a member holds, in order."""
    at = begin = 0
    while at >= 0 and at < view.size:
        got = record_at(view, at)
        if got is None:
            at = view.find(VERSION, at + 1)
            continue
        if at > begin:
            yield begin, at, None
        yield at, got[1], got[0]
        at = begin = got[1]
    if begin < view.size:
        yield begin, view.size, None


def member_at(source: Source, start: int) -> tuple[bool, int, Iterator[tuple[int, int, dict | None]]] | None:
    """Of the gzip member at `start`: whether its checksum is right, where what is sound of it stops in the file, and its
    records and inner gaps up to there; None if nothing of it is sound."""
    member = Member(source, start)
    if member.whole:
        return True, member.stop, records_in(member)
    after = source.find(MAGIC, start + 1)
    while 0 <= after < member.stop:  # a cut member may seem to go on in the next one's bytes
        if Member(source, after).whole:
            source = Source(source.file, after)
            member = Member(source, start)
            break
        after = source.find(MAGIC, after + 1)
    sound = max((stop for _, stop, record in records_in(member) if record is not None), default=0)
    if not sound:
        return None
    return False, member.place(sound), (found for found in records_in(Member(source, start)) if found[1] <= sound)


def salvage(source: Source) -> Iterator[tuple[str, int, int, int | None, int | None, dict | None]]:
    """("record" or "gap", start, stop, inner start, inner stop, record), which cover the file in order. Start and stop are
    places in the file, of a gzip member where it has records; inner ones are places in what it inflates to, null for plain
    records and for gaps of file bytes. A record is verified if its member's checksum or a digest of its own holds."""
    at = begin = 0
    ahead = {MAGIC: -1, VERSION: -1}
    while at < source.size:
        if source.read(at, len(MAGIC)) == MAGIC and (found := member_at(source, at)):
            whole, stop, entries = found
            some = False
            waiting = []  # gaps before the first record: if there is none, all of the member is one gap
            for a, b, record in entries:
                if record is None and not some:
                    waiting.append((a, b))
                    continue
                if not some:
                    some = True
                    if at > begin:
                        yield "gap", begin, at, None, None, None
                    for gap in waiting:
                        yield "gap", at, stop, *gap, None
                if record is None:
                    yield "gap", at, stop, a, b, None
                else:
                    yield "record", at, stop, a, b, record | {"verified": whole or record["verified"]}
            if some:
                begin = stop
            at = stop
            continue
        if source.read(at, len(VERSION)) == VERSION and (plain := record_at(source, at)):
            if at > begin:
                yield "gap", begin, at, None, None, None
            yield "record", at, plain[1], None, None, plain[0]
            at = begin = plain[1]
            continue
        for mark, place in ahead.items():
            if place <= at:
                place = source.find(mark, at + 1)
                ahead[mark] = source.size if place < 0 else place
        at = min(ahead.values())
    if source.size > begin:
        yield "gap", begin, source.size, None, None, None


RECORDS = "path string, kind string, start long, stop long, inner_start long, inner_stop long, verified boolean, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_in_task(batches: Iterator[pa.RecordBatch], payloads: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def number(field: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
        return int(found[1]) if found else None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, root = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with system.open_input_file(root) as file:
                for kind, start, stop, inner_start, inner_stop, record in salvage(Source(file, file.size())):
                    place = (path, kind, start, stop, inner_start, inner_stop)
                    if record is None:
                        rows.append((*place, *[None] * 8))
                    else:
                        f, payload = record["fields"], record["payload"]
                        whole = f["warc-type"] != "revisit"
                        rows.append((*place, record["verified"], number(f.get("warc-record-id")), f.get("warc-target-uri"), f["warc-type"], number(f.get("warc-refers-to")), record["digest"], len(payload) if whole else None, payload if payloads and whole else None))
                        held += len(payload) if payloads else 64
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (kind `record` or `gap`) of the archives in manifest.path, an archive per task. What they cover is
    told by `salvage`."""
    archives = max(1, manifest.count())
    one_each = manifest.select("path").repartition(archives)
    return one_each.mapInArrow(partial(read_in_task, payloads=payloads, schema=arrow_schema(RECORDS)), RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from its archive. A
    revisit's size is its response's."""
    folder = f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    read = materialize(read_archives(write_archives(pages, folder, least), payloads=False).filter("kind = 'record'").drop("payload"), "records")
    sizes = read.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("known_bytes"))
    revisits = read.filter("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("known_bytes")).drop("known_bytes")
    return read.filter("record_type = 'response'").unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
