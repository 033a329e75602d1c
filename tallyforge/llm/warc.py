"""WARC archives: a writer with revisit records and a reader that salvages what it can from damaged files.

The writer gives every page a gzip member of its own in files that roll at a fixed size. The reader checks each
record (version line, header end, declared length, record end, block digest). After a failed check it searches for the
next version line from which a record passes all checks, in plain files as in what a gzip member inflates to, goes on
from there, and logs the bytes between as a quarantined gap. Of a member that is cut short or fails its checksum the
records in front of the damage are kept; the search for the next member starts right after its first byte.
"""

from __future__ import annotations

import base64
import copy
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._spark import stored

ROLL_BYTES = 16 << 20
READ_BYTES = 1 << 18
#: A header or block of at most so many bytes is held while it is checked; a longer one is first read through as a stream.
HELD_BYTES = 8 << 20
#: A record's header, and its block, is a value of Spark, which can be no longer.
MOST_BYTES = 2**31 - 1
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FIELDS = [
    ("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
]
READ_SCHEMA = "kind string, path string, start long, end long, inner_start long, inner_end long, reason string, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store and the path in it that a URI (or a plain local path) names."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload: bytes) -> str:
    name = str(page_id) if page_id is not None else "payload:" + sha1_base32(payload)
    return f"<urn:uuid:{uuid.uuid5(_ID_SPACE, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record's bytes: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, payload)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, b'')}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload, of at least ``min_bytes``, an earlier page has too.

    Payloads are equal by SHA-256 and length. Groups are made from digests alone, and only those of several rows meet
    their rows again, dealt to ``SALTS`` keys each so that a hot payload is spread.
    """
    html = F.coalesce("html", F.lit(""))
    keys = stored(pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("sha"), F.octet_length(html).alias("size")), "warc-keys")
    groups = keys.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    met = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(groups, ["sha", "size", "salt"])
    return met.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", F.col("first").alias("refers_to"), "sha").distinct()


def write(pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``path``; returns the files: (path, records, bytes).

    Of rows with equal payloads the one with the smallest page_id is the response and the others revisit it. Rows
    of a partition are sorted and files named by partition, written aside and moved into place, so a task that runs
    again after a lost executor leaves the same files. A null html is an empty payload; a null url or page_id has no
    header; a page without id revisits a page with one that has its payload, else it is a response.
    """
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    named = named.withColumn("_sha", F.sha2("payload", 256))
    again = revisits(pages, min_bytes).withColumnRenamed("page_id", "_id").withColumnRenamed("sha", "_s")
    rows = named.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_s")), "left").select("page_id", "url", "payload", "refers_to")

    def save(batches):
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        task, done, open_, number = TaskContext.get(), [], None, 0

        def close():
            nonlocal open_, number
            if open_ is not None:
                open_["out"].close()
                final = f"{base}/part-{task.partitionId():06d}-{number:05d}.warc.gz"
                fs.move(open_["at"], final)
                done.append((f"{path.rstrip('/')}/{final.rpartition('/')[2]}", open_["records"], open_["bytes"]))
                open_, number = None, number + 1

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py())) + packer.flush()
                if open_ is None:
                    at = f"{base}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
                    open_ = {"at": at, "out": fs.open_output_stream(at, compression=None), "records": 0, "bytes": 0}
                open_["out"].write(member)
                open_["records"] += 1
                open_["bytes"] += len(member)
                if open_["bytes"] >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return stored(rows.sortWithinPartitions("page_id", "url", "payload").mapInArrow(save, "path string, records long, bytes long"), "warc-files")


class _Bytes:
    """A file read through a window, so that no file is held whole."""

    def __init__(self, handle):
        self.handle, self.size, self.at, self.window = handle, handle.size(), 0, b""
        self.stop, self.total = None, self.size

    def ahead(self) -> _Bytes:
        """The same bytes, to read farther on without moving this window."""
        return _Bytes(self.handle)

    def ending(self, start: int) -> bytes:
        """The four bytes from ``start`` on, without moving the window."""
        if self.at <= start and start + 4 <= self.at + len(self.window):
            return self.get(start, 4)
        return self.handle.read_at(max(0, min(4, self.size - start)), start) if start < self.size else b""

    def let_go(self, start: int) -> None:
        """Nothing is held before the window in any case."""

    def get(self, start: int, n: int) -> bytes:
        """``n`` bytes, or fewer where the file ends."""
        n = min(n, self.size - start)
        if n <= 0:
            return b""
        if start < self.at or start + n > self.at + len(self.window):
            self.at, self.window = start, self.handle.read_at(max(n, READ_BYTES), start)
        return self.window[start - self.at : start - self.at + n]


class _Inflated:
    """What the gzip member at ``start`` inflates to, made step by step; bytes before ``floor`` are let go.

    It ends at ``size`` once that is known: at the member's end, or where its bytes stop to be sound (``fault``).
    """

    def __init__(self, data: _Bytes, start: int):
        self.data, self.end = data, start  # end: how far the file was read
        self.machine, self.tail = zlib.decompressobj(31), b""
        self.at, self.window, self.floor = 0, bytearray(), 0
        self.size, self.fault = None, None
        self.stop, self.total = None, None  # where a header ended last, and the size once a reader farther on has found it

    def ahead(self) -> _Inflated:
        """The same bytes, to inflate farther on while this window stays."""
        other = copy.copy(self)
        other.data, other.machine, other.window = _Bytes(self.data.handle), self.machine.copy(), bytearray(self.window)
        return other

    def ending(self, start: int) -> bytes:
        return self.get(start, 4)

    def let_go(self, start: int) -> None:
        self.floor = start

    def _step(self) -> None:
        piece = self.tail or self.data.get(self.end, 1 << 14)
        fresh = not self.tail
        if not piece:
            self.fault = "member is cut short"
        else:
            before = self.machine.copy()
            try:
                self.window += self.machine.decompress(piece, READ_BYTES)
                self.end += len(piece) if fresh else 0
                self.tail = self.machine.unconsumed_tail
            except zlib.error:
                self.fault = "member checksum or coding fails"
                for i in range(len(piece)):  # what comes before the damage
                    try:
                        self.window += before.decompress(piece[i : i + 1])
                    except zlib.error:
                        break
        if self.fault:
            self.size = self.at + len(self.window)
        elif self.machine.eof:
            self.end -= len(self.machine.unused_data)
            self.size = self.at + len(self.window)
        if self.floor - self.at > READ_BYTES:
            del self.window[: self.floor - self.at]
            self.at = self.floor

    def get(self, start: int, n: int) -> bytes:
        while self.size is None and self.at + len(self.window) < start + n:
            self._step()
        return bytes(self.window[start - self.at : start - self.at + n])


def _find(source, what: bytes, start: int) -> int | None:
    """Where ``what`` next begins, if anywhere."""
    size = 1 << 10
    while True:
        part = source.get(start, size)
        if (found := part.find(what)) >= 0:
            return start + found
        if len(part) < size:
            return None
        start, size = start + len(part) - len(what) + 1, min(4 * size, READ_BYTES)
        source.let_go(start)


class Damaged(ValueError):
    pass


def _digest(header: str):
    """(a new hash, its value as the header algorithm:value has it, base32 or hex); None if it cannot be told."""
    algorithm, _, value = header.partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return None
    return hashlib.new(algorithm.lower()), value.strip().rstrip("=").upper()


def _header_end(source, start: int) -> int | None:
    """Where the header that begins at ``start`` ends, if anywhere; a place once found serves every start before it."""
    if source.stop and source.stop[0] <= start and (source.stop[1] is None or start <= source.stop[1]):
        return source.stop[1]
    size, end = 1 << 10, b"\r\n\r\n"
    while (found := (head := source.get(start, size)).find(end)) < 0 and len(head) == size and size < HELD_BYTES:
        size *= 2
    stop = start + found if found >= 0 else None
    if stop is None and len(head) == size:
        stop = _find(source.ahead(), end, start + size - len(end) + 1)
    source.stop = start, stop
    return stop


def _streamed(source, at: int, n: int, digest: str) -> None:
    """Damaged if a long block fails its checks, of which no more than a piece is held."""
    ahead, left, told = source.ahead(), n, _digest(digest)
    while left:
        piece = ahead.get(at + n - left, min(left, READ_BYTES))
        if not piece:
            source.total = ahead.size
            raise Damaged("record is cut short")
        if told:
            told[0].update(piece)
        left -= len(piece)
        ahead.let_go(at + n - left)
    _ended(ahead.get(at + n, 4))
    if told and told[1] not in _forms(told[0]):
        raise Damaged("block digest differs")


def _ended(end: bytes) -> None:
    if len(end) < 4:
        raise Damaged("record is cut short")
    if end != b"\r\n\r\n":
        raise Damaged("record does not end where it says")


def _forms(made) -> tuple[str, str]:
    return base64.b32encode(made.digest()).decode().rstrip("="), made.hexdigest().upper()


def _parsed(source, start: int, sound) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``start``; Damaged if a check fails.

    A claimed length is believed only as far as the record's last four bytes, and, where it is long, its digest, bear it
    out; the block is held afterwards. ``sound`` tells whether the bytes passed a checksum of their own, which a record
    without a digest needs.
    """
    if not source.get(start, len(_VERSION)) == _VERSION:
        raise Damaged("no version line")
    stop = _header_end(source, start)
    if stop is None or stop - start > MOST_BYTES:
        raise Damaged("header does not end")
    headers = {}
    for line in source.get(start, stop - start).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.strip().lower()] = value.strip()
    length, digest = headers.get("content-length", ""), headers.get("warc-block-digest", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    at, n = stop + 4, int(length)
    if n > MOST_BYTES:
        raise Damaged("block is longer than a value can be")
    if source.total is not None and at + n + 4 > source.total:
        raise Damaged("record is cut short")
    if n > HELD_BYTES:
        _streamed(source, at, n, digest)
    else:
        _ended(source.ending(at + n))
    block = source.get(at, n)
    told = _digest(digest)
    if told and n <= HELD_BYTES:
        told[0].update(block)
        if told[1] not in _forms(told[0]):
            raise Damaged("block digest differs")
    if not told and not sound():
        raise Damaged("no digest, in a damaged member")
    return headers, block, at + n + 4


def _records(source, sound) -> Iterator[tuple]:
    """('record', start, end, headers, block) and ('gap', start, end, reason, None) of all bytes of ``source``, in order."""
    at, gap, reason = 0, None, ""
    while source.get(at, 1):
        try:
            headers, block, end = _parsed(source, at, sound)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            found = _find(source, _VERSION, at + 1)
            if found is None:
                break
            at = found
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        yield "record", at, end, headers, block
        at = end
        source.let_go(at)
    if gap is not None:
        yield "gap", gap, source.size, reason, None


def _sound(data: _Bytes, start: int) -> bool:
    member = _Inflated(data, start)
    while member.size is None:
        member._step()
        member.floor = member.at + len(member.window)
    return member.fault is None


def salvage(handle, zipped: bool) -> Iterator[tuple]:
    """(kind, start, end, inner_start, inner_end, headers or reason, block) of a file, in its order.

    Kind is 'record' or 'gap'. In a plain file records and gaps, from start to end, tile it. In a gzip file start is that
    of a member and inner places count what it inflates to: a member's records and inner gaps, which have no end,
    tile that. Gaps with an end tile the file together with the members that inflate to their ends; the gap of a damaged
    member reaches to the next place that gives anything, its inner places from its last record to where inflating
    stopped. Records inside of a damaged record's payload are taken for records.
    """
    data = _Bytes(handle)
    if not zipped:
        for kind, start, end, what, block in _records(data, lambda: True):
            yield kind, start, end, None, None, what, block
        return
    at, gap = 0, None
    while at < data.size:
        if data.get(at, len(_MEMBER)) == _MEMBER:
            member, rest = _Inflated(data, at), 0
            for kind, start, end, what, block in _records(member, functools.cache(functools.partial(_sound, data, at))):
                if kind == "gap" and member.fault and end == member.size:
                    break
                if gap is not None:
                    yield "gap", gap[0], at, *gap[1:], None
                    gap = None
                yield kind, at, None, start, end, what, block
                rest = end
            if member.fault is None:
                if gap is not None:
                    yield "gap", gap[0], at, *gap[1:], None
                    gap = None
                at = member.end
                continue
            if gap is None:
                gap = at, rest, member.size, member.fault
        elif gap is None:
            gap = at, None, None, "no gzip member"
        following = _find(data, _MEMBER, at + 1)
        at = data.size if following is None else following
    if gap is not None:
        yield "gap", gap[0], data.size, *gap[1:], None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _row(path: str, found: tuple, payloads: bool) -> tuple:
    kind, start, end, inner_start, inner_end, what, block = found
    if kind == "gap":
        return kind, path, start, end, inner_start, inner_end, what, *[None] * 8
    http, split, body = block.partition(b"\r\n\r\n")
    payload = body if split and http.startswith(b"HTTP/") else block
    size, digest = len(payload), sha1_base32(payload)
    if what.get("warc-type") == "revisit":
        lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if lengths and lengths[0].isdigit() else None
        digest, payload = what.get("warc-payload-digest", "").rpartition(":")[2] or None, None
    return (kind, path, start, end, inner_start, inner_end, None, what.get("warc-type"), what.get("warc-record-id"), what.get("warc-target-uri"), _number(what.get("x-page-id")), _number(what.get("x-refers-to-page-id")), size, digest, payload if payloads else None)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives under ``path``: rows of kind 'record' or 'gap', as :func:`salvage` gives them.

    Files ending in .gz are read by member, others as plain archives. A task takes as many files as Spark's readers
    put together and holds one record at a time. An empty file, or a folder without files, gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def load(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, at = file_system(name)
                rows = []
                with fs.open_input_file(at) as handle:
                    for found in salvage(handle, at.endswith(".gz")):
                        rows.append(_row(name, found, payloads))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(load, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS)], [n for n, _ in FIELDS])


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, min(page_id) AS first FROM p GROUP BY t),
h AS (SELECT p.page_id, strlen(p.t)::BIGINT AS payload_bytes, sha1(p.t) AS s, g.first FROM p JOIN g ON p.t = g.t)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
