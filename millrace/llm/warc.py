"""WARC archives with revisit resolution.

Three passes. Every task writes its rows as response records into archives of
bounded size (one gzip member a record) in the shared folder, and keeps only
headers: file, the record's offset and length there, id, length and SHA-1 of the
payload. The headers are
shuffled by digest to elect, among equal payloads of at least ``min_bytes``,
the one of the largest id as the original; the others are joined to it. Then
each archive is read again beside its decisions and rewritten: originals with
fresh headers, revisits as header-only records that name their original. The
payloads themselves are never shuffled.

An archive's name depends on the task's partition alone and it appears under
that name only when it is whole (written aside, then moved), so a task that
runs again replaces its archives by equal ones.

Defined cases: a null payload is empty; payloads under ``min_bytes`` are all
responses; of rows of the same id and payload the one written last is the
original, and the other revisits its id; a null id loses to any other and is
written as an empty id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, shared_dir, table, written

MIN_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


def record(kind: str, rec_id: str, uri: str, digest: str, length: int, payload: bytes | None, more: tuple = ()) -> bytes:
    """One record; digest is hex. A revisit has the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, rec_id)}>",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{b32}",
        f"X-Page-ID: {rec_id}",
        *(f"{k}: {v}" for k, v in more),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """(WARC headers, block, HTTP headers, payload), names in lower case."""

    def fields(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, block, fields(http), payload


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, read in steps, so that what follows a member is copied but once."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts, step = zlib.decompressobj(31), [], 2048
        while not d.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + step]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
            step = min(2 * step, 1 << 20)
        yield b"".join(parts)


class ArchiveWriter:
    """Archives part-PPPPPP-NNNN.warc.gz under a folder, each whole or absent."""

    def __init__(self, folder: str, prefix: str, limit: int, level: int):
        self.fs, self.folder = local_path(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.prefix, self.limit, self.level = prefix, limit, level
        self.number, self.parts, self.held, self.at = 0, [], 0, 0

    @property
    def name(self) -> str:
        return f"{self.prefix}-{self.number:04d}.warc.gz"

    def add(self, rec: bytes) -> tuple[str, int, int]:
        """(archive, offset, length) of the record's gzip member."""
        if self.parts and self.held + len(rec) > self.limit:
            self.close()
        member = zlib.compress(rec, self.level, 31)
        self.parts.append(member)
        self.held += len(rec)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    def close(self) -> None:
        if self.parts:
            aside = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(aside, compression=None) as out:
                for p in self.parts:
                    out.write(p)
            self.fs.move(aside, f"{self.folder}/{self.name}")
            self.number, self.parts, self.held, self.at = self.number + 1, [], 0, 0


def _read(folder: str, name: str) -> bytes:
    fs, path = local_path(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


HEADERS = "file string, offset long, length long, page_id long, payload_bytes long, digest string"


def write_archives(rows: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload text) as response records; returns the headers (to be written once by the caller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():06d}", limit, 1)
        for batch in batches:
            got = []
            for page, url, text in zip(*(batch.column(c) for c in ("page_id", "url", "payload")), strict=True):
                payload = text.as_buffer().to_pybytes() if text.is_valid else b""
                digest = hashlib.sha1(payload).hexdigest()
                page = page.as_py()
                uri = "".join((url.as_py() or "").split())
                place = out.add(record("response", "" if page is None else str(page), uri, digest, len(payload), payload))
                got.append((*place, page, len(payload), digest))
            cols = list(zip(*got, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["file", "offset", "length", "page_id", "payload_bytes", "digest"])
        out.close()

    return rows.select("page_id", "url", "payload").mapInArrow(run, HEADERS)


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds `original` (the response's id, null for a response) and `revisit`."""
    me = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "file", "offset")
    best = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max(me).alias("best"), F.count("*").alias("n")).where("n > 1")
    out = headers.join(best, "digest", "left")
    revisit = F.col("best").isNotNull() & ~((F.col("best.file") == F.col("file")) & (F.col("best.offset") == F.col("offset")))
    return out.select("file", "offset", "length", "page_id", revisit.alias("revisit"), F.when(revisit, F.col("best.page_id")).alias("original"), "digest")


def rewrite(decisions: DataFrame, source: str, target: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Every archive again, with revisits in place of copies; returns the new archives' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, raw, done = None, None, memoryview(b""), []
        for batch in batches:
            for file, offset, length, revisit, original in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "revisit", "original")), strict=True):
                if file != now:
                    if out:
                        out.close()
                        done += [f"{out.prefix}-{i:04d}.warc.gz" for i in range(out.number)]
                    now, raw = file, memoryview(_read(source, file))
                    out = ArchiveWriter(target, f"dedup-{file.removesuffix('.warc.gz')}", limit, 4)
                warc, _, http, payload = parse(zlib.decompress(raw[offset : offset + length], 31))
                digest = base64.b32decode(warc["warc-payload-digest"][5:]).hex()
                n, page, uri = int(http["content-length"]), warc["x-page-id"], warc["warc-target-uri"]
                if revisit:
                    to = "" if original is None else str(original)
                    more = (("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, to)}>"), ("X-Refers-To-Page-ID", to))
                    out.add(record("revisit", page, uri, digest, n, None, more))
                else:
                    out.add(record("response", page, uri, digest, n, payload))
        if out:
            out.close()
            done += [f"{out.prefix}-{i:04d}.warc.gz" for i in range(out.number)]
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    files = decisions.select("file").distinct().count()
    dealt = decisions.select("file", "offset", "length", "revisit", "original").repartition(tasks_for(decisions.sparkSession, files), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "file string")


def tasks_for(spark, files: int) -> int:
    """Tasks for so many archives: a few archives each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), files // 4)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives named in `file`; a response's payload must have its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in READ.split(",")]
        types = [pa.int64() if " long" in f else pa.string() for f in READ.split(",")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for raw in members(_read(folder, file)):
                    warc, _, http, payload = parse(raw)
                    digest = base64.b32decode(warc["warc-payload-digest"][5:]).hex()
                    kind, to, page = warc["warc-type"], warc.get("x-refers-to-page-id"), warc["x-page-id"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file}: the payload of page {page} doesn't match its digest")
                    text = payload.decode() if payloads and kind == "response" else None
                    rows.append((int(page) if page else None, warc["warc-target-uri"], int(http["content-length"]), digest, kind, int(to) if to else None, text))
                    held += len(text or "") + 200
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.repartition(tasks_for(files.sparkSession, files.count()), "file").mapInArrow(run, READ)


def deduplicate(rows: DataFrame, min_bytes: int = MIN_BYTES, limit: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Writes rows (page_id, url, payload) as deduplicated archives: their names, and the folder they are in."""
    path = shared_dir(rows.sparkSession)
    headers = written(write_archives(rows, f"{path}/raw", limit), path, "headers")
    files = written(rewrite(resolve(headers, min_bytes), f"{path}/raw", f"{path}/dedup", limit), path, "files")
    return files, f"{path}/dedup"


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    files, folder = deduplicate(pages)
    return read_archives(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, payload_bytes >= {MIN_BYTES} AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) > 1 AS again,
    max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN best END AS refers_to FROM m
"""
