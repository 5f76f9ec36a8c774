"""WARC archives: a writer with revisit records and a splittable reader.

Writing: each task writes its rows as gzip members, one per record, to files of its own in a shared folder
(any that ``pyarrow.fs`` opens). File names hold the task attempt, and what the write returns, a manifest
checkpointed once, names the files of the attempts that count; a lost executor leaves stray files, never
wrong ones. Payloads meet by digest without their bytes; a digest in a third of all rows is one partial
maximum per task and an equi-join that adaptive execution may split.

Reading: files are cut into byte ranges, and ranges are the unit of work. A task scans its range for the gzip
magic, takes a candidate only if it inflates to a WARC header with type, id and length, and owns the records that
start inside its range; it reads the last one past the end. After a record the next one starts where its member
ended, so bytes inside a record are never searched once a range is in step. Memory holds one record.

Null payloads are empty. Records are ``response``, or ``revisit`` when an equal payload of at least
``min_revisit_bytes`` has a larger id; a row without an id is never referred to unless no row has one, rows
that tie in both are all responses. Line breaks in addresses are escaped. A last member that is cut off, and
bytes between members, give no record. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm.common import small_batches
from ticklens.session import cut_lineage

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
MAX_TASKS = 20_000
RECORD_SCHEMA = (
    "path string, offset long, record_type string, record_id string, target_uri string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary, digest_ok boolean"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def id_in(urn_column: str) -> Column:
    """The id in a record id of ``urn``; null if it has none."""
    found = F.regexp_extract(F.col(urn_column), r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, not yet compressed. A revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {urn(refers_to)}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def opened(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def with_revisits(pages: DataFrame, page_id: str, html: str, min_revisit_bytes: int) -> DataFrame:
    """(id, payload, digest, refers_to, revisit) and the address of every row."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = rows.filter(F.octet_length("payload") >= min_revisit_bytes).select("id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    again = narrow.join(groups, "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return rows.join(again, same, "left").select("id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = 0,
    max_file_bytes: int = 1 << 30,
    level: int = 6,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the archives and returns their manifest (path, length, records)."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out, size, n, k = None, 0, 0, 0
        name = lambda: f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.warc.gz"
        files: list[tuple[str, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(*row, date)) + packer.flush()
                if out is None:
                    out, size, n = fs.open_output_stream(f"{base}/{name()}", compression=None), 0, 0
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= max_file_bytes:
                    out.close()
                    files.append((f"{folder}/{name()}", size, n))
                    out, k = None, k + 1
        if out is not None:
            out.close()
            files.append((f"{folder}/{name()}", size, n))
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in files], t) for c, t in enumerate(kinds)], ["path", "length", "records"])  # noqa: E501

    small_batches(pages.sparkSession)
    rows = with_revisits(pages.select(page_id, F.col(url).cast("string").alias("url"), html), page_id, html, min_revisit_bytes)
    return cut_lineage(rows.mapInArrow(run, "path string, length long, records long"))


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of archives that a pattern names, as Spark lists them; their bytes are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


class _Window:
    """Reads at any place of a file through one buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, pos: int, least: int = 1) -> memoryview:
        """What the buffer holds from ``pos`` on: ``least`` bytes, unless the file ends."""
        if not self.start <= pos <= self.start + len(self.data) - least:
            n = min(max(CHUNK, least), max(0, self.size - pos))
            self.start, self.data = pos, bytes(self.file.read_at(n, pos)) if n else b""
        return memoryview(self.data)[pos - self.start :]


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _candidate(window: _Window, pos: int) -> bool:
    """Whether the bytes at ``pos`` inflate to a WARC header, of any length, with type, id and length."""
    inflate, head, seen = zlib.decompressobj(31), bytearray(), 0
    try:
        while head.find(b"\r\n\r\n", max(0, seen - 3)) < 0 and not inflate.eof:
            piece = window.at(pos)
            if not piece:
                return False
            seen = len(head)
            head += inflate.decompress(piece[:4096])
            pos += min(len(piece), 4096)
            if not b"WARC/".startswith(head[:5]):
                return False
    except zlib.error:
        return False
    head, found, _ = bytes(head).partition(b"\r\n\r\n")
    h = _headers(head)
    return bool(found) and {"warc-type", "warc-record-id"} <= h.keys() and h.get("content-length", "").isdigit()


def _member(window: _Window, pos: int) -> tuple[bytes, int] | None:
    """(inflated bytes, end) of the member at ``pos``; none if it is cut off or broken."""
    inflate, parts = zlib.decompressobj(31), []
    try:
        while not inflate.eof:
            piece = window.at(pos)
            if not piece:
                return None
            parts.append(inflate.decompress(piece))
            pos += len(piece)
    except zlib.error:
        return None
    return b"".join(parts), pos - len(inflate.unused_data)


def _parsed(path: str, offset: int, data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    kind, payload, size = h["warc-type"], block, len(block)
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = _headers(http).get("content-length", "")
        size = int(stated) if kind == "revisit" and stated.isdigit() else len(payload)
    digest, ok = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    if kind == "revisit":
        payload = None
    else:
        found = base32_sha1(payload)
        ok = digest is None or digest == found
        digest = digest or found
    return path, offset, kind, h["warc-record-id"], h.get("warc-target-uri"), digest, h.get("warc-refers-to"), size, payload, ok


def records_in(file, path: str, size: int, start: int, end: int) -> Iterator[tuple]:
    """The records whose members start in ``start`` … ``end`` (exclusive)."""
    window, pos = _Window(file, size), start
    while pos < end:
        piece = window.at(pos, len(MAGIC))
        if piece[: len(MAGIC)] != MAGIC:
            at = bytes(piece).find(MAGIC)
            pos += at if at >= 0 else max(1, len(piece) - len(MAGIC) + 1)
            continue
        found = _member(window, pos) if _candidate(window, pos) else None
        if found is None:
            pos += 1
            continue
        yield _parsed(path, pos, found[0])
        pos = found[1]


def complete(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``found``, written once; an error if it has not as many records as the manifest."""
    found = cut_lineage(found)
    n, want = found.count(), manifest.agg(F.sum("records")).first()[0] or 0
    if n != want:
        raise RuntimeError(f"{n} records read, {want} written")
    return found


def read(files: DataFrame, range_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (path, length); see ``RECORD_SCHEMA``.

    Without ``payloads`` they are read and compared with their digests, but not handed on.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    text, num = pa.string(), pa.int64()
    kinds = (text, num, text, text, text, text, text, num, pa.binary(), pa.bool_())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = opened(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for r in records_in(file, path, size, start, min(size, start + range_bytes)):
                        if not payloads:
                            r = (*r[:8], None, r[9])
                        rows.append(r)
                        held += len(r[8] or b"")
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    files = files.filter(F.col("length") > 0)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", start.alias("start"))
    # Ranges are few bytes but much work: their number sets the tasks, not their size.
    return ranges.repartition(max(1, min(ranges.count(), MAX_TASKS))).mapInArrow(run, RECORD_SCHEMA)
