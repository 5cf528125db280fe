"""WARC archives: a writer of per-record gzip members and a splittable reader.

The reader's tasks each own a byte range of an archive: a task looks for the gzip magic from
the start of its range, takes a candidate as a member only if it decodes to a WARC header with
a content length, and owns the records that start inside its range (the last may end beyond).
Archives are read and written through Arrow's file systems, so any store that both the
driver and the executors reach will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LARGE, fresh, marked_by, pick, written

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
SPLIT_BYTES = 8 << 20
#: Ranges are dealt to at most so many tasks; each may then read several.
MAX_TASKS = 100_000
MANIFEST = "path string, bytes long, records long"
RECORD = "path string, start long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(page_id, url, payload: bytes, refers_to, when: str, level: int) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of its payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{_digest(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, revisit_min_bytes: int = 0, when: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the manifest.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least
    revisit_min_bytes bytes, that with the smallest page_id is a response and the others are
    revisits of it; rows that share the smallest page_id are all responses. A null page_id is a revisit of
    the others, and a response if all are null. Each attempt of a task writes an archive of its own, and the manifest, which Spark
    commits, names those of the attempts that succeeded: a repeated or late attempt changes nothing that is read. Only payloads that
    may repeat travel. An empty table gives no archive.
    """
    rows = pick(pages, page_id="long", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.filter(F.length("payload") >= revisit_min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = written(first.filter("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("id"), "first_id"), "warc-repeats", LARGE)
    marked = marked_by(rows, F.col("digest"), first.select("id"))
    some = marked.filter("_may").join(first, F.col("digest") == F.col("id"), "left")
    some = some.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id").cast("string")))
    others = marked.filter("NOT _may").withColumn("refers_to", F.lit(None).cast("string"))
    marked = others.select("page_id", "url", "payload", "refers_to").unionByName(some.select("page_id", "url", "payload", "refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        store, path = _opened(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        size = n = 0
        out = None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                member = _member(None if page_id is None else int(page_id), url, payload, refers_to, when, level)
                out = out or store.open_output_stream(path, compression=None)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "bytes": [size], "records": [n]})

    # doubles can't hold every long, so page_id goes to pandas as text
    return written(marked.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(write, MANIFEST), "warc-manifest")


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC header and where its block begins; None if it isn't one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


class _Bytes:
    """Forward reads of a file, a block at a time, with a view from a given place."""

    def __init__(self, uri: str):
        store, path = _opened(uri)
        self.file = store.open_input_file(path)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def view(self, start: int, most: int) -> bytes:
        """The bytes from start, so many unless the file ends."""
        if not self.at <= start <= self.at + len(self.held):
            self.at, self.held = start, b""
        if start - self.at > BLOCK:
            self.held, self.at = self.held[start - self.at :], start
        while len(self.held) - (start - self.at) < most and self.at + len(self.held) < self.size:
            self.held += self.file.read_at(min(BLOCK, self.size - self.at - len(self.held)), self.at + len(self.held))
        return self.held[start - self.at : start - self.at + most]


def _decoded(src: _Bytes, start: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at start and the place after it; None if there is none."""
    z, out, at, most = zlib.decompressobj(31), b"", start, 4096
    parts = []
    try:
        while not z.eof:
            piece = src.view(at, most)
            if not piece:
                return None
            parts.append(z.decompress(piece))
            if len(out) < 7:
                out += parts[-1][:7]
                if not b"WARC/1."[: len(out)] == out[:7]:
                    return None
            at += len(piece) - len(z.unused_data)
            most = min(2 * most, BLOCK)
    except zlib.error:
        return None
    return b"".join(parts), at


def _records(src: _Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records that start in [start, end)."""
    at = start
    while at < min(end, src.size):
        if src.view(at, 3) != MAGIC:
            seen = src.view(at, BLOCK)
            found = seen.find(MAGIC, 1)
            at += found if found > 0 else max(1, len(seen) - 2)
            continue
        member = _decoded(src, at)
        head = member and _header(member[0])
        if not head or len(member[0]) < head[1] + int(head[0]["content-length"]):
            at += 1
            continue
        fields, begins = head
        yield at, fields, member[0][begins : begins + int(fields["content-length"])]
        at = member[1]


def _id(urn: str | None) -> str | None:
    return urn.strip("<>") if urn else None


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives (path, bytes) of a manifest, each once, in columns RECORD.

    Archives are cut into ranges of split_bytes. A revisit's payload is null and its size and
    digest are those its headers state; other payloads' are taken from the bytes read.
    """
    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                rows, held = [], 0
                for at, head, block in _records(_Bytes(path), int(start), int(start) + split_bytes):
                    http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
                    if head.get("warc-type") == "revisit":
                        size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        digest, payload = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                    else:
                        size, digest = len(payload), _digest(payload)
                    rows.append((path, at, _id(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), _id(head.get("warc-refers-to")), size, digest, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS)

    # a stated number of tasks isn't merged by adaptive execution, which sees only the few bytes that name a range
    return ranges.repartition(max(1, min(ranges.count(), MAX_TASKS))).mapInPandas(read, RECORD)


_COLUMNS = [x.split()[0] for x in RECORD.split(", ")]


def page_records(spark: SparkSession, pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages as archives, reads them back: one row for each page.

    Null pages are empty, null and repeated page_ids are records of their own; an empty table has none.
    """
    records = read_archives(write_archives(pages, fresh(spark, "warc")), split_bytes)
    as_id = lambda c: F.expr(f"try_cast(substring({c}, 10) AS long)")  # noqa: E731  after urn:page:
    return records.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))


#: The contract of page_records over all pages, for a check by SQL: digests in base 32 are five bits of SHA-1 after five.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')"
SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""
