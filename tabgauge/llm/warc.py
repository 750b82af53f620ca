"""WARC archives with a two-level capture index.

Captures are dealt out by ranges of (URL key, page id), where the key has the host's
labels reversed, and sorted. Each task writes one archive of gzip members, a record each,
and beside it an index: lines of (key, page id, offset, length) in compressed blocks,
then a sparse directory with the first entry of each block, then a footer. What leaves
the task is one row per part: its files and its first and last entry.

A look-up finds the part by binary search over the parts (as many as write tasks, so
small enough to broadcast), reads that part's directory, finds the block by binary
search, reads the block and then the records by byte range. Sorted look-ups hit the same
block again and again, and neighbouring records come in one read.

Of records with equal payloads of ``MIN_REVISIT_BYTES`` or more, the one with the largest
page id is written as response and the others as revisits that refer to it.

Files go through Arrow's file systems to the shared folder, under names of their own for
each attempt; only parts that a finished task reports are ever read.

Defined results: null html is an empty payload; a null URL has the empty key; a null page
id sorts first and never is the largest; repeated pages give a record each, all of them
responses if their page id is the largest of their payload. Other columns are not written.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MIN_REVISIT_BYTES = 1000
#: Captures in one compressed block of the index.
BLOCK_LINES = 500
#: An archive is closed and a new part begun beyond this size.
ARCHIVE_BYTES = 1 << 30
#: Bytes that one range read takes at least, for the records after the wanted one.
READ_AHEAD = 1 << 18
#: Archive bytes, about, that one task of a look-up reads.
TASK_BYTES = 64 << 20
CAPTURED_AT = "1970-01-01T00:00:00Z"

_NO_ID = -(1 << 63) - 1
_FOOTER = struct.Struct("<QQ8s")
_MAGIC = b"IDXBLOCK"


def url_key(url):
    """Reversed-host key of a URL column: ``org,example,www)/path?query``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    reversed_host = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^[^@]*@|:\d*$", ""), r"\.")), ",")
    return F.when(url == "", "").otherwise(F.concat(reversed_host, F.lit(")"), path))


def _headers(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, refers: bool) -> bytes:
    """One WARC record, as a gzip member."""
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", CAPTURED_AT),
        ("WARC-Target-URI", url.translate({10: "%0A", 13: "%0D"})),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_headers(fields, "WARC/1.1") + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """Fields and payload of a record's gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    answer = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"fields": fields, "http": answer, "payload": payload}


class _Part:
    """One archive and its index, being written."""

    def __init__(self, folder: str) -> None:
        self.files, base = shared.filesystem(folder)
        self.files.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.archive, self.index = f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx"
        self.warc = self.files.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
        self.idx = self.files.open_output_stream(f"{base}/{name}.idx", compression=None)
        self.at = self.idx_at = 0
        self.lines: list[list] = []
        self.directory: list[list] = []
        self.first = self.last = None

    def add(self, key: str, page_id: int | None, record: bytes) -> None:
        self.last = [key, page_id]
        self.first = self.first or self.last
        self.lines.append([key, page_id, self.at, len(record)])
        self.warc.write(record)
        self.at += len(record)
        if len(self.lines) >= BLOCK_LINES:
            self._block()

    def _block(self) -> None:
        if self.lines:
            packed = zlib.compress(json.dumps(self.lines).encode())
            self.idx.write(packed)
            self.directory.append([*self.lines[0][:2], self.idx_at, len(packed)])
            self.idx_at += len(packed)
            self.lines = []

    def close(self) -> dict:
        self._block()
        packed = zlib.compress(json.dumps(self.directory).encode())
        self.idx.write(packed)
        self.idx.write(_FOOTER.pack(self.idx_at, len(packed), _MAGIC))
        self.idx.close()
        self.warc.close()
        return {
            "archive": self.archive, "index": self.index, "first_key": self.first[0], "first_id": self.first[1],
            "last_key": self.last[0], "last_id": self.last[1], "directory_at": self.idx_at, "directory_bytes": len(packed),
            "archive_bytes": self.at,
        }


_PARTS = "archive string, index string, first_key string, first_id bigint, last_key string, last_id bigint, directory_at bigint, directory_bytes bigint, archive_bytes bigint"


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, url_key, html, digest, refers_to``; the last is null for responses."""
    read = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    digest = F.sha1(F.col("html").cast("binary"))
    # Only payloads that occur again are joined; each comes with one page id.
    again = (
        read.filter(F.octet_length("html") >= MIN_REVISIT_BYTES)
        .groupBy(digest.alias("digest"))
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    again = shared.written(again, "payloads")
    marked = read.withColumn("digest", digest).withColumn("url_key", url_key(F.col("url"))).join(again, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return marked.withColumn("refers_to", refers).drop("largest")


def write(found: DataFrame, folder: str) -> DataFrame:
    """Write archives and indexes of ``captures``; one row per part."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            for row in batch.to_pylist() if batch.num_rows < 256 else (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
                part = part or _Part(folder)
                refers = row["refers_to"] is not None
                record = _record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"], refers)
                part.add(row["url_key"], row["page_id"], record)
                if part.at >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist([part.close()])
                    part = None
        if part:
            yield pa.RecordBatch.from_pylist([part.close()])

    order = ("url_key", "page_id")
    return shared.written(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(save, _PARTS), "parts")


class RangeReader:
    """Byte ranges of a file, with the last stretch kept."""

    def __init__(self, uri: str, ahead: int = READ_AHEAD) -> None:
        files, path = shared.filesystem(uri)
        self.file, self.ahead = files.open_input_file(path), ahead
        self.at, self.data = 0, b""

    def read(self, offset: int, length: int) -> bytes:
        if not self.at <= offset or offset + length > self.at + len(self.data):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(length, self.ahead))
        return self.data[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        self.file.close()


def _entry(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Order of the index: as Spark sorts text and ids, nulls first."""
    return key.encode(), _NO_ID if page_id is None else page_id


class Index:
    """Look-ups in the parts; keeps the part, directory and block of the last one open."""

    def __init__(self, parts: list[dict]) -> None:
        self.parts = sorted(parts, key=lambda p: _entry(p["first_key"], p["first_id"]))
        self.ends = [_entry(p["last_key"], p["last_id"]) for p in self.parts]
        self.part = self.block = None

    def _open(self, i: int) -> None:
        if self.part != i:
            if self.part is not None:
                self.idx.close()
                self.warc.close()
            own = self.parts[i]
            self.idx, self.warc = RangeReader(own["index"], 0), RangeReader(own["archive"])
            self.directory = json.loads(zlib.decompress(self.idx.read(own["directory_at"], own["directory_bytes"])))
            self.firsts = [_entry(*d[:2]) for d in self.directory]
            self.part, self.block = i, None

    def _lines(self, b: int) -> list[list]:
        if self.block != b:
            _, _, at, size = self.directory[b]
            self.lines = json.loads(zlib.decompress(self.idx.read(at, size)))
            self.entries = [_entry(*x[:2]) for x in self.lines]
            self.block = b
        return self.lines

    def find(self, key: str, page_id: int | None) -> Iterator[bytes]:
        """All records of a capture, in the order of the index."""
        wanted = _entry(key, page_id)
        i = bisect.bisect_left(self.ends, wanted)
        while i < len(self.parts) and _entry(self.parts[i]["first_key"], self.parts[i]["first_id"]) <= wanted:
            self._open(i)
            b = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
            while b < len(self.directory) and self.firsts[b] <= wanted:
                lines = self._lines(b)
                for at in range(bisect.bisect_left(self.entries, wanted), bisect.bisect_right(self.entries, wanted)):
                    yield self.warc.read(*lines[at][2:])
                b += 1
            i += 1


def look_up(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """Records of the captures in ``wanted`` (``url_key``, ``page_id``), each pair looked up once.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``.
    """
    spark = wanted.sparkSession
    # One row per write task of about a shuffle partition each.
    known = [row.asDict() for row in parts.collect()]
    sent = spark.sparkContext.broadcast(known)
    # Keys say nothing about the work: tasks follow the bytes of the archives.
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(p["archive_bytes"] for p in known) // TASK_BYTES))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                rows += map(_digest, index.find(key, page_id))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    order = ("url_key", "page_id")
    pairs = wanted.select(*order).distinct()
    return pairs.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(read, schema)


_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _page(urn: str) -> int | None:
    page = urn[len("<urn:page:") : -1]
    return None if page == "None" else int(page)


def _digest(member: bytes) -> dict:
    record = parse(member)
    fields, payload = record["fields"], record["payload"]
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(record["http"]["Content-Length"])
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stated,
        "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "url": fields.get("WARC-Target-URI", ""),
    }


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``, archived and read back through the index."""
    pages = shared.table(spark, sf_dir, "pages")
    parts = write(captures(pages), shared.new_folder(spark, "warc"))
    wanted = pages.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("bigint").alias("page_id"))
    return look_up(wanted, parts)


ORACLE_SQL = f"""
with p as (
  select page_id, coalesce(url, '') as url, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
largest as (select payload_digest, max(page_id) as largest from p where payload_bytes >= {MIN_REVISIT_BYTES} group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id is distinct from largest and largest is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from largest then largest end as refers_to, url
from p left join largest using (payload_digest)
"""
