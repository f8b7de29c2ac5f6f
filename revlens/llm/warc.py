"""WARC archives written and read through an index.

Writing: every task streams its pages into gzip-per-record archives in the
shared folder and yields one index row a record (archive, offset, length, url,
digest, ...); the index is stored as Parquet. An archive's name is unique to
the task attempt, so a retried task leaves at most a file that no index row
names. Reading goes through the index only: selected records are sorted by
archive and offset, near ones are coalesced into one byte-range read of at most
`Config.range_bytes`, and each record is parsed and verified from its range.

Of records with equal payloads of at least `Config.revisit_bytes` bytes, that
with the largest page_id is the response, the others are revisits without a
payload that refer to it.

Files are opened with `pyarrow.fs`, by the shared folder's URI.

Defined results: a null html is an empty payload; a null url is left out of the
record; line breaks in a url are written percent-encoded; repeated rows are a
record each (rows that share the largest page_id are all responses); a null
page_id is smaller than any other and, if it is a group's only one, all its
rows are responses; a very long html is one record, held whole while it is
written or read; extra columns are ignored; empty tables give an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import record_batch, utf8
from revlens.session import materialize, scratch_path

#: WARC profile of a revisit (fixed value).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


@dataclass(frozen=True)
class Config:
    revisit_bytes: int = 1000  # payloads under this are always stored
    archive_bytes: int = 256 << 20  # a task starts a new archive beyond this
    range_bytes: int = 4 << 20  # most bytes of a coalesced read (a larger record is read alone)
    gap_bytes: int = 64 << 10  # unselected bytes that a coalesced read may pass over
    date: str = "2024-01-01T00:00:00Z"
    level: int = 1  # gzip level


def duplicate_groups(pages: DataFrame, cfg: Config) -> DataFrame:
    """digest and largest page_id of payloads that occur twice or more."""
    rows = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.where(F.length("payload") >= cfg.revisit_bytes).select(F.sha1("payload").alias("digest"), "page_id")
    return rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")


def with_record_types(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses). The groups
    are stored first, so that Spark joins by their measured size: a small table
    is sent to the pages, a large one is shuffled with skewed digests split."""
    groups = materialize(duplicate_groups(pages, cfg), "warc-groups").withColumnRenamed("digest", "d")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.join(groups, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, cfg: Config) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {cfg.date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return utf8("\r\n".join(head)) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(raw: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    """(page_id, url, payload length, hex digest, type, refers_to, payload) of a
    record; a response whose payload does not match its digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda v: int(v.removeprefix("<urn:x-page:").removesuffix(">") or -1) if v and v != "<urn:x-page:>" else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("WARC-Refers-To")), payload


def write_archives(pages: DataFrame, folder: str, cfg: Config = Config()) -> DataFrame:
    """Writes archives under `folder`/archives and the index under
    `folder`/index; returns the stored index."""
    archives = f"{folder}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(archives)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    if out is None or at >= cfg.archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip_member(record_bytes(page_id, url, payload, digest, refers_to, cfg), cfg.level)
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                    at += len(member)
                yield record_batch(dict(zip(_INDEX.names, map(list, zip(*rows)) if rows else [[]] * 7)), _INDEX)
        finally:
            if out is not None:
                out.close()

    index = with_record_types(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), cfg).mapInArrow(write, INDEX_SCHEMA)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, cfg: Config = Config(), payloads: bool = True) -> DataFrame:
    """The records that the index rows name (RECORD_SCHEMA), by coalesced
    byte-range reads. Without `payloads` the payload column is null."""
    archives = f"{folder}/archives"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(archives)
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            k = 0
            while k < len(rows):
                archive, start, size = rows[k]
                end, last = start + size, k + 1
                while last < len(rows) and rows[last][0] == archive and rows[last][1] - end <= cfg.gap_bytes and rows[last][1] + rows[last][2] - start <= cfg.range_bytes:
                    end = max(end, rows[last][1] + rows[last][2])
                    last += 1
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{base}/{archive}")
                data = file.read_at(end - start, start)
                found = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in rows[k:last]]
                if not payloads:
                    found = [(*x[:6], None) for x in found]
                yield record_batch(dict(zip(_RECORD.names, map(list, zip(*found)))), _RECORD)
                k = last
        if file is not None:
            file.close()

    block = F.floor(F.col("offset") / (8 * cfg.range_bytes))
    placed = index.select("archive", "offset", "length", block.alias("block")).repartition("archive", "block").sortWithinPartitions("archive", "offset")
    return placed.select("archive", "offset", "length").mapInArrow(read, RECORD_SCHEMA)


def write_and_read(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Archives of all pages in a new shared folder, read back through the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, cfg), folder, cfg, payloads=False)


#: The records of `pages` in DuckDB's SQL.
WARC_SQL = """
WITH own AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), hashed AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM own
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM grouped
"""
