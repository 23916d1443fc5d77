"""WARC archives with a two-level capture index.

Archives: one gzip member per record, files rolled at ``ARCHIVE_BYTES``.  Of records with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the smallest page_id is a response; the others are revisits that name it and carry
no payload.

Index: captures are sorted by (reversed-host URL key, page_id) into range parts.  Each part is one file of compressed
blocks of ``BLOCK_ENTRIES`` sorted lines, followed by its sparse directory: first entry, offset and length of each block.
A look-up finds the part by its first entry, the block by binary search in the directory, reads that range, and
finds the lines by binary search in the block.  The lines give file, offset and length of the record for a range read.

Tasks write whole files under names of their own to the shared folder and return what they wrote; a repeated task
writes other files, and only those of the attempt whose rows were kept are ever referred to.

Null html is an empty payload, null url has the key ``-``.  A null page_id is written as such, is never referred to, and
is a response unless an equal payload has an id.  Rows that repeat the smallest page_id are responses each.  Extra columns are
ignored; an empty table gives no archives, an empty index and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_root, cut
from .common import join_hot, map_arrow, table
from .urlfilter import host_of, path_of

ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 100
BLOCK_ENTRIES = 512
PART_ENTRIES = 200_000
READ_AHEAD = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder all executors share: a path or a URI that Arrow knows (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        uri = re.sub("^file:/*", "/", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://a.example.org/x?y#z`` is ``org,example,a)/x?y``."""
    rest = F.concat(path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1))
    key = F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20"), F.lit("-"))


# --- records -----------------------------------------------------------------------------

def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "%20", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


def parse(member: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest."""
    text = zlib.decompress(member, 31)
    head, _, block = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    name = lambda f: fields[f][len("<urn:page:"):-1] or None if f in fields else None
    return {"page_id": name("WARC-Record-ID"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": name("WARC-Refers-To"), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page (page_id, url, html) and returns the captures: entry (key and id), file, offset, length."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_ = F.octet_length("html") >= REVISIT_BYTES
    same = cut(rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = join_hot(rows, same, "digest", "n", pages.count(), F.xxhash64("page_id", "url"))
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", refers.alias("refers_to"), url_key(F.col("url")).alias("key"))

    def run(batches):
        fs, base = open_folder(folder)
        out, name, at = None, None, 0
        for batch in batches:
            found = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "key"))):
                page_id, url, html, digest, refers_to, key = r
                member = record(page_id, url, html.encode(), digest, refers_to)
                if out is None or at + len(member) > ARCHIVE_BYTES and at:
                    if out is not None:
                        out.close()
                    name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                found.append((f"{key} {'' if page_id is None else page_id}", name, at, len(member)))
                at += len(member)
            cols = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                             ["entry", "file", "offset", "length"])
        if out is not None:
            out.close()

    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    return cut(map_arrow(rows, run, "entry string, file string, offset long, length long"))


# --- index ---------------------------------------------------------------------------------

def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes the index parts; returns (first entry, file) of each, in order: one per part, not per capture."""
    parts = max(1, -(-captures.count() // PART_ENTRIES))

    def run(batches):
        fs, base = open_folder(folder)
        name, out, at, directory, lines, first = f"index-{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def flush():
            nonlocal at, lines
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(block)}")
            at, lines = at + len(block), []

        for batch in batches:
            for e, f, o, n in zip(*(batch.column(c).to_pylist() for c in ("entry", "file", "offset", "length"))):
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), e
                lines.append(f"{e}\t{f}\t{o}\t{n}")
                if len(lines) == BLOCK_ENTRIES:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress("\n".join(directory).encode(), 6)
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.string()), pa.array([name], pa.string())], ["first", "file"])

    ordered = captures.repartitionByRange(parts, "entry").sortWithinPartitions("entry", "file", "offset")
    return sorted((r["first"], r["file"]) for r in map_arrow(ordered, run, "first string, file string").collect())


class IndexPart:
    """An open index file: its directory in memory, one block at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        rows = [x.split("\t") for x in zlib.decompress(self.file.read_at(n, size - 8 - n)).decode().split("\n")]
        self.firsts, self.ranges, self.held = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows], (-1, [], [])

    def block(self, k: int) -> tuple[list[str], list[str]]:
        if self.held[0] != k:
            offset, length = self.ranges[k]
            lines = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
            self.held = (k, [x.split("\t", 1)[0] for x in lines], lines)
        return self.held[1:]

    def find(self, entry: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of an entry; they may run over several blocks."""
        out, k = [], max(0, bisect.bisect_left(self.firsts, entry) - 1)
        while k < len(self.firsts) and self.firsts[k] <= entry:
            entries, lines = self.block(k)
            for line in lines[bisect.bisect_left(entries, entry):bisect.bisect_right(entries, entry)]:
                _, name, offset, length = line.split("\t")
                out.append((name, int(offset), int(length)))
            k += 1
        return out


def look_up(entries: DataFrame, parts: list[tuple[str, str]], folder: str) -> DataFrame:
    """(file, offset, length) of the captures of distinct entries (column entry), through the index."""
    firsts = [p[0] for p in parts]

    def run(batches):
        fs, base = open_folder(folder)
        held, part = -1, None
        for batch in batches:
            found = []
            for entry in batch.column("entry").to_pylist():
                k = bisect.bisect_right(firsts, entry) - 1
                if k < 0:
                    continue
                if k != held:
                    held, part = k, IndexPart(fs, f"{base}/{parts[k][1]}")
                found += part.find(entry)
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file", "offset", "length"])

    ordered = entries.select("entry").distinct().repartitionByRange("entry").sortWithinPartitions("entry")
    return map_arrow(ordered, run, "file string, offset long, length long")


def read_records(ranges: DataFrame, folder: str) -> DataFrame:
    """Fields of the records at (file, offset, length); neighbouring ranges are read at once."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def runs(rows):
        held: list = []
        for r in rows:
            if held and (r[0] != held[0][0] or r[1] != held[-1][1] + held[-1][2] or r[1] + r[2] - held[0][1] > READ_AHEAD):
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def run(batches):
        fs, base = open_folder(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for group in runs(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))):
                if group[0][0] != name:
                    name, file = group[0][0], fs.open_input_file(f"{base}/{group[0][0]}")
                start = group[0][1]
                data = file.read_at(group[-1][1] + group[-1][2] - start, start)
                out += [parse(data[o - start:o - start + n]) for _, o, n in group]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == "payload_bytes" else pa.string()) for k in names], names)

    ordered = ranges.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return map_arrow(ordered, run, ", ".join(f"{k} {'long' if k == 'payload_bytes' else 'string'}" for k in names))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive, indexed, looked up by its key and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = os.path.join(checkpoint_root(spark), f"warc-{uuid.uuid4().hex}")
    captures = write_archives(pages, folder)
    parts = build_index(captures, folder)
    wanted = pages.select(F.concat(url_key(F.col("url")), F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("entry"))
    kind = pages.schema["page_id"].dataType
    return read_records(look_up(wanted, parts, folder), folder).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
