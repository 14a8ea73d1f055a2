"""WARC archives of pages and a two-level index of their captures.

Archives: every task appends gzip members, one for each record, to files of its own in the shared folder. A retried task
writes new files; only files that committed index rows name are ever read. Index: captures are range-partitioned and
sorted by their reversed-host key; a task packs its range into compressed blocks of lines and a sparse directory with the
first key of each block. A lookup finds shards in the table of shard bounds, the block by binary search in the shard's
directory, the line by binary search in the block, and then reads that byte range of the archive.
"""
from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.llm.common import BROADCAST_ROWS, shared_folder, written

#: Payloads below so many bytes are always stored.
LEAST_SHARED = 100


@dataclass(frozen=True)
class WarcSpec:
    file_bytes: int = 64 << 20
    block_lines: int = 512
    #: Captures of one index shard, about.
    shard_captures: int = 200_000
    date: str = "1970-01-01T00:00:00Z"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then the rest; scheme and user are left out. No URL: ``-``."""
    if not url:
        return "-"
    try:
        u = urlsplit(url if "//" in url else f"//{url}")
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return "!" + re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", key)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record with the same payload."""
    kind = "response" if refers_to is None else "revisit"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = head + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def revisit_plan(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload of ``LEAST_SHARED`` bytes a smaller page_id holds too."""
    html = F.coalesce("html", F.lit(""))
    narrow = pages.where(F.col("page_id").isNotNull() & (F.octet_length(html) >= LEAST_SHARED)).select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    return narrow.join(first, "digest").where("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Write a record for every row; gives the captures key, page_id, file, offset, length as a written table."""
    folder = shared_folder(pages.sparkSession, "warc")
    plan = written(revisit_plan(pages), "revisits")
    plan = F.broadcast(plan) if plan.count() * 10 <= BROADCAST_ROWS else plan
    rows = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).join(plan, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _at(folder)
        place.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= spec.file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = place.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to, spec.date), 6, mtime=0)
                    out.write(member)
                    made.append((surt(url), page_id, f"{folder}/{name}", at, len(member)))
                    at += len(member)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                                     names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()
    return written(rows.select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("refers_to").cast("long")).mapInArrow(
        run, "key string, page_id long, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Write the index; gives one row for each shard: first, last (keys), lines, directory (their files), blocks, captures."""
    folder = shared_folder(captures.sparkSession, "cdx")
    shards = max(1, -(-captures.count() // spec.shard_captures))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = _at(folder)
        place.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        lines: list[bytes] = []
        directory, at, total, first, last = [], 0, 0, None, None
        out = place.open_output_stream(f"{base}/{name}.cdx", compression=None)
        try:
            def flush() -> None:
                nonlocal at
                if lines:
                    packed = zlib.compress(b"\n".join(lines), 6)
                    out.write(packed)
                    directory.append(lines[0].partition(b"\t")[0] + b"\t%d\t%d" % (at, len(packed)))
                    at += len(packed)
                    lines.clear()
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    lines.append("\t".join("" if x is None else str(x) for x in row).encode())
                    first, last, total = first if first is not None else row[0], row[0], total + 1
                    if len(lines) >= spec.block_lines:
                        flush()
            flush()
        finally:
            out.close()
        if total:
            with place.open_output_stream(f"{base}/{name}.idx", compression=None) as idx:
                idx.write(b"\n".join(directory))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, f"{folder}/{name}.cdx", f"{folder}/{name}.idx", len(directory), total)],
                                             names=["first", "last", "lines", "directory", "blocks", "captures"])
    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "page_id", "file", "offset", "length")
    return written(ranged.mapInArrow(run, "first string, last string, lines string, directory string, blocks long, captures long"), "shards")


def lookup(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """key, page_id, file, offset, length of every capture with one of the distinct ``keys`` (key).

    The shard bounds, a row for ``shard_captures`` captures, join each key with the shards that can hold it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, directory, heads, lines_file, place = None, [], [], None, None
        block_at, block, block_keys = -1, [], []
        for batch in batches:
            found = []
            for key, lines, idx in zip(*(c.to_pylist() for c in batch.columns)):
                if idx != opened:
                    place, path = _at(idx)
                    with place.open_input_stream(path, compression=None) as f:
                        directory = [line.split(b"\t") for line in f.read().split(b"\n")]
                    heads, opened, block_at = [line[0] for line in directory], idx, -1
                    lines_file = place.open_input_file(_at(lines)[1])
                k = key.encode()
                b = max(0, bisect_left(heads, k) - 1)
                while b < len(heads) and heads[b] <= k:
                    if b != block_at:
                        raw = lines_file.read_at(int(directory[b][2]), int(directory[b][1]))
                        block = [line.split(b"\t") for line in zlib.decompress(raw).split(b"\n")]
                        block_at, block_keys = b, [line[0] for line in block]
                    i = bisect_left(block_keys, k)
                    while i < len(block) and block_keys[i] == k:
                        _, page_id, file, offset, length = block[i]
                        found.append((key, int(page_id) if page_id else None, file.decode(), int(offset), int(length)))
                        i += 1
                    if i < len(block):
                        break
                    b += 1
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i:i + 10_000]), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                                 names=["key", "page_id", "file", "offset", "length"])
    bounds = [r.asDict() for r in shards.select("first", "last", "lines", "directory").collect()]
    bounds.sort(key=lambda r: r["first"].encode())
    firsts, lasts = [r["first"].encode() for r in bounds], [r["last"].encode() for r in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                s = bisect_left(lasts, key.encode())
                while s < len(bounds) and firsts[s] <= key.encode():
                    out.append((key, bounds[s]["lines"], bounds[s]["directory"]))
                    s += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["key", "lines", "directory"])
    routed = keys.select("key").mapInArrow(route, "key string, lines string, directory string")
    routed = routed.repartition("directory", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("directory", "key")
    return routed.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame) -> DataFrame:
    """page_id, record_type, payload_digest (bare hex), payload (null for revisits), refers_to of each capture, by range reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        number = lambda urn: None if urn in (None, "<urn:page:None>") else int(urn[len("<urn:page:"):-1])
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != opened:
                    place, path = _at(file)
                    opened, source = file, place.open_input_file(path)
                fields, payload = parse(gzip.decompress(source.read_at(length, offset)))
                digest = fields["warc-payload-digest"].partition(":")[2]
                stored = fields["warc-type"] == "response"
                if stored and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record in {file} at {offset}")
                rows.append((number(fields["warc-record-id"]), fields["warc-type"], digest, payload if stored else None, number(fields.get("warc-refers-to"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()))],
                                                 names=["page_id", "record_type", "payload_digest", "payload", "refers_to"])
    ranged = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(run, "page_id long, record_type string, payload_digest string, payload binary, refers_to long")


def archived_pages(pages: DataFrame, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives through the index.

    Every row is a record. Of equal payloads of 100 bytes or more the smallest page_id is a response, others are revisits;
    shorter payloads (a null html is an empty one) are responses. Rows that repeat page_id and html repeat their record. A
    row without a page_id is a response that none refers to; a row without a URL has a key of its own kind. Other columns
    are ignored. An empty table gives no rows.
    """
    captures = write_archives(pages.select("page_id", "url", "html"), spec)
    shards = build_index(captures, spec)
    found = written(lookup(captures.select("key").distinct(), shards), "found")
    read = read_records(found).select("page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to")
    read = written(read, "records")
    sizes = read.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("n").alias("stored")).distinct()
    out = read.join(sizes, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("n", "stored").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
