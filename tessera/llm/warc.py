"""WARC archives and a two-level capture index.

Each task writes its pages as one archive of gzip members, a record each, in the shared folder, and hands on the place of
every record. Captures are sorted by reversed-host URL key into compressed blocks; the sparse block directory holds
each block's first and last key and is bounded: blocks grow with the table, so that there are at most MOST_BLOCKS. A lookup
finds its blocks by binary search in the directory, its captures in those blocks, and reads only the records' byte ranges.
Archives are opened through pyarrow.fs, so the shared folder may be local, HDFS or an object store that it knows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, work_path

#: Captures in an index block, and the largest number of blocks, which bounds what is broadcast.
BLOCK_LINES, MOST_BLOCKS = 3000, 100_000
#: Bytes between two records that are still read in one go, and the most bytes read so.
GAP, WINDOW = 1 << 14, 1 << 22
#: Bytes of archives that a task reads back.
TASK_BYTES = 1 << 24
CRLF = "\r\n"
CONTROLS = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, port, path and query; without scheme and fragment; "-" if there is none."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    port_text = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + port_text + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit that has the HTTP head only."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>" if page is not None else "WARC-Record-ID: <urn:nopage:0>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        plain = CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.insert(4, f"WARC-Target-URI: {plain}")
        if plain != url:  # for reading back: other readers skip fields that they do not know
            head.insert(5, f"X-Original-URI: {json.dumps(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return (CRLF.join(head) + CRLF + CRLF).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; payload_bytes and digest are those of the full payload. A response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(CRLF)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split(CRLF) if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    own = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if fields.get(name, "").startswith("<urn:page:") else None
    found = {"page": own("WARC-Record-ID"), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": own("WARC-Refers-To")}
    uri = fields.get("WARC-Target-URI")
    found["url"] = json.loads(fields["X-Original-URI"]) if "X-Original-URI" in fields else uri
    found["payload"] = payload if found["record_type"] == "response" else None
    if found["payload"] is not None and (len(payload), base32_sha1(payload)) != (size, digest):
        raise ValueError(f"the payload of {found['page']} is damaged")
    return found


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row as a record and give the captures: (key, page, path, offset, length).

    Of rows with equal payloads the one with the largest id is a response, the others revisit it. The group minima are summed
    before the shuffle and kept as a table, so a payload that very many pages share is dealt over many tasks.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = saved(rows.select("id", "sha").groupBy("sha").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha", "response"), "payloads")
    refers = F.when(F.coalesce(F.col("id") != F.col("response"), F.col("response").isNotNull()), F.col("response"))
    told = rows.join(groups.hint("merge"), "sha", "left").select(F.col("id").cast("string").alias("page"), "url", "payload", refers.cast("string").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"  # another attempt writes another file; only a finished one's captures are kept
        at = 0
        for batch in batches:
            if out is None:
                system, path = _open(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            keys, offsets, lengths = [], [], []
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                member = gzip.compress(record(page, url, payload, base32_sha1(payload), refers_to), 6, mtime=0)
                out.write(member)
                keys.append(url_key(url))
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0), pa.array([name] * len(batch), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page", "path", "offset", "length"])
        if out is not None:
            out.close()

    return told.mapInArrow(run, "key string, page string, path string, offset bigint, length bigint")


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(block, first_key, last_key, lines, data): captures sorted by key and place, in zlib-compressed blocks."""
    count = captures.count()
    lines = max(block_lines, -(-count // max(1, most_blocks // 2)))
    # Each range gives one block that may be short, so there are no more ranges than half of most_blocks.
    ranges = max(1, min(most_blocks // 2, -(-count // (8 * lines))))
    ordered = captures.repartitionByRange(ranges, "key", "path", "offset").sortWithinPartitions("key", "path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            keys = rows.column(0).to_pylist()
            text = "\n".join(json.dumps(list(r)) for r in zip(*(c.to_pylist() for c in rows.columns)))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (uuid.uuid4().hex, keys[0], keys[-1], len(keys), zlib.compress(text.encode()))], names=["block", "first_key", "last_key", "lines", "data"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= lines:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, lines))
                held = table.slice(lines).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "block string, first_key string, last_key string, lines bigint, data binary")


def look_up(index: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key, page, path, offset, length) of every capture of the given URLs. index: a stored table."""
    directory = index.select("first_key", "last_key", "block").orderBy("first_key", "last_key").toPandas()  # at most MOST_BLOCKS rows
    sent = index.sparkSession.sparkContext.broadcast((directory.first_key.tolist(), directory.last_key.tolist(), directory.block.tolist()))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, blocks = sent.value
        for batch in batches:
            keys = {url_key(u if isinstance(u, str) else None) for u in batch.iloc[:, 0]}
            found = [(k, blocks[i]) for k in keys for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
            yield pd.DataFrame(found, columns=["key", "block"], dtype=object)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "page", "path", "offset", "length"])

    wanted = saved(urls.select(url_col).distinct().mapInPandas(search, "key string, block string").distinct(), "wanted")
    needed = wanted.select("block").distinct()
    lines = index.join(F.broadcast(needed), "block", "left_semi").select("data").mapInArrow(unpack, "key string, page string, path string, offset bigint, length bigint")  # at most MOST_BLOCKS ids
    return lines.join(wanted.select("key").distinct().hint("merge"), "key", "left_semi")


def read_ranges(captures: DataFrame, with_payload: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records at the captures' byte ranges: (page, url, record_type, payload_bytes, payload_digest, refers_to[, payload]).

    captures: a stored table. Neighbouring records are dealt together, about task_bytes of archives to a task.
    """
    schema = "page string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = opened = None
        for batch in batches:
            paths, offsets, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ends = offsets + lengths
            start, rows = 0, []
            while start < len(paths):
                stop = start + 1  # near records of one archive are read together
                while stop < len(paths) and paths[stop] == paths[start] and 0 <= offsets[stop] - ends[stop - 1] <= GAP and ends[stop] - offsets[start] <= WINDOW:
                    stop += 1
                if opened != paths[start]:
                    system, path = _open(opened := paths[start])
                    file = system.open_input_file(path)
                data = file.read_at(int(ends[stop - 1] - offsets[start]), int(offsets[start]))
                rows += [parse_record(gzip.decompress(data[a : a + n])) for a, n in zip((offsets[start:stop] - offsets[start]).tolist(), lengths[start:stop].tolist())]
                start = stop
            kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    size = captures.agg(F.sum("length")).first()[0] or 0
    # A number of its own: adaptive execution would merge tasks by the few bytes of the captures. Chunks are smaller than a task, so that tasks even out.
    near = captures.select("path", "offset", "length").repartition(max(1, -(-size // task_bytes)), "path", F.expr(f"offset div {max(1, task_bytes // 4)}")).sortWithinPartitions("path", "offset")
    return near.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write pages as WARC archives, index them, look all their URLs up and read the records back.

    One row per page: id, payload_bytes, payload_digest, record_type, refers_to, url. A null payload counts as empty; empty
    payloads are equal too. A null URL is kept as none. A null id comes back as null and revisits any equal payload with an
    id; among nulls only, all are responses. Rows that share the largest id are all responses. An empty table gives an
    empty result. Other columns are not read.
    """
    folder = folder or work_path(pages.sparkSession, "archives")
    captures = saved(write_archives(pages, folder, id_col, url_col, payload_col), "captures")
    index = saved(build_index(captures), "index")
    found = read_ranges(saved(look_up(index, pages.select(url_col), url_col), "found"))
    kind = pages.schema[id_col].dataType
    return found.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("url").alias(url_col))
