"""WARC archives with a two-level capture index.

Each partition of pages becomes one archive of gzip members, one record each;
a member can be read alone from its offset and length. Pages whose payload an
earlier page (smallest page_id) has are revisit records without a body.

The index has a line per capture, sorted by the reversed-host key of its URL
and cut into compressed blocks. A sparse directory keeps the first key of each
block with its place; each index file has the directory of its own blocks
beside it. Look-ups go by bisection: through the first keys of the index files,
of which there are as many as shuffle partitions, then through the directory of
one file. One range of an index file and one of an archive are read then.

Files are written from the executors to the shared folder through the
filesystem of its URI, under the name of the task attempt; only the names that
a successful attempt returned are in the manifest, so a task that ran twice
leaves no second copy in the results.

Defined results: null html is an empty payload. Payloads of fewer than
``least_bytes`` bytes are never revisits. Rows of equal page_id and payload are
captures of their own with equal results. A null page_id names nothing: it can
revisit but isn't referred to unless the whole group has no id, and then each
is a response. A null url is indexed under an empty key. Other columns are not
read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.shipping import scratch
from lodeline.llm.common import shipped, slices, written

BLOCK_LINES = 1000
LEAST_BYTES = 0

CAPTURES = "key string, page_id long, path string, start long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
DIRECTORY = "first_key string, path string, start long, length long, lines long"


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``, the host in lower case,
    without scheme, user, default port, fragment."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower().rstrip("."), p.port
    except ValueError:
        return ")/" + url.strip()
    if not host:
        return ")/" + url.strip()
    port = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{p.query}" if p.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (p.path or "/") + query


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def attempt_name(suffix: str) -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"part-{c.partitionId():06d}-{c.taskAttemptId()}{suffix}"


def digest32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


#: Signs that a URI keeps; others are percent-encoded, and the URL as it was goes into a field of its own.
URI_SIGNS = "%/:=&?~#+!$,;'@()*[]"
SOURCE_URL = "X-Source-URL"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """Of a page's response by page and payload; any other record's has its place as well."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, place: str) -> bytes:
    """One WARC/1.1 record, whose block is an HTTP message. The payload's size
    and digest are those of the full payload; a revisit has the message's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, place if revisit or page_id is None else '')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        uri = quote(url, safe=URI_SIGNS)
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:  # as the table has it, for reading back
            head.append(f"{SOURCE_URL}: {url.encode('unicode_escape').decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, digest, type, refers_to, payload or None); checks body and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size, kind, digest = int(fields["Content-Length"]), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, body = rest[:size].partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    if rest[size:] != b"\r\n\r\n" or (kind == "response" and (len(body) != length or digest32(hashlib.sha1(body).hexdigest()) != digest)):
        raise ValueError("damaged WARC record")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").partition(":")[0]) else None
    url = fields[SOURCE_URL].encode().decode("unicode_escape") if SOURCE_URL in fields else fields.get("WARC-Target-URI")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), url, length, digest, kind, refers, body.decode() if kind == "response" else None


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (of revisits).

    Ids of the first pages are found on (digest, page_id) rows alone; the html
    goes through one exchange, by page and digest, which no hot payload bends;
    only rows that repeat one page's id and payload meet in a task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = shipped(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    light = own.select("digest", "page_id", F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes)
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    again = light.join(first, "digest").where("page_id IS NULL OR page_id <> first").select("digest", "page_id", F.col("first").alias("refers_to")).distinct()
    return own.join(again.withColumnsRenamed({"digest": "d", "page_id": "p"}), F.expr("digest = d AND page_id <=> p"), "left").drop("d", "p")


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives; returns the written table of captures (unsorted). The
    date of all records is the moment when the work began, so that a task that
    runs again writes the same."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root, sink, name, at = None, "", None, "", 0
        try:
            for batch in slices(batches, "html"):
                if sink is None:
                    fs, root = opened(path)
                    fs.create_dir(root, recursive=True)
                    name = attempt_name(".warc.gz")
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                keys, ids, starts, sizes = [], [], [], []
                for p, u, h, d, r, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = gzip.compress(record(p, u, h.encode(), digest32(d), r, revisit, date, f"{name}.{at}"), 6, mtime=0)
                    sink.write(raw)
                    keys.append(surt(u)), ids.append(p), starts.append(at), sizes.append(len(raw))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array([f"{path}/{name}"] * len(ids), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    ["key", "page_id", "path", "start", "length"],
                )
        finally:
            if sink is not None:
                sink.close()

    rows = marked(pages, least_bytes).select("page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return written(rows.mapInArrow(run, CAPTURES), "captures")


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted, compressed blocks; returns the written directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, at, lines, rows = None, "", 0, [], []

        def flush() -> None:
            nonlocal at, lines
            raw = zlib.compress("\n".join(lines).encode(), 6)
            sink.write(raw)
            rows.append((lines[0].split("\t", 1)[0], f"{path}/{name}", at, len(raw), len(lines)))
            at, lines = at + len(raw), []

        try:
            for batch in batches:
                if sink is None and batch.num_rows:
                    fs, root = opened(path)
                    fs.create_dir(root, recursive=True)
                    name = attempt_name(".cdx")
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                for key, _, archive, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                    lines.append(f"{key.encode('unicode_escape').decode()}\t{archive}\t{start}\t{length}")
                    if len(lines) >= block_lines:
                        flush()
            if lines:
                flush()
        finally:
            if sink is not None:
                sink.close()
        if rows:
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as out:
                out.write("\n".join(f"{k.encode('unicode_escape').decode()}\t{a}\t{n}" for k, _, a, n, _ in rows).encode())
            rows = [(k.encode().decode("unicode_escape"), *rest) for k, *rest in rows]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["first_key", "path", "start", "length", "lines"])

    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The place is part of the sort key: captures of one hot URL spread over partitions.
    ordered = captures.repartitionByRange(parts, "key", "path", "start").sortWithinPartitions("key", "path", "start")
    return written(ordered.mapInArrow(run, DIRECTORY), "directory")


def block_lines_of(path: str, start: int, length: int) -> list[tuple[str, str, int, int]]:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        text = zlib.decompress(f.read_at(length, start)).decode()
    out = []
    for line in text.split("\n"):
        key, archive, at, size = line.rsplit("\t", 3)
        out.append((key.encode().decode("unicode_escape"), archive, int(at), int(size)))
    return out


def spanning(firsts: list[str], key: str) -> range:
    """By bisection, the ordered parts that may have a key, from their first
    keys: those that begin with it, and the one before them."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def directory_of(path: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(first key, place) of each block of an index file."""
    fs, name = opened(path + ".dir")
    with fs.open_input_stream(name) as f:
        rows = [x.rsplit("\t", 2) for x in f.read().decode().split("\n")]
    return [k.encode().decode("unicode_escape") for k, _, _ in rows], [(int(a), int(n)) for _, a, n in rows]


def asked_blocks(urls: DataFrame, directory: DataFrame, most: int = BLOCK_LINES) -> DataFrame:
    """(path, start, length, keys): the blocks that may have the keys of ``urls``
    (one column), found by bisection. A key of many captures has many blocks, a
    row for each; keys of one block share a row, ``most`` at a time."""
    files = sorted((r["k"], r["path"]) for r in directory.groupBy("path").agg(F.min("first_key").alias("k")).collect())  # one for each shuffle partition at most
    firsts = [k for k, _ in files]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({surt(u) for u in batch.column(0).to_pylist()}), pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = -1, ([], [])
        for batch in batches:
            found: dict[tuple[str, int, int], list[list[str]]] = {}
            for key in batch.column(0).to_pylist():
                for k in spanning(firsts, key):
                    if k != file:
                        file, held = k, directory_of(files[k][1])
                    for b in spanning(held[0], key):
                        own = found.setdefault((files[k][1], *held[1][b]), [[]])
                        if len(own[-1]) >= most:
                            own.append([])
                        own[-1].append(key)
            rows = [(*at, x) for at, own in found.items() for x in own]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "start", "length", "keys"])

    parts = max(1, int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = shipped(urls).mapInArrow(keys, "key string").distinct()
    return wanted.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "path string, start long, length long, keys array<string>")


def read_back(blocks: DataFrame) -> DataFrame:
    """The captures of blocks (path, start, length) and, where these have
    ``keys``, of these keys alone: ranges of the index, then of the archives."""
    all_keys = "keys" not in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for path, start, length, keys in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name, file, rows, own = None, "", None, [], set(keys or ())
                for _, archive, at, size in sorted((x for x in block_lines_of(path, start, length) if all_keys or x[0] in own), key=lambda x: x[1:]):
                    if archive != name:
                        if file is not None:
                            file.close()
                        fs, inner = opened(archive)
                        file, name = fs.open_input_file(inner), archive
                    rows.append(parse(gzip.decompress(file.read_at(size, at))))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if file is not None:
                    file.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    parts = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = F.lit(None).cast("array<string>").alias("keys") if all_keys else F.col("keys")
    return shipped(blocks).select("path", "start", "length", keys).repartitionByRange(parts, "path", "start").mapInArrow(run, RECORDS)


class CaptureIndex:
    """Look-ups in a sparse directory that was collected or loaded in part."""

    def __init__(self, directory: list[tuple[str, str, int, int]]):
        self.blocks = sorted(directory)
        self.keys = [b[0] for b in self.blocks]

    def lookup(self, url: str) -> list[tuple]:
        """All captures of a URL, read by ranges. Equal keys may span blocks."""
        key, out = surt(url), []
        for at in spanning(self.keys, key):
            for k, archive, start, length in block_lines_of(*self.blocks[at][1:]):
                if k == key:
                    fs, name = opened(archive)
                    with fs.open_input_file(name) as f:
                        out.append(parse(gzip.decompress(f.read_at(length, start))))
        return out


def archive_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES, block_lines: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """Write archives and index under the shared folder; (captures, directory)."""
    root = scratch(spark, "warc")
    captures = write_archives(pages, f"{root}/archives", least_bytes)
    return captures, write_index(captures, f"{root}/index", block_lines)
