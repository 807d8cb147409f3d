"""WARC archives of pages with a two-level capture index.

Archives hold one gzip member for each record. The index is sorted by reversed-host URL key; its lines lie in
compressed blocks, and a sparse directory holds the first key and the byte range of each block. A look-up searches the
directory by bisection, reads one block or a few by byte range, and then the records by byte range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isofield.llm.common import cut

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 2000
CAPTURES_PER_INDEX_FILE = 2_000_000
#: Digests of more than one page are sent to every task only up to this many.
BROADCAST_GROUPS = 500_000
CAPTURE = "key string, page_id long, url string, archive string, at long, size long, type string"
DIRECTORY = "file string, first_key string, first_id long, last_key string, last_id long, at long, size long, lines long"
#: A row of an index block, and of the directory of one index file.
LINE = ("key", "page_id", "url", "archive", "at", "size", "type")


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: http://www.a.org/b -> org,a)/b. No scheme, no www, no fragment."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")/" + url
    labels = [x for x in host.removeprefix("www.").split(".") if x]
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" \
        + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; a path without a scheme is one of the shared folder's own file system, which is mounted."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _create(path: str):
    fs, p = _place(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(p, compression=None)


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url or 'urn:unknown', safe=':/?#[]@!$&()*+,;=%~-._')}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of a record; the payload of a response is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.decode().rpartition("Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != n or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"page_id": number(headers["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest,
            "record_type": headers["WARC-Type"], "refers_to": number(headers.get("WARC-Refers-To")), "payload": payload}


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write one record for each page under path/archive; returns the captures, unsorted.

    Of equal payloads the page with the largest id is the response, as are all its repeated rows; others revisit it.
    Null html is an empty payload. Rows whose id is null are always responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    sized = rows.where(F.octet_length("payload") >= min_revisit_bytes) if min_revisit_bytes else rows
    groups = cut(sized.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("least"))
                 .where("least < response_id").select("sha", "response_id"), "groups")
    if groups.count() <= BROADCAST_GROUPS:
        decided = rows.join(F.broadcast(groups), "sha", "left")
    else:
        # Ids and digests alone meet the groups; payloads are then dealt by id and digest, of which no pair is common.
        where = ["page_id", "sha"]
        later = rows.select(*where).join(groups, "sha").where("page_id < response_id").distinct()
        decided = rows.join(later, where, "left")
    decided = decided.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("response_id"), F.col("response_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, at = f"{path}/archive/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    stream = _create(file)
                member = _member(record(page_id, url, payload, payload_digest(payload), refers_to, date))
                stream.write(member)
                out.append((url_key(url), page_id, url, file, at, len(member), "response" if refers_to is None else "revisit"))
                at += len(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (
                    pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                    names=["key", "page_id", "url", "archive", "at", "size", "type"])
        if stream is not None:
            stream.close()

    return decided.mapInArrow(run, CAPTURE)


def order_of(key: str, page_id: int | None) -> tuple[str, int]:
    """Where a capture stands in the index: by key, then by id with nulls first."""
    return key, -1 << 63 if page_id is None else page_id


def write_index(captures: DataFrame, path: str, files: int, block_lines: int | None = None) -> DataFrame:
    """Sort captures by key and id into compressed blocks under path/index; returns the sparse directory."""
    block_lines = block_lines or BLOCK_LINES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, at, directory, lines = f"{path}/index/part-{uuid.uuid4().hex}.cdx", None, 0, [], []

        def flush() -> None:
            nonlocal at, stream
            if stream is None:
                stream = _create(file)
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            stream.write(block)
            directory.append((file, lines[0][0], lines[0][1], lines[-1][0], lines[-1][1], at, len(block), len(lines)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(row)
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if stream is not None:
            stream.close()
            with _create(file + ".dir") as side:
                side.write(json.dumps(directory).encode())
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*directory) if directory else [[]] * 8, kinds)],
                                         names=["file", "first_key", "first_id", "last_key", "last_id", "at", "size", "lines"])

    ordered = captures.select(*LINE).repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, DIRECTORY)


class Reader:
    """Range reads of files, each opened once."""

    def __init__(self, keep: int = 64):
        self.files, self.keep = {}, keep

    def __call__(self, path: str, at: int, size: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
            fs, p = _place(path)
            self.files[path] = fs.open_input_file(p)
        return self.files[path].read_at(size, at)


class Index:
    """Captures by bisection: of the files' last entries, of one file's directory, and of one block, each read by range."""

    def __init__(self, files: list[tuple[str, tuple[str, int]]]):
        self.files, self.last = [f for f, _ in files], [last for _, last in files]
        self.read, self.directory, self.block = Reader(), (None, [], []), (None, [], [])

    def blocks(self, file: str) -> tuple[list, list]:
        if self.directory[0] != file:
            fs, p = _place(file + ".dir")
            rows = json.loads(fs.open_input_stream(p, compression=None).read())
            self.directory = (file, rows, [order_of(r[3], r[4]) for r in rows])
        return self.directory[1:]

    def lines(self, file: str, at: int, size: int) -> tuple[list, list]:
        if self.block[0] != (file, at):
            rows = [json.loads(x) for x in zlib.decompress(self.read(file, at, size)).split(b"\n")]
            self.block = ((file, at), rows, [order_of(r[0], r[1]) for r in rows])
        return self.block[1:]

    def find(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[list]:
        """Captures from low to high, both included. Equal entries may go on in the next block or file."""
        for f in range(bisect.bisect_left(self.last, low), len(self.files)):
            blocks, last = self.blocks(self.files[f])
            for b in range(bisect.bisect_left(last, low), len(blocks)):
                if order_of(blocks[b][1], blocks[b][2]) > high:
                    return
                rows, entries = self.lines(self.files[f], blocks[b][5], blocks[b][6])
                yield from rows[bisect.bisect_left(entries, low):bisect.bisect_right(entries, high)]
                if entries[-1] > high:
                    return


def last_entries(directory: DataFrame) -> list[tuple[str, tuple[str, int]]]:
    """(file, last entry) of every index file in order: one row for CAPTURES_PER_INDEX_FILE captures."""
    rows = directory.groupBy("file").agg(F.max(F.struct("last_key", "last_id")).alias("last")).collect()
    return sorted(((r["file"], order_of(r["last"]["last_key"], r["last"]["last_id"])) for r in rows), key=lambda x: x[1])


def wanted_keys(urls: DataFrame, url_col: str, id_col: str | None) -> DataFrame:
    """(key, asked, page_id) of the URLs to look up, in the order of the index, so that a task reads a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), *batch.columns], names=["key", "asked", "page_id"])

    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    keyed = urls.select(F.col(url_col).cast("string").alias("asked"), ids.alias("page_id")).distinct().mapInArrow(run, "key string, asked string, page_id long")
    return keyed.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")


def look_up(directory: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of the given URLs: bisection of files and blocks, then one block by range."""
    files = last_entries(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(files)
        for batch in batches:
            out = [x for key, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                   for x in index.find((key, -1 << 63), (key, 1 << 63)) if x[2] == asked]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=list(LINE))

    return wanted_keys(urls, url_col, None).mapInArrow(run, CAPTURE)


def read_pages(directory: DataFrame, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", chunk: int = 1000) -> DataFrame:
    """The records of the given pages: (page_id, payload_bytes, payload_digest, record_type, refers_to, url).

    Each page's key and id are bisected in the index; the records found are read by byte range, archive by archive.
    Repeated rows are looked up once and come back as often as they were archived.
    """
    files = last_entries(directory)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, read = Index(files), Reader()
        for batch in batches:
            asked = list(zip(*(c.to_pylist() for c in batch.columns)))
            for i in range(0, len(asked), chunk):
                captures = [x for key, url, page_id in asked[i:i + chunk] for x in index.find(*[order_of(key, page_id)] * 2) if x[2] == url]
                out: list[tuple] = []
                for x in sorted(captures, key=lambda x: (x[3], x[4])):
                    got = parse(zlib.decompress(read(x[3], x[4], x[5]), 31))
                    out.append((*(got[c] for c in names), x[2]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=[*names, "url"])

    return wanted_keys(pages, url_col, id_col).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write archives and index under path; returns the directory, itself written to path/directory."""
    captures = cut(write_archives(pages, path, **columns), "captures")
    n = captures.count()
    spark: SparkSession = pages.sparkSession
    files = max(1, min(-(-n // CAPTURES_PER_INDEX_FILE), 100_000)) if n > CAPTURES_PER_INDEX_FILE else max(1, min(12, -(-n // BLOCK_LINES)))
    write_index(captures, path, files).write.parquet(f"{path}/directory")
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory")
