"""WARC archives with a two-level capture index.

Records are written as gzip members, equal payloads once: the capture with the
largest page id is the response, the others are revisits that refer to it. The
index has one line a capture, under the URL with its host reversed: range-sorted,
cut into compressed blocks (level one), with a sparse directory of first keys
(level two) at the end of each index file. A look-up finds the file by the table
of files, the block by binary search in that file's directory, and then reads
one block and one record by their byte ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import filesystem, new_file_name, qualified, scratch_path, settle

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES = 1000
#: An archive file is closed once it has this many bytes.
FILE_BYTES = 256 << 20
_TAIL = struct.Struct("<QQ")  # offset and length of the directory
_CAPTURE = "key string, page_id long, url string, record_type string, refers_to long, digest string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, ``)``, then
    path and query, in lower case. A null URL has the key of an empty one."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?#]*)", 1), r"^([^@]*@)?(www\.)?|:\d+$", "")
    rest = F.regexp_replace(F.regexp_replace(plain, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def record_id(page_id: int | None, digest: str) -> str:
    """The same id for the same capture, whoever writes it and how often."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One capture as a gzip member. A revisit has the HTTP header but no payload."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page is None else page}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers, payload, payload bytes that the HTTP header states) of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = next(int(line[16:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: "))
    return headers, payload, stated


def _tail(at: int, n: int) -> bytes:
    """The end of an index file: where its directory is."""
    return _TAIL.pack(at, n)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` and return the settled captures,
    one row a record: key, page_id, url, record_type, refers_to, digest, and the
    file, offset and length of the record.

    Of records with equal payloads of ``least_bytes`` or more, that with the
    largest page_id is the response (all rows of that id, should it repeat); a
    null page_id is the smallest. A null payload is an empty one, a null URL an
    empty one. An empty table gives no record.
    """
    folder = qualified(pages.sparkSession, folder)
    page, payload = F.col(page_id).cast("long"), F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(page.alias("page"), F.col(url).cast("string").alias("address"), payload.alias("body")).withColumn("sha", F.sha1("body"))
    equal = pages.select(F.sha1(payload).alias("same"), page.alias("page"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    # Only payloads that several captures share: one row for each, whatever their number.
    shared = equal.groupBy("same").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(shared, rows.sha == shared.same, "left")
    revisit = F.col("same").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    rows = rows.select("page", "address", url_key(F.col("address")).alias("key"), "body", revisit.alias("again"), F.when(revisit, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, stream, at = "", None, 0
        for batch in batches:
            out = []
            for page, address, key, body, again, first in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    name, at = new_file_name(f"{TaskContext.get().partitionId():06d}") + ".warc.gz", 0
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = body.encode("utf-8", "surrogatepass")
                digest = base32_sha1(data)
                member = record(page, address, data, len(data), digest, first, again)
                stream.write(member)
                out.append((key, page, address, "revisit" if again else "response", first, digest, f"{folder}/{name}", at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    stream.close()
                    stream = None
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=[p.split()[0] for p in _CAPTURE.split(", ")])
        if stream is not None:
            stream.close()

    return settle(rows.mapInArrow(run, _CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the two-level index of ``captures`` and return its settled table of
    files: (part, path, first_key, last_key, blocks, lines), one row a file."""
    folder, order = qualified(captures.sparkSession, folder), ["key", "page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lines, directory, stream, at, total, path, last = TaskContext.get().partitionId(), [], [], None, 0, 0, "", ""
        fs, root = filesystem(folder)

        def flush() -> None:
            nonlocal lines, at
            data = zlib.compress("\n".join(x for _, x in lines).encode())
            directory.append([lines[0][0], at, len(data), len(lines)])
            stream.write(data)
            at += len(data)
            lines = []

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    path = new_file_name(f"{part:06d}") + ".cidx"
                    stream = fs.open_output_stream(f"{root}/{path}", compression=None)
                last = row["key"]
                lines.append((last, json.dumps(row, ensure_ascii=False)))
                total += 1
                if len(lines) == block_lines:
                    flush()
        if stream is not None:
            if lines:
                flush()
            data = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
            stream.write(data + _tail(at, len(data)))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{path}", "first_key": directory[0][0], "last_key": last, "blocks": len(directory), "lines": total}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("blocks", pa.int32()), ("lines", pa.int64())]))

    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ordered.mapInArrow(run, "part int, path string, first_key string, last_key string, blocks int, lines long"), "index-files")


class IndexFile:
    """One index file: its directory and, by byte range, its blocks."""

    def __init__(self, path: str) -> None:
        fs, inner = filesystem(path)
        self.stream = fs.open_input_file(inner)
        at, n = _TAIL.unpack(self._range(self.stream.size() - _TAIL.size, _TAIL.size))
        self.directory = json.loads(zlib.decompress(self._range(at, n)))
        self.keys = [d[0] for d in self.directory]
        self.opened: tuple[int, list[dict]] = (-1, [])

    def _range(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, b: int) -> list[dict]:
        if self.opened[0] != b:  # neighbouring keys are often in the block read last
            _, at, n, _ = self.directory[b]
            self.opened = (b, [json.loads(x) for x in zlib.decompress(self._range(at, n)).decode().split("\n")])
        return self.opened[1]

    def close(self) -> None:
        self.stream.close()

    def find(self, key: str) -> Iterator[dict]:
        """Captures of ``key``: the block before its place among the first keys, and
        those after it for as long as they begin with the key."""
        b = max(0, bisect_right(self.keys, key) - 1)
        while b > 0 and self.keys[b] == key:
            b -= 1
        while b < len(self.keys) and self.keys[b] <= key:
            lines = self.block(b)
            at = bisect_left(lines, key, key=lambda c: c["key"])
            while at < len(lines) and lines[at]["key"] == key:
                yield lines[at]
                at += 1
            b += 1


def read_index(files: DataFrame) -> DataFrame:
    """All captures, read from the blocks of the index files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                index = IndexFile(path)
                for b in range(len(index.directory)):  # the whole index in one pass
                    rows = index.block(b)
                    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds.get(n, pa.string())) for n in (p.split()[0] for p in _CAPTURE.split(", "))]))
                index.close()

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, _CAPTURE)


def lookup(urls: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """The captures of each row of ``urls`` (with the column ``asked``).

    The table of files, one row for each index partition, goes to all tasks, which
    find the files of a key in it by binary search; captures of a very common key
    fill several. Then each file is opened by one task, its directory searched and
    the blocks read that hold what is asked.
    """
    table = sorted((r.first_key, r.last_key, r.path) for r in files.select("first_key", "last_key", "path").collect())
    lasts = [last for _, last, _ in table]
    asked = urls.select(F.col(f"`{url}`").cast("string").alias("asked"), url_key(F.col(f"`{url}`").cast("string")).alias("wanted"))
    names = ["asked"] + [p.split()[0] for p in _CAPTURE.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, paths = [], []
            for i, key in enumerate(batch.column(1).to_pylist()):
                at = bisect_left(lasts, key)  # the first file that does not end before the key
                while at < len(table) and table[at][0] <= key:
                    rows.append(i)
                    paths.append(table[at][2])
                    at += 1
            there = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(there), batch.column(1).take(there), pa.array(paths, pa.string())], names=["asked", "wanted", "path"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, open_, out = None, "", []
        for batch in batches:
            for address, key, path in zip(*(c.to_pylist() for c in batch.columns)):
                if path != open_:
                    if index is not None:
                        index.close()
                    index, open_ = IndexFile(path), path
                for capture in index.find(key):
                    out.append(capture | {"asked": address})
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
        if index is not None:
            index.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    routed = asked.mapInArrow(route, "asked string, wanted string, path string")
    placed = routed.repartition(max(1, len(table)), "path").sortWithinPartitions("path", "wanted")
    return placed.mapInArrow(find, "asked string, " + _CAPTURE)


def read_records(captures: DataFrame, keep_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload])
    of captures, from range reads in the order of each archive file. A response's
    bytes and digest are those of the payload read; a revisit states its own."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            out, held = [], 0
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    fs, inner = filesystem(file)
                    name, stream = file, fs.open_input_file(inner)
                stream.seek(offset)
                headers, payload, stated = parse(stream.read(length))
                revisit = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
                page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID", "")
                out.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(refers) if refers else None, stated if revisit else len(payload), digest, *([None if revisit else payload] if keep_payload else [])))
                held += len(payload) if keep_payload else 0
                if held > 32 << 20:
                    yield pa.record_batch([pa.array(x, k) for x, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(x, k) for x, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])
        if stream is not None:
            stream.close()

    files = max(1, captures.select("file").distinct().count())
    placed = captures.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **columns) -> tuple[DataFrame, DataFrame]:
    """Write archives and index of ``pages``: (captures, table of index files)."""
    folder = qualified(pages.sparkSession, folder) if folder else scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, least_bytes, **columns)
    return captures, write_index(captures, folder + "-index")
