"""WARC archives with a two-level capture index (operator 8).

Spark tasks write archives of gzip members, one record each, below the shared folder, through the
file system that the folder's URI names. Of records with equal payloads of at least ``MIN_REVISIT_BYTES``
the one with the largest page_id is a response and the others revisit it.

The index sorts reversed-host URL keys by range. Each range is one file of compressed blocks
followed by its block directory (first key, offset and length of each block); the ranges themselves, one row a
file, are all that the driver holds. A lookup searches the ranges, then a range's directory, then
one block by halving, and reads exactly the bytes of the records it found.

Defined cases: a null html counts as empty, a null url has the empty key; a null page_id sorts below all
others and is never revisited while another exists; rows that repeat a page_id with the same url are all
written and all read back; an empty table gives an empty result; other columns are ignored. Files of
a failed task attempt are named by no index row, so they are never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialise, scratch_uri

MIN_REVISIT_BYTES = 1000
BLOCK_ENTRIES = 512
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRIES = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed host, ``)``, path and query, without scheme, user, default port and fragment."""
    rest = (url or "").partition("#")[0]
    scheme, found, after = rest.partition("://")
    rest = after if found else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    if not url:
        return ""
    suffix = f":{port}" if port and port not in ("80", "443") else ""
    return ",".join(reversed(name.split("."))) + suffix + ")" + (path if path.startswith("/") else "/" + path)


@lru_cache(maxsize=8)
def file_system(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def split_uri(uri: str) -> tuple[str, str]:
    """File system root and path inside it."""
    scheme, found, rest = uri.partition("://")
    if not found:
        return "file:///", uri.removeprefix("file:")
    return (f"{scheme}://{rest.partition('/')[0]}/", fs.FileSystem.from_uri(uri)[1])


def open_output(uri: str):
    root, path = split_uri(uri)
    store = file_system(root)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # members are compressed one by one


class Ranges:
    """Reads byte ranges; keeps a bounded number of files open."""

    def __init__(self, most: int = 32):
        self.files, self.most = {}, most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.files:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            root, path = split_uri(uri)
            self.files[uri] = file_system(root).open_input_file(path)
        return self.files[uri].read_at(length, offset)

    def size(self, uri: str) -> int:
        root, path = split_uri(uri)
        return file_system(root).get_file_info(path).size


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head, with the length of the payload, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record's page id, url, type, payload length and digest; a response's are those of its own payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response":
        if len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": stated, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def with_decisions(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: a page whose payload a larger page_id also has refers to the largest."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES)
    shared = long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    joined = join_small(rows, materialise(shared, "shared"), ["digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition's pages to one archive; one index entry for each record. Run it once: it writes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                entries: list[tuple] = []
                for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    page_id, url, html, digest, refers_to = row
                    out = out or open_output(uri)
                    pack = zlib.compressobj(6, wbits=31)
                    member = pack.compress(warc_record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to)) + pack.flush()
                    out.write(member)
                    entries.append((url_key(url), page_id, uri, at, len(member)))
                    at += len(member)
                yield entry_batch(entries)
        finally:
            if out:
                out.close()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, ENTRIES)


def entry_batch(entries: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*entries, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "page_id", "file", "offset", "length"])


def sort_key(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.encode(), -(2**63) if page_id is None else page_id


def pack_lines(entries: list[tuple]) -> bytes:
    return zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in e) for e in entries).encode())


def unpack_lines(data: bytes) -> list[tuple]:
    rows = [line.rsplit("\t", 4) for line in zlib.decompress(data).decode().split("\n")]
    return [(key, int(page) if page else None, file, int(offset), int(length)) for key, page, file, offset, length in rows]


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> list[tuple]:
    """Sort the entries by range into index files; returns ``(first key, first page, file)`` of each, in order."""
    clean = entries.withColumn("key", F.translate("key", "\t\n", "  "))
    ranged = clean.repartitionByRange(F.asc("key"), F.asc("page_id")).sortWithinPartitions(F.asc("key"), F.asc("page_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at = f"{folder}/{uuid.uuid4().hex}.index", None, 0
        directory: list[tuple] = []
        held: list[tuple] = []

        def put(block: list[tuple]) -> None:
            nonlocal at, out
            out = out or open_output(uri)
            data = pack_lines(block)
            out.write(data)
            directory.append((*block[0][:2], "", at, len(data)))
            at += len(data)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block_entries:
                put(held[:block_entries])
                del held[:block_entries]
        if held:
            put(held)
        if directory:
            data = pack_lines(directory)
            out.write(data + struct.pack("<q", len(data)))
            out.close()
            yield entry_batch([(*directory[0][:2], uri, at, len(data))])

    files = materialise(ranged.mapInArrow(write, ENTRIES), "index-files").collect()  # one row a range
    return sorted(((r["key"], r["page_id"], r["file"]) for r in files), key=lambda r: sort_key(r[0], r[1]))


class CaptureIndex:
    """Finds captures by key and page; ``ranges`` is what ``write_index`` returned."""

    def __init__(self, ranges: list[tuple]):
        self.ranges, self.read = ranges, Ranges()
        self.starts = [sort_key(k, p) for k, p, _ in ranges]
        self.directory, self.block = lru_cache(4)(self._directory), lru_cache(16)(self._block)

    def _directory(self, uri: str) -> tuple[list, list]:
        size = self.read.size(uri)
        (length,) = struct.unpack("<q", self.read.read(uri, size - 8, 8))
        rows = unpack_lines(self.read.read(uri, size - 8 - length, length))
        return [sort_key(k, p) for k, p, *_ in rows], rows

    def _block(self, uri: str, offset: int, length: int) -> tuple[list, list]:
        rows = unpack_lines(self.read.read(uri, offset, length))
        return [sort_key(k, p) for k, p, *_ in rows], rows

    def find(self, key: str, page_id: int | None) -> Iterator[tuple]:
        """The entries of this key and page, which may go on over blocks and files."""
        want = sort_key(key, page_id)
        for r in range(max(bisect.bisect_left(self.starts, want) - 1, 0), len(self.ranges)):
            if self.starts[r] > want:
                return
            uri = self.ranges[r][2]
            firsts, blocks = self.directory(uri)
            for b in range(max(bisect.bisect_left(firsts, want) - 1, 0), len(blocks)):
                if firsts[b] > want:
                    return
                keys, rows = self.block(uri, *blocks[b][3:])
                for i in range(bisect.bisect_left(keys, want), len(rows)):
                    if keys[i] != want:
                        return
                    yield rows[i]

    def record(self, entry: tuple) -> dict:
        return parse_record(zlib.decompress(self.read.read(*entry[2:]), wbits=31))


def look_up(wanted: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The records of each distinct ``(url, page_id)`` of ``wanted``, read back from the archives."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [url_key(u).replace("\t", " ").replace("\n", " ") for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1)], ["key", "page_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(ranges)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = [index.record(e) for k, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in index.find(k, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    requests = wanted.select("url", F.col("page_id").cast("long")).mapInArrow(keys, "key string, page_id long").groupBy("key", "page_id").count()
    ordered = requests.select("key", "page_id").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(fetch, RECORDS)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Operator 8: write all pages as archives with their index, then read every page's record back through it."""
    folder = scratch_uri(pages.sparkSession, "archives")
    entries = materialise(write_archives(with_decisions(pages), f"{folder}/warc"), "entries")
    return look_up(pages, write_index(entries, f"{folder}/index"))
