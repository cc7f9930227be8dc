"""WARC archives written and read as a table of chunks.

A payload is never one cell of a Python batch: it is a sequence of rows (record, chunk
number, at most ``CHUNK`` bytes). A writing task takes the chunk rows of its records in
order and appends them to its archive, a gzip member per record, which rolls over at ``archive_bytes``. A reading
task walks an archive with one small buffer and gives chunk rows back, each with the
SHA-1 of the payload so far, so the last chunk of a record has the whole digest.

Of records with equal payloads (of ``least`` bytes or more) the one of the smallest id
is a response, the others are revisits: a header without payload that refers to it.
Equality is by SHA-1 and length, from one aggregate with map-side combine.

Archives have names of their own for every attempt of a task, and only the list that
the successful attempts return is read, so lost executors and repeated tasks leave no
doubtful records. They are written with Arrow's file systems below the shared folder.

A null payload counts as empty, a null url as about:blank. Rows that repeat both the
smallest id and its payload are all responses; a null id never is the smallest, unless
all ids of a payload are null, and then they all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.rows import columns, map_arrow, staged

CHUNK = 32 << 10
DATE = "2020-01-01T00:00:00Z"
CHUNKS = (
    "page_id bigint, url string, record_type string, refers_to bigint, chunk_no bigint, last boolean, "
    "data binary, payload_bytes bigint, payload_digest string"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def headers(row: dict) -> bytes:
    """The WARC and HTTP headers of a record; the payload of a response follows them."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "about:blank")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['sha1']))}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def chunked(pages: DataFrame, page_id: str, url: str, html: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all records, those of one record together and in order."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = columns(pages, page_id=page_id, url=url, html=html).withColumn("payload", payload).drop("html")
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # The first of each payload that more than one record has; all others need no partner.
    first = (
        rows.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    told = rows.join(first, ["sha1", "payload_bytes"], "left")
    # A null id is not the smallest, so it revisits it.
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = told.withColumn("refers_to", F.when(other, F.col("first")))
    stored = F.when(other, F.lit(b"")).otherwise(F.col("payload"))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.octet_length(stored).cast("long") - 1) / chunk))
    # Numbers are generated and each chunk is cut by its own: no array holds all chunks of a payload.
    numbered = told.select(
        "page_id", "url", "refers_to", "sha1", "payload_bytes", (last + 1).alias("n_chunks"), stored.alias("stored"),
        F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no"),
    )
    return numbered.withColumn("data", F.substring("stored", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("stored")


def write(chunks: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes the records; the list (archive, records, bytes) of what was written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, member, name, records, used = None, None, "", 0, 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([used])], ["archive", "records", "bytes"])

        for batch in batches:
            # A few chunks at a time become Python objects.
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if row["chunk_no"] == 0:
                        if out is not None and used >= archive_bytes:
                            out.close()
                            yield listed()
                            out = None
                        if out is None:
                            name, records, used = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                            # Arrow would compress a .gz file once more, as a whole.
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        member = zlib.compressobj(wbits=31)
                        part = member.compress(headers(row))
                        records += 1
                    else:
                        part = b""
                    part += member.compress(row["data"])
                    if row["chunk_no"] == row["n_chunks"] - 1:
                        part += member.compress(b"\r\n\r\n") + member.flush()
                    out.write(part)
                    used += len(part)
        if out is not None:
            out.close()
            yield listed()

    return map_arrow(chunks, run, "archive string, records bigint, bytes bigint")


class Members:
    """The bytes of a file of gzip members one after another, some at a time."""

    def __init__(self, stream):
        self.stream, self.zip = stream, None

    def read(self, n: int) -> bytes:
        """``n`` bytes, or fewer at the end of the file."""
        out = b""
        while len(out) < n:
            if self.zip is None or self.zip.eof:
                raw = (self.zip.unused_data if self.zip else b"") or self.stream.read(CHUNK)
                if not raw:
                    break
                self.zip = zlib.decompressobj(31)
            else:
                raw = self.zip.unconsumed_tail or self.stream.read(CHUNK)
            more = self.zip.decompress(raw, n - len(out))
            if not raw and not more and not self.zip.eof:
                raise ValueError("the archive ends within a record")
            out += more
        return out


class Walk:
    """An archive read forward with a buffer of about one chunk."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``; empty at the end of the archive."""
        while (at := self.held.find(mark)) < 0:
            more = self.stream.read(8 << 10)
            if not more:
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return b""
            self.held += more
        found, self.held = self.held[:at], self.held[at + len(mark):]
        return found

    def take(self, n: int) -> bytes:
        """Exactly ``n`` bytes."""
        if len(self.held) >= n:
            found, self.held = self.held[:n], self.held[n:]
            return found
        found = self.held + self.stream.read(n - len(self.held))
        self.held = b""
        if len(found) < n:
            raise ValueError("the archive ends within a record")
        return found


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def chunks_of(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive; a digest that differs from the header is an error."""
    walk = Walk(Members(stream))
    while head := walk.until(b"\r\n\r\n"):
        own = fields(head)
        http = walk.until(b"\r\n\r\n")
        left = int(own["content-length"]) - len(http) - 4
        page, refers = own.get("x-page-id"), own.get("x-refers-to-page")
        base = {
            "page_id": None if page is None else int(page), "url": own["warc-target-uri"], "record_type": own["warc-type"],
            "refers_to": None if refers is None else int(refers),
        }
        told = own["warc-payload-digest"].removeprefix("sha1:")
        if own["warc-type"] == "revisit":
            yield base | {"chunk_no": 0, "last": True, "data": b"", "payload_bytes": int(fields(http)["content-length"]), "payload_digest": told}
        else:
            digest, done, number = hashlib.sha1(), 0, 0
            while True:
                data = walk.take(min(chunk, left))
                digest.update(data)
                left, done = left - len(data), done + len(data)
                so_far = base32(digest.digest())
                if not left and so_far != told:
                    raise ValueError(f"page {page}: payload digest {so_far} is not {told}")
                yield base | {"chunk_no": number, "last": not left, "data": data, "payload_bytes": done, "payload_digest": so_far}
                number += 1
                if not left:
                    break
        walk.take(4)


def read(archives: DataFrame) -> DataFrame:
    """Chunk rows of the archives in column ``archive``: payload_bytes and payload_digest so far.

    A revisit is one row without data, with the bytes and digest of the full payload.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for row in chunks_of(stream):
                        rows.append(row)
                        if len(rows) == 64:
                            yield made(rows)
                            rows = []
                    yield made(rows)

    # A task per archive: the list is tiny, and left to itself it would be one partition.
    return map_arrow(archives.select("archive").repartition(max(1, archives.count())), run, CHUNKS)


def archived(pages: DataFrame, page_id: str, url: str, html: str, folder: str, least: int = 0) -> DataFrame:
    """Writes the pages to archives below ``folder`` and gives the archives' chunk rows."""
    return read(staged(write(chunked(pages, page_id, url, html, least), folder), "archives"))
