"""WARC archives: a writer and a sequential reader, one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut, shared_folder

CHUNK = 1 << 16
#: A head that has not ended after so many bytes is damage, not a head.
LONGEST_HEAD = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: str, url: str, payload: bytes, refers_to: str | None = None,
           date: str = "2026-01-01T00:00:00Z") -> bytes:
    """One compressed record. A revisit carries the HTTP head only; its lengths and digests are
    those of the full payload."""
    digest = "sha1:" + base32_sha1(payload)
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date),
            ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", "sha1:" + base32_sha1(block))]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile",
                 "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    whole = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


class Members:
    """Bytes of one gzip member after another, inflated chunk by chunk."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.raw, self.ready, self.inflate = stream, b"", bytearray(), None

    def begin(self) -> bool:
        """Turn to the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        self.ready, self.inflate = bytearray(), zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bool:
        """Inflate a little more of this member; False when it has ended."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.raw or self.stream.read(CHUNK)
        if not data:
            raise ValueError("the file ends inside a record")
        self.raw = b""
        self.ready += self.inflate.decompress(data, CHUNK)
        if self.inflate.eof:
            self.raw = self.inflate.unused_data
        return True

    def head(self) -> dict[str, str]:
        """Lines up to an empty one; names in lower case, the first line under ''."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > LONGEST_HEAD or not self.more():
                raise ValueError("a head does not end")
        first, *lines = bytes(self.ready[:end]).decode("utf-8", "replace").split("\r\n")
        del self.ready[:end + 4]
        pairs = (line.partition(":") for line in lines)
        return {"": first} | {k.strip().lower(): v.strip() for k, _, v in pairs}

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        while not self.ready:
            if not self.more():
                raise ValueError("a record is shorter than its content length")
        part = bytes(self.ready[:most])
        del self.ready[:most]
        return part


def read_records(stream: BinaryIO, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive in order.

    The content length frames a block; its digest and that of the payload are verified while it
    streams by. Without ``payloads`` memory is bounded by a chunk and a head, however long a record.
    ``error`` says what is wrong with a record, else it is null. After damage to the compression or
    the framing nothing more of the file can be trusted: a last record reports it.
    """
    members = Members(stream)
    try:
        while members.begin():
            head = members.head()
            if not head[""].startswith("WARC/"):
                raise ValueError("no WARC record")
            left = int(head["content-length"])
            block, body, http = hashlib.sha1(), hashlib.sha1(), bytearray()
            kept, size, in_body = bytearray(), 0, False
            while left:
                part = members.take(min(left, CHUNK))
                left -= len(part)
                block.update(part)
                if not in_body:
                    http += part
                    if (end := http.find(b"\r\n\r\n")) < 0:
                        continue
                    part, in_body = bytes(http[end + 4:]), True
                    del http[end:]
                body.update(part)
                size += len(part)
                if payloads:
                    kept += part
            while members.more():
                pass
            if members.ready != b"\r\n\r\n":
                raise ValueError("a record does not end with its block")
            revisit = head.get("warc-type") == "revisit"
            told = {k.strip().lower(): v.strip() for k, _, v in
                    (x.partition(":") for x in http.decode("latin-1").split("\r\n"))}
            name = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
            wrong = None
            if head.get("warc-block-digest", name(block)) != name(block):
                wrong = "block digest"
            elif not revisit and head.get("warc-payload-digest", name(body)) != name(body):
                wrong = "payload digest"
            yield {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"),
                   "refers_to": head.get("warc-refers-to"), "url": head.get("warc-target-uri"),
                   "payload_bytes": int(told.get("content-length", size)) if revisit else size,
                   "payload_digest": head.get("warc-payload-digest", name(body)).removeprefix("sha1:"),
                   "payload": bytes(kept) if payloads and not revisit else None, "error": wrong}
    except (ValueError, KeyError, zlib.error) as damage:
        yield {"error": f"damaged: {damage}"}


def write_archives(rows: DataFrame, folder: str, most_bytes: int = 256 << 20) -> DataFrame:
    """Write ``(page, url, html, kind, original)`` as archives under ``folder``; a manifest comes
    back, one row per file. A task opens a new file after ``most_bytes``. File names hold the task's
    attempt, so a repeated or lost task leaves files that no manifest names, and readers see each
    record once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        attempt, out, path, size, count, number = TaskContext.get().taskAttemptId(), None, "", 0, 0, 0
        done = []
        for batch in batches:
            for page, url, html, kind, original in batch.itertuples(index=False):
                if out is None:
                    path = f"{root}/part-{attempt:010d}-{number:04d}.warc.gz"
                    out, size, count, number = store.open_output_stream(path), 0, 0, number + 1
                data = record(kind, page, url, html.encode(), original)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= most_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return cut(rows.select("page", "url", "html", "kind", "original")
               .mapInPandas(run, "path string, records long, bytes long"))


RECORD = ("record_id string, record_type string, refers_to string, url string, payload_bytes long, "
          "payload_digest string, payload binary, error string, path string")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the files a manifest names, one file after another in each task."""
    names = [part.split()[0] for part in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for found in read_records(stream, payloads):
                        rows.append(found | {"path": path})
                        held += len(found.get("payload") or b"")
                        if len(rows) >= 1000 or held >= 16 << 20:
                            yield pd.DataFrame(rows).reindex(columns=names).astype({"payload_bytes": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names).astype({"payload_bytes": "Int64"})

    parts = max(1, min(manifest.count(), 100_000))
    return manifest.select("path").repartition(parts, "path").mapInPandas(run, RECORD)


def deduplicated(pages: DataFrame, id: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """``(page, url, html, kind, original)``: of pages with equal payloads of at least
    ``least_bytes`` bytes, that with the largest id is the response, the others revisit it."""
    clean = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "")
    base = (pages.select(F.col(id).alias("id"), clean.alias("url"),
                         F.coalesce(F.col(html), F.lit("")).alias("html"))
            .withColumn("digest", F.sha1(F.col("html").cast("binary"))))
    newest = cut(base.groupBy("digest").agg(F.max("id").alias("newest")))
    again = (F.octet_length("html") >= least_bytes) & F.coalesce(
        ~F.col("id").eqNullSafe(F.col("newest")), F.lit(False))
    return base.join(newest, "digest").select(
        F.coalesce(F.col("id").cast("string"), F.lit("none")).alias("page"), "url", "html",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("newest").cast("string")).alias("original"))


def archive_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
                  least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write one record per row of ``pages``, read the archives back, and return a row per record.

    Equal payloads are found by SHA-1 with map-side maxima; the join's hot digests can be split.
    Null html is an empty payload; repeated rows with the largest id are all responses; a null id
    is smaller than any other (all null: all are responses); null urls are empty; an empty table
    gives no rows. Other columns are not read. Columns: id, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``, ``error`` (null when both digests hold), ``payload`` (only with
    ``payloads``).
    """
    folder = f"{shared_folder(pages.sparkSession)}/cairn/warc-{uuid.uuid4().hex}"
    manifest = write_archives(deduplicated(pages, id, url, html, least_bytes), folder)
    kind = dict(pages.dtypes)[id]
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    columns = [page("record_id").alias(id), "payload_bytes", "payload_digest", "record_type",
               F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"), "error"]
    return read_archives(manifest, folder, payloads).select(*columns, *["payload"] * payloads)
