"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record, and read back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from glosswork.llm.storage import materialise

VERSION = b"WARC/1.1"
SAME_PAYLOAD = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
ARCHIVE_BYTES = 64 << 20
SALTS = 32
RECORDS_A_TASK = 2000

_INDEX = "archive string, offset long, length long, record_type string, page_id long, refers_to long, payload_digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int) -> bytes:
    return b"<urn:page:%d>" % page_id


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%s: %s\r\n" % h for h in [*headers, (b"Content-Length", b"%d" % len(block))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload if ``refers_to`` names the page that has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = b"response" if refers_to is None else b"revisit"
    name = _urn(page_id) if page_id is not None else b"<urn:uuid:%s>" % str(uuid.uuid4()).encode()
    headers = [(b"WARC-Type", kind), (b"WARC-Record-ID", name), (b"WARC-Date", DATE)]
    if url is not None:
        headers.append((b"WARC-Target-URI", re.sub(r"\s", "", url).encode("utf-8", "replace")))
    headers.append((b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode()))
    if refers_to is not None:
        headers += [(b"WARC-Refers-To", _urn(refers_to)), (b"WARC-Profile", SAME_PAYLOAD)]
    headers.append((b"Content-Type", b"application/http;msgtype=response"))
    return _record(headers, http if refers_to is not None else http + payload)


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) to archives below ``folder``; returns (archive, records, bytes).

    Each task writes its rows to archives of at most about ``archive_bytes``, each one gzip stream from start to end. An
    attempt writes under names of its own, and only the names of attempts that succeeded are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_folder(folder)
        store.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.whole.warc.gz"
                    out, gz, records, size = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    info = _record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:uuid:%s>" % str(uuid.uuid4()).encode()), (b"WARC-Date", DATE), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(gz.compress(info))
                data = page_record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                out.write(gz.compress(data))
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [path], "records": [records], "bytes": [size]})
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": [records], "bytes": [size]})

    rows = pages.select(F.col("page_id").cast("long"), "url", F.col("payload").cast("binary"), F.col("refers_to").cast("long"))
    return rows.mapInArrow(run, "archive string, records long, bytes long")


class _Inflated:
    """The bytes of a gzip file, of one member or many, read once from start to end."""

    def __init__(self, stream):
        self.stream, self.inflate, self.ready, self.over = stream, zlib.decompressobj(31), b"", False

    def _more(self) -> None:
        data = self.inflate.unused_data or self.stream.read(READ_BYTES)
        if self.inflate.eof:
            if not data:
                self.over = True
                return
            self.inflate = zlib.decompressobj(31)
        elif not data:
            raise ValueError("the archive ends inside a gzip member")
        self.ready += self.inflate.decompress(data)

    def head(self) -> bytes | None:
        """The lines up to an empty one, or None at the end."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0 and not self.over:
            self._more()
        if end < 0:
            if self.ready.strip():
                raise ValueError("the archive ends inside a record's headers")
            return None
        found, self.ready = self.ready[: end + 4], self.ready[end + 4 :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            while not self.ready:
                if self.over:
                    raise ValueError("the archive ends inside a record")
                self._more()
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def parse_headers(head: bytes) -> dict[bytes, bytes]:
    """Lower-cased names to values of the header lines after the first."""
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page_of(urn: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?[0-9]+)>", urn or b"")
    return int(found[1]) if found else None


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite whole-file gzip archives with one member a record, beside a sidecar index; returns the index's rows.

    Each archive is inflated once, as a stream: a record is copied piece by piece to its member, so memory holds about a
    megabyte whatever the size of records and archives. The sidecar (JSON lines, ``.index.jsonl``) has the same
    columns as the returned rows: (archive, offset, length, record_type, page_id, refers_to, payload_digest).
    """

    def rewrite(source: str, store: fs.FileSystem, root: str) -> pa.RecordBatch:
        target = f"{root}/{uuid.uuid4().hex}.warc.gz"
        rows = []
        with store.open_input_stream(source, compression=None) as stream, store.open_output_stream(target, compression=None) as out:
            whole = _Inflated(stream)
            while (head := whole.head()) is not None:
                headers, start = parse_headers(head), out.tell()
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(gz.compress(head))
                for part in whole.take(int(headers[b"content-length"]) + 4):
                    out.write(gz.compress(part))
                out.write(gz.flush())
                rows.append({
                    "archive": target, "offset": start, "length": out.tell() - start, "record_type": headers[b"warc-type"].decode(),
                    "page_id": _page_of(headers.get(b"warc-record-id")), "refers_to": _page_of(headers.get(b"warc-refers-to")),
                    "payload_digest": headers.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None,
                })
        with store.open_output_stream(target.removesuffix(".warc.gz") + ".index.jsonl", compression=None) as side:
            side.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_folder(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield rewrite(source, store, root)

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, _INDEX)  # an archive a task


def read_indexed(index: DataFrame, folder: str) -> DataFrame:
    """Read every response and revisit record by its offset: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Bytes and digest are those of the full payload: of a revisit, as its headers give them. A response whose payload does
    not have the digest its headers give raises ValueError. Records of other types are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open_folder(folder)
        name = handle = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["archive"] != name:
                    if handle is not None:
                        handle.close()
                    name, handle = r["archive"], store.open_input_file(r["archive"])
                handle.seek(r["offset"])
                data = zlib.decompress(handle.read(r["length"]), 31)
                head, _, rest = data.partition(b"\r\n\r\n")
                headers = parse_headers(head)
                block = rest[: int(headers[b"content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
                kind = headers[b"warc-type"].decode()
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"a record of {name} does not have its digest")
                size = len(payload) if kind == "response" else int(parse_headers(http)[b"content-length"])
                rows.append((_page_of(headers.get(b"warc-record-id")), size, digest, kind, _page_of(headers.get(b"warc-refers-to"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    records = index.where(F.col("record_type").isin("response", "revisit"))
    records = records.repartition(1 + index.count() // RECORDS_A_TASK, "archive").sortWithinPartitions("archive", "offset")
    return records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to) of (page_id, url, html): the page of smallest id with the same payload, or null.

    A null html is an empty payload; empty payloads count as equal too. A page refers to another only if that has a
    smaller id, so repeated rows of one id are all responses, and so are rows without an id. Payloads of several
    pages are found by a partial aggregation over digests, and only those meet the pages again, dealt over salts,
    so a payload that a third of all pages share is spread over 32 parts.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    shared = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("sha1", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = materialise(shared, "warc-shared")  # its size is known then, and payloads are only shuffled if it is large
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    return rows.join(shared, ["sha1", "salt"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def archive(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages to whole-file archives, normalise these, and return the index of the normalised archives.

    ``folder`` must be one that every worker can write to and that PyArrow can open. Both manifests are written tables, so
    losing an executor later neither loses nor repeats an archive. No pages give no archives and no rows.
    """
    whole = materialise(write_monolithic(with_revisits(pages), f"{folder}/whole", archive_bytes), "warc-archives")
    return materialise(normalise(whole, f"{folder}/records"), "warc-index")
