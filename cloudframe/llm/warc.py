"""WARC archives through a table of payload chunks.

A payload is streamed as rows of record identifier and chunk number, each with the SHA-1 of the
payload up to and including that chunk, so no step holds a whole record. Archives are gzip members,
one a record, in files that the tasks write to the shared folder; a manifest lists the files of the
tasks that ended, and only those are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path
from .common import HOT_SHARE, binary, save

CHUNK = 1 << 18
#: Payload bytes that a batch of chunks holds at most (or one chunk).
BATCH = 4 << 20
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(folder: str):
    """The file system of a folder, which may be a local path or a URI, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder[5:]
    return fs.FileSystem.from_uri(folder)


def sha1_name(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _chunks(size: int, with_data: bool):
    """Rows ``row, page_id, url, chunk, last, size, whole, bytes, digest[, data]`` (see ``chunk_table``)."""

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = binary(batch.column(2))
            source: list[int] = []
            out: list[list] = [[] for _ in range(7 + with_data)]
            held = 0

            def flush():
                rows = pa.array(source, pa.int64())
                types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                columns = [pa.array(v, t) for v, t in zip(out, types)]  # noqa: B905  data may be left out
                names = ["row", "chunk", "last", "size", "whole", "bytes", "digest", "data"][: len(columns)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=["page_id", "url", *names])

            for k in range(len(texts)):
                view = memoryview(texts[k].as_buffer())
                running, digests = hashlib.sha1(), []
                places = range(0, max(len(view), 1), size)
                for at in places:
                    running.update(view[at : at + size])
                    digests.append(running.digest())
                for n, at in enumerate(places):
                    part = view[at : at + size]
                    if with_data and source and held + len(part) > BATCH:
                        yield flush()
                        source, out, held = [], [[] for _ in out], 0
                    source.append(k)
                    values = (row, n, at + size >= len(view), len(view), digests[-1], at + len(part), digests[n], part)
                    for column, value in zip(out, values):  # noqa: B905  data may be left out
                        column.append(value)
                    held += len(part)
                row += 1
            if source:
                yield flush()

    return run


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of ``pages(page_id, url, html)``.

    A row per ``chunk_bytes`` of payload: ``row`` (told apart within this table), ``page_id, url,
    chunk`` (its number), ``last``, ``bytes`` and ``digest`` (payload bytes and SHA-1 up to its
    end), ``size`` and ``whole`` (those of the whole payload) and ``data``. A null or empty payload
    is one empty chunk.
    """
    fields = "page_id long, url string, row long, chunk int, last boolean, size long, whole binary, bytes long, digest binary" + ", data binary" * with_data
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(_chunks(chunk_bytes, with_data), fields)


def header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda v: " ".join(v.split())  # noqa: E731  no line breaks in a field
    return VERSION + b"\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in fields) + b"\r\n"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _write(folder: str, date: str):
    def run(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out = gz = None
        records = 0
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            ids, urls, numbers, ends, sizes, firsts, digests = (c[n].to_pylist() for n in ("page_id", "url", "chunk", "final", "size", "first", "whole"))
            for k in range(batch.num_rows):
                response = firsts[k] is None
                if numbers[k] == 0:
                    if out is None:
                        system, path = _filesystem(folder)
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", _record_id(ids[k])), ("WARC-Date", date), ("WARC-Target-URI", urls[k] or ""), ("WARC-Payload-Digest", f"sha1:{sha1_name(digests[k])}"), ("X-Page-ID", "" if ids[k] is None else str(ids[k])), ("X-Payload-Length", str(sizes[k]))]
                    if not response:
                        fields += [("WARC-Refers-To", _record_id(firsts[k])), ("X-Refers-To-Page", str(firsts[k])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(HTTP) + sizes[k] * response))]
                    out.write(gz.compress(header(fields) + HTTP))
                if response:
                    out.write(gz.compress(memoryview(c["data"][k].as_buffer())))
                if ends[k]:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files into ``folder``; returns the manifest ``file, records``.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    ``page_id`` is a response and the others are revisits of it; smaller payloads are all responses.
    A first pass keeps digests only; they are grouped with partial aggregation. Payloads that one in
    ``HOT_SHARE`` records or more have are known to every task, at most ``HOT_SHARE`` of them, and
    their revisits lose the payload before anything moves. Then chunks move once, to the digests
    they are joined with, and are streamed to the files by record in chunk order.

    A null payload is empty. A page with a null id is a response if no page with an id has its
    payload, else a revisit. Repeated rows are records of their own; if theirs is the smallest id,
    all of them are responses. The manifest is written to the shared folder and lists the files of
    tasks that ended well. Empty in, no file. Other columns are not read.
    """
    heads = chunk_table(pages, chunk_bytes, with_data=False).where("last").select("page_id", F.col("bytes").alias("size"), F.col("digest").alias("whole"))
    counted = save(heads.groupBy("whole", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    shared = counted.where((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull())
    most = max(2, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = shared.where(F.col("n") >= most).select("whole", "size", F.col("first").alias("hot"))
    first = lambda c: F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col(c)), F.col(c))
    chunks = chunk_table(pages, chunk_bytes).join(F.broadcast(hot), ["whole", "size"], "left").withColumn("known", F.col("hot").isNotNull()).withColumn("hot", first("hot"))
    chunks = chunks.where("hot is null or chunk = 0").withColumn("data", F.when(F.col("hot").isNull(), F.col("data")))
    # Chunks move once, by payload; those that are decided by their own record, so that no payload gathers in one task.
    chunks = chunks.withColumn("key", F.when(F.col("known"), F.unhex(F.hex("row"))).otherwise(F.col("whole")))
    rest = shared.where(F.col("n") < most).select(F.col("whole").alias("key"), "size", "first").hint("shuffle_hash")
    chunks = chunks.join(rest, ["key", "size"], "left").withColumn("first", F.coalesce("hot", first("first")))
    chunks = chunks.where("first is null or chunk = 0").select(
        "row", "page_id", "url", "chunk", "size", "whole", "first",
        F.when(F.col("first").isNull(), F.col("data")).alias("data"), (F.col("last") | F.col("first").isNotNull()).alias("final"),
    )
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    ordered = chunks.sortWithinPartitions("row", "chunk")
    return save(ordered.mapInArrow(_write(folder, date), "file string, records long"), "manifest")


class _Stream:
    """Bytes of a gzip file, read and inflated piece by piece."""

    def __init__(self, source):
        self.source, self.gz, self.held, self.done = source, zlib.decompressobj(31), b"", False

    def fill(self) -> bool:
        while not self.done:
            if self.gz.eof:
                rest = self.gz.unused_data
                self.gz = zlib.decompressobj(31)
            else:
                rest = self.gz.unconsumed_tail
            rest = rest or self.source.read(1 << 18)
            if not rest:
                self.done = True
                break
            if data := self.gz.decompress(rest, 1 << 20):
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.fill():
                if self.held:
                    raise ValueError("a WARC file ends within a record")
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, count: int):
        """The next ``count`` bytes, in pieces."""
        while count:
            if not self.held and not self.fill():
                raise ValueError("a WARC file ends within a payload")
            part, self.held = self.held[:count], self.held[count:]
            count -= len(part)
            yield part


def _read(folder: str):
    def run(batches):
        system, path = _filesystem(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as source:
                    stream = _Stream(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        first, *lines = head.decode("utf-8").split("\r\n")
                        if first.encode() != VERSION:
                            raise ValueError(f"{name}: {first!r} begins no record")
                        field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                        http = stream.until(b"\r\n\r\n")
                        size, digest = int(field["Content-Length"]) - len(http) - 4, hashlib.sha1()
                        for part in stream.take(size):
                            digest.update(part)
                        if stream.until(b"\r\n\r\n") != b"":
                            raise ValueError(f"{name}: a record has another length than it says")
                        named = field["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = field["WARC-Type"] == "response"
                        if response and (sha1_name(digest.digest()) != named or size != int(field["X-Payload-Length"])):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, refers = field["X-Page-ID"], field.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, int(field["X-Payload-Length"]), named, field["WARC-Type"], int(refers) if refers else None, field["WARC-Target-URI"]))
                if len(rows) != records:
                    raise ValueError(f"{name} holds {len(rows)} records; the manifest has {records}")
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files of a manifest back: a row per record, with digests taken from the payloads as they stream by.

    A task reads one file or a few. Raises if a payload differs from its digest or a file from its
    manifest row.
    """
    tasks = max(2 * manifest.count(), 2)
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return manifest.select("file", "records").repartition(tasks, "file").mapInArrow(_read(folder), fields)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to WARC files (in a new folder of the shared one unless given) and read them back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes, chunk_bytes), folder)
