"""WARC archives: a writer of one gzip member per record and a sequential reader.

Every task writes archives of its own in a folder that all executors share, under names that hold
the partition and the attempt; only those that the finished tasks report are read back, so a lost
or repeated task leaves no doubled record. The reader streams: it decompresses member by member in
small pieces, takes each payload by its Content-Length, and compares the stated digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import materialised, record, utf8

#: Bytes read and decompressed at a time.
CHUNK = 1 << 16
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2020-01-01T00:00:00Z"
BREAK, END = b"\r\n", b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value: line ends would start another header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member: version line, headers, block."""
    lines = [VERSION, *(f"{k}: {clean(v)}".encode() for k, v in headers.items())]
    lines.append(f"Content-Length: {len(block)}".encode())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    body = BREAK.join(lines) + END + block + END
    return packer.compress(body) + packer.flush()


def read_members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """For every gzip member of a stream an iterator of its decompressed pieces (use each up)."""
    rest = stream.read(chunk)
    while rest:
        state = {"rest": rest}

        def pieces(state=state) -> Iterator[bytes]:
            packer, data = zlib.decompressobj(31), state["rest"]
            while not packer.eof:
                if not data:
                    data = stream.read(chunk)
                    if not data:
                        raise ValueError("the archive ends within a member")
                out = packer.decompress(data, chunk)
                data = packer.unconsumed_tail
                if out:
                    yield out
            state["rest"] = packer.unused_data

        yield pieces()
        rest = state["rest"] or stream.read(chunk)


def parse_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of a member; its length must be as stated."""
    data = bytearray()
    for piece in pieces:
        data += piece
    head = data.find(END)
    if head < 0 or not data.startswith(VERSION + BREAK):
        raise ValueError("not a WARC record")
    headers = {}
    for line in data[:head].decode().split("\r\n")[1:]:
        key, _, value = line.partition(":")
        headers[key.strip().lower()] = value.strip()
    n = int(headers["content-length"])
    if len(data) != head + len(END) + n + len(END) or not data.endswith(END):
        raise ValueError(f"Content-Length says {n}, the member holds {len(data) - head - 2 * len(END)}")
    return headers, bytes(data[head + len(END) : head + len(END) + n])


def _write_rows(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        stem = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, name, size, records, number = None, "", 0, 0, 0

        def closed():
            out.close()
            return record(path=pa.array([name]), records=pa.array([records], pa.int64()), bytes=pa.array([size], pa.int64()))

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("id", "url", "first", "digest"))
            for page, url, first, digest, html in zip(*cols, utf8(batch.column("html")), strict=True):
                stated = base64.b32encode(bytes.fromhex(digest)).decode()
                if out is None:
                    name, size, records = f"{stem}-{number:04d}.warc.gz", 0, 0
                    out, number = store.open_output_stream(name, compression=None), number + 1
                headers = {
                    "WARC-Type": "response" if first is None else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
                    "WARC-Date": WHEN,
                    "WARC-Target-URI": url or "",
                    "X-Page-ID": "" if page is None else str(page),
                    "WARC-Payload-Digest": f"sha1:{stated}",
                    "X-Payload-Length": str(len(html or b"")),
                }
                if first is not None:
                    headers |= {"WARC-Profile": PROFILE, "X-Refers-To-Page": str(first)}
                member = warc_record(headers, (html or b"") if first is None else b"")
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def payload_bytes(payload_col: str) -> Column:
    """The payload in UTF-8; empty for null."""
    return F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))


def payload_firsts(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, digest, first): ids and payloads (SHA-1 in hexadecimal) of which a smaller id, first, has
    an equal payload of at least least_bytes bytes."""

    payload = payload_bytes(payload_col)
    digests = materialised(
        pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    )
    smallest = digests.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    smallest = materialised(smallest.where("n > 1").select("digest", "low"))
    return (
        digests.where("id is not null").join(smallest, "digest")
        .where((F.col("n") >= least_bytes) & (F.col("low") < F.col("id")))
        .select("id", "digest", F.col("low").alias("first")).distinct()
    )


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, archive_bytes: int = 128 << 20,
) -> DataFrame:
    """Write a record per row into archives below folder (a new shared one by default).

    Returns the manifest (path, records, bytes). Of rows with equal payloads of at least
    least_bytes bytes, the one with the smallest id is a response with the payload, the others
    are revisits without it. Null payloads are empty; null urls are empty; a row with a null id is
    always a response. Rows that share an id and payload are all alike; rows that share an id only
    are judged each by their payload. Ids are integers.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = store.makeQualified(path).toUri().toString()  # a folder without scheme is the default store's
    store.mkdirs(path)
    firsts = payload_firsts(pages, id_col, payload_col, least_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("html"))
    joined = rows.withColumn("digest", F.sha1(payload_bytes("html"))).join(firsts, ["id", "digest"], "left")
    ready = joined.select("id", "url", "html", "first", "digest")
    return materialised(ready.mapInArrow(_write_rows(folder, archive_bytes), "path string, records long, bytes long")).withColumn(
        "folder", F.lit(folder)
    )


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, digest_ok boolean, path string"


def read_warc(manifest: DataFrame, with_payload: bool = True, verify_revisits: bool = False) -> DataFrame:
    """Every record of the archives of a manifest (path, records, bytes, folder), one archive at a
    time in a task.

    digest_ok says whether a response's payload has the stated digest; for a revisit, which has no
    payload, it is null or, with verify_revisits, whether the response with its digest is among the archives under the page it refers
    to. payload_bytes is the length of the full payload, also for revisits. A truncated archive (also
    one that ends between members), a record of another length than stated or without the version
    line is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, folder: str, records: int, size: int) -> Iterator[tuple]:
            store, _ = fs.FileSystem.from_uri(folder)
            seen, has = 0, store.get_file_info(path).size
            if has != size:
                raise ValueError(f"{path} has {has} bytes, the manifest says {size}")
            with store.open_input_stream(path, compression=None, buffer_size=CHUNK) as stream:
                for pieces in read_members(stream):
                    h, block = parse_record(pieces)
                    seen += 1
                    stated = h["warc-payload-digest"].removeprefix("sha1:")
                    response = h["warc-type"] == "response"
                    page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                    yield (
                        int(page) if page else None, h.get("warc-target-uri"), h["warc-type"], int(refers) if refers else None,
                        stated, len(block) if response else int(h["x-payload-length"]), block if response and with_payload else None,
                        payload_digest(block) == stated if response else None, path,
                    )
            if seen != records:
                raise ValueError(f"{path} has {seen} records, the manifest says {records}")

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
        names = [x.split()[0] for x in FIELDS.split(", ")]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for archive in zip(*(batch.column(c).to_pylist() for c in ("path", "folder", "records", "bytes")), strict=True):
                held, size = [], 0
                for row in rows(*archive):
                    held.append(row)
                    size += len(row[6] or b"") + 200
                    if size > 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.select("path", "folder", "records", "bytes").repartition(tasks, "path").mapInArrow(run, FIELDS)
    if not verify_revisits:
        return found
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.lit(True).alias("there")).distinct()
    checked = found.join(responses, ["refers_to", "payload_digest"], "left")
    ok = F.when(F.col("record_type") == "revisit", F.coalesce("there", F.lit(False))).otherwise(F.col("digest_ok"))
    return checked.withColumn("digest_ok", ok).select([x.split()[0] for x in FIELDS.split(", ")])
