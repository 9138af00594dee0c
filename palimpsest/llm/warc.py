"""WARC archives in dictionary-compressed Zstandard, and their reader.

Each partition of pages becomes one archive or several: a skippable frame with a dictionary built from the archive's own records,
a warcinfo record, then every record as a Zstandard frame of its own. A task closes an archive at a number of bytes: it fills
the archive's rows up with empty ones, and the writer, which starts a file at a fixed number of rows, starts the next. Equal payloads (by SHA-1 and length) are stored once: the row with the smallest
identifier is a response, the others are revisit records that refer to it. Archives are written by Spark's own writer,
row by row, so that any file system and any lost executor is handled by its commit protocol. That writer ends each row
with a line feed; here this byte is the content of a one-byte skippable frame which closes the row.

Defined results: a null payload is empty; rows that repeat the smallest identifier of a payload are all responses; a
null identifier sorts after all others, and where all are null all rows are responses; record identifiers hold identifier and
digest, so that only rows that repeat both share one; a null date, or no column of dates, gives the start of 1970; payloads shorter than `least` are never revisits; an empty table gives an
empty archive folder and an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from base64 import b32encode
from collections import deque
from collections.abc import Callable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_values, materialize, tune

#: Fixed values of the format: the magic number of the dictionary's frame, and a skippable frame of one byte without that byte.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
ROW_END = (0x184D2A50).to_bytes(4, "little") + (1).to_bytes(4, "little")
#: Bytes of records from which an archive's dictionary is built, and the dictionary's largest size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
#: Compressed bytes at which an archive is closed, and rows of a full one. A reader holds one archive at a time.
ARCHIVE_BYTES, ARCHIVE_ROWS = 64 << 20, 1 << 16
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _whole(fields: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str | None = None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    stated = digest(payload)

    def urn(page: int | None) -> str:
        return f"<urn:page:{'' if page is None else page}:{stated}>"

    fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date or DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + " ".join(url.split()))
    fields.append(f"WARC-Payload-Digest: sha1:{stated}")
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    return _whole([*fields, "Content-Type: application/http; msgtype=response"], head if revisit else head + payload)


def info(partition: int, number: int) -> bytes:
    """The record that opens an archive."""
    fields = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{partition}:{number}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"]
    return _whole(fields, b"software: palimpsest\r\nformat: WARC File Format 1.1\r\n")


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    import zstandard

    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(4096, sum(map(len, samples)) // 16)), samples, k=256, d=8, f=20, accel=4).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[: DICTIONARY_BYTES // 4]


def _archives(most: int, rows_each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    import zstandard

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            ids, urls, dates, first, again = (b.column(k).to_pylist() for k in ("page_id", "url", "date", "first", "again"))
            for i, u, d, p, f, a in zip(ids, urls, dates, binary_values(b.column("html")), first, again, strict=True):
                yield record(i, u, p, f, a, d)

    def rows(source: Iterator[bytes]) -> Iterator[bytes]:
        context = TaskContext.get()
        partition, number = context.partitionId() if context else 0, 0
        ahead: deque[bytes] = deque()  # records read for the dictionary and not yet written
        size = 0
        while True:
            while size < SAMPLE_BYTES and (r := next(source, None)) is not None:
                ahead.append(r)
                size += len(r)
            if not ahead:
                return
            raw = build_dictionary([r[: 128 << 10] for r in ahead])
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=3)
            packer = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=True)
            yield DICTIONARY_MAGIC + len(raw).to_bytes(4, "little") + raw + ROW_END
            yield packer.compress(info(partition, number)) + ROW_END
            written, count, number = 0, 2, number + 1
            while written < most and count < rows_each:
                r = ahead.popleft() if ahead else next(source, None)
                if r is None:
                    return
                yield (x := packer.compress(r) + ROW_END)
                written, count = written + len(x), count + 1
            size = sum(map(len, ahead))
            if not ahead:
                if (r := next(source, None)) is None:
                    return
                ahead.append(r)
                size = len(r)
            for _ in range(rows_each - count):
                yield ROW_END

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[bytes] = []
        size = 0
        for x in rows(records(batches)):
            some.append(x)
            size += len(x)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["data"])
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["data"])

    return archives


def write_warc(
    pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES, archive_rows: int = ARCHIVE_ROWS,
) -> None:
    """Writes the archives of every partition of `pages` into the folder `path`.

    date_col: a timestamp, stated in UTC. archive_bytes, archive_rows (3 at least): compressed bytes at which an archive is closed, and
    rows after which the next begins; a dictionary and a warcinfo record are two of them.
    """
    if archive_rows < 3:
        raise ValueError("an archive has three rows at least")
    tune(pages.sparkSession)
    date = F.lit(None).cast("string") if date_col is None else F.date_format(F.to_utc_timestamp(F.col(date_col).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), date.alias("date"))
    marked = rows.withColumns({"digest": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    shared = materialize(marked.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    joined = marked.join(shared, ["digest", "size"], "left")
    again = F.col("times").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select("page_id", "url", "html", "date", "first", again.alias("again")).mapInArrow(_archives(archive_bytes, archive_rows), "data binary")
    out.select(F.col("data").cast("string")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", archive_rows).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def open_archive(content: bytes | memoryview) -> io.BufferedReader:
    import zstandard

    dictionary = None
    if bytes(content[:4]) == DICTIONARY_MAGIC:
        size = int.from_bytes(content[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(bytes(content[8 : 8 + size]))
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(content, read_across_frames=True), 1 << 20)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of every response and revisit below `path`."""
    tune(spark)

    def number(urn: str | None) -> int | None:
        found = (urn or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
        return int(found) if found else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for content in b.column("content"):
                found, size = [], 0
                for fields, block in parse(open_archive(memoryview(content.as_buffer()))):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or digest(payload) != stated):
                        raise ValueError(f"damaged record {fields['warc-record-id']}")
                    keep = payload if payloads and kind == "response" else None
                    found.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), length, stated, keep))
                    size += len(keep or b"")
                    if size > 8 << 20 or len(found) >= 20_000:
                        yield batch(found)
                        found, size = [], 0
                if found:
                    yield batch(found)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
