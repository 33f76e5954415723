"""WARC archives: monolithic gzip files, their normalisation to one member per record, and reading by offset.

``write_archives`` lets Spark's text writer produce whole-file gzip streams: a record is one value and the record
separator is the line separator, so the stream is a plain WARC file under one gzip member. ``normalise`` inflates each
such stream once, in chunks, rewrites every record as a gzip member of its own and leaves a sidecar index of offsets
beside the file. ``read_records`` seeks by that index and inflates single members.

Defined results: a null or empty payload is written as a record of zero bytes. A null page id or address leaves its
header out. Of equal payloads of at least ``revisit_from`` bytes the record with the largest page id (nulls lowest, the
later row on ties) is the response, every other row, repeated rows included, is a revisit of it. An empty table gives
no records. Further columns are not archived.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.batches import pieces
from evalspark.llm.files import local_uri, open_fs
from evalspark.llm.frames import frame
from evalspark.session import scratch_path

SEPARATOR = "\r\n\r\n"
_CHUNK = 1 << 20
# Fixed value: the archives carry one date, so that a repeated task writes the same bytes.
RECORD_DATE = "2024-01-01T00:00:00Z"
_HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string"
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
)


def with_record_types(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, refers_to, revisit)`` per page.

    Payloads meet by digest. The winner of a digest is a partial aggregate; the pages then join the winners of
    repeated payloads only, and adaptive execution splits a payload that holds many rows.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("id"), F.col("_row"))
    winners = (
        rows.filter(F.col("payload_bytes") >= revisit_from)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("page_id", "_row"), order).alias("_first"))
        .filter("_n > 1")
        .select("payload_digest", "_first")
    )
    revisit = F.col("_first").isNotNull() & (F.col("_first._row") != F.col("_row"))
    return rows.join(winners, "payload_digest", "left").select(
        "page_id",
        "url",
        F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.col("_first.page_id")).alias("refers_to"),
        F.coalesce(revisit, F.lit(False)).alias("revisit"),
    )


# Fixed value: what the standard calls a revisit record of an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value) -> F.Column:
    """``name: value`` and a line end, or nothing for a null value; control characters are percent-encoded."""
    text = value.cast("string")
    for code in (13, 10):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit("\r\n")), F.lit(""))


def write_archives(typed: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write one WARC record per row as gzip text files below ``path``, each file one gzip stream."""
    revisit = F.col("revisit")
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP_HEAD), F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        F.lit(f"WARC-Date: {RECORD_DATE}\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n")).otherwise(""),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(SEPARATOR),
        block,
    )
    (
        typed.select(record.alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not the head of a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:])


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, chunk by chunk."""
    inflater = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            data = inflater.decompress(chunk, _CHUNK)
            if data:
                yield data
            chunk = inflater.unconsumed_tail
            if inflater.eof:
                chunk, inflater = inflater.unused_data, zlib.decompressobj(31)
    rest = inflater.flush()
    if rest:
        yield rest


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, whole record bytes)`` of each record; the buffer holds little more than one record."""
    buffer = bytearray()
    ended = False

    def fill(size: int) -> bool:
        nonlocal ended
        while len(buffer) < size and not ended:
            part = next(stream, None)
            if part is None:
                ended = True
            else:
                buffer.extend(part)
        return len(buffer) >= size

    while fill(1):
        head_end = buffer.find(b"\r\n\r\n")
        while head_end < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("WARC head without an end")
            head_end = buffer.find(b"\r\n\r\n")
        headers = parse_head(bytes(buffer[:head_end]))
        size = head_end + 4 + int(headers["Content-Length"]) + 4
        if not fill(size) or buffer[size - 4 : size] != b"\r\n\r\n":
            raise ValueError("WARC record cut short")
        yield headers, bytes(buffer[:size])
        del buffer[:size]


def _chunks(fs: pyarrow.fs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as source:
        while part := source.read(_CHUNK):
            yield part


def _publish(fs: pyarrow.fs.FileSystem, part: str, path: str) -> None:
    """Give a complete file its name. What a lost attempt of the same task left there has the same content and makes way, as not every store
    moves onto a file that exists."""
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


def _normalise_file(source: str, target: str, attempt: str) -> Iterator[dict]:
    """Rewrite one archive member by member; both files appear under their names only when complete."""
    fs, src = open_fs(source)
    out_fs, dst = open_fs(target)
    offset, index = 0, []
    with out_fs.open_output_stream(f"{dst}.{attempt}", compression=None) as out:
        for headers, record in split_records(inflate(_chunks(fs, src))):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(record) + packer.flush()
            out.write(member)
            index.append(
                {
                    "archive": target,
                    "offset": offset,
                    "length": len(member),
                    "record_id": headers.get("WARC-Record-ID"),
                    "record_type": headers["WARC-Type"],
                }
            )
            offset += len(member)
    with out_fs.open_output_stream(f"{dst}.idx.{attempt}", compression=None) as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    _publish(out_fs, f"{dst}.{attempt}", dst)
    _publish(out_fs, f"{dst}.idx.{attempt}", f"{dst}.idx.json")
    yield {"archive": target, "records": len(index), "bytes": offset}


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise every archive below ``source`` into ``target``; the index rows, read from the sidecars."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "length")
    )
    fs, root = open_fs(target)
    fs.create_dir(root, recursive=True)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = f"attempt-{TaskContext.get().taskAttemptId()}"
        for frame in batches:
            for path in frame["path"]:
                name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt")
                yield pd.DataFrame(list(_normalise_file(local_uri(path), f"{target}/{name}.warc.gz", attempt)))

    # One file is one unit of work, so names are dealt by their hash.
    dealt = files.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    dealt.mapInPandas(rewrite, "archive string, records long, bytes long").write.parquet(f"{target}/summary")
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.idx.json").json(target)


def read_member(fs: pyarrow.fs.FileSystem, handle, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    handle.seek(offset)
    inflater = zlib.decompressobj(31)
    record = inflater.decompress(handle.read(length)) + inflater.flush()
    if not inflater.eof or inflater.unused_data:
        raise ValueError("the index names no whole gzip member")
    head, _, block = record.partition(b"\r\n\r\n")
    headers = parse_head(head)
    return headers, block[: int(headers["Content-Length"])]


def _page(value: str | None) -> int | None:
    return int(value.removeprefix("<urn:page:").removesuffix(">")) if value else None


def read_records(index: DataFrame) -> DataFrame:
    """The records behind ``index`` rows; a response's payload is checked against its digest."""

    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for archive, rows in batch.groupby("archive", sort=False):
                fs, path = open_fs(archive)
                with fs.open_input_file(path) as handle:
                    for offset, length in zip(rows["offset"], rows["length"]):
                        headers, block = read_member(fs, handle, int(offset), int(length))
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = None
                        if headers["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {headers.get('WARC-Record-ID')} differs from its digest")
                            payload = payload.decode("utf-8")
                        yield (
                            _page(headers.get("WARC-Record-ID")),
                            headers.get("WARC-Target-URI"),
                            int(headers["X-Payload-Length"]),
                            digest,
                            headers["WARC-Type"],
                            _page(headers.get("WARC-Refers-To")),
                            payload,
                        )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A batch of index rows stands for any number of bytes; of payloads no more than a piece is held.
        for piece in pieces(records(batches), lambda row: 512 + len(row[-1] or "")):
            yield frame(piece, names, ("page_id", "refers_to"))

    return index.mapInPandas(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """Archive ``pages``, normalise the archives and read every record back by offset."""
    spark = pages.sparkSession
    base = local_uri(scratch_path(spark, "warc"))
    write_archives(with_record_types(pages, revisit_from), f"{base}/plain")
    return read_records(normalise(spark, f"{base}/plain", f"{base}/members"))
