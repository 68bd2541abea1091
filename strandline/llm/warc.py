"""WARC archives: a monolithic writer, the normaliser, and an index reader.

1. ``write_monolithic``: every task writes its pages as response records into
   archives that are each one single gzip stream, rolled over at a fixed size.
2. ``normalise``: each archive is inflated once from end to end; every record is
   rewritten as its own gzip member, and a sidecar index gets its place.  Which
   records become revisits is decided before, over all archives, from the digests
   that the first pass reports: small rows only, the payloads don't move.
3. ``read_archives``: the sidecar index of each archive is the list of work;
   members are read from its offsets alone and their payload digests taken again.

Records are WARC/1.1.  A record's id is a tag URI of the raw archive, the place in
it and the page id, so it is unique also where page ids repeat.

Files go to the shared folder through ``pyarrow.fs``.  A file's name is unique
to the attempt that wrote it, and only the rows of the attempt that succeeded
name it, so a lost executor or a speculative copy leaves at most a stray file.

Defined cases: null html is an empty payload; a null id is written as an empty
id header and read back as null, and is the response only where its group has no
other id; rows that repeat id and html are one response and revisits to it;
a null url is written as an empty target, line ends in a url, which no URL has,
as %0D and %0A; an empty table gives no archives;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_width
from strandline.scratch import drop, materialise, new_path

ROLL_BYTES, ROLL_RECORDS = 24_000_000, 20_000
_LEVEL = 4


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record_id(archive: str, ordinal: int, page_id) -> str:
    return f"<tag:strandline,2024:{archive.removesuffix('.warc.gz')}/{ordinal}/{'' if page_id is None else page_id}>"


def record(kind: str, ident: str, date: str, url: str, payload: bytes, full_digest: str, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record.  A revisit carries no payload, but its digest."""
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{full_digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(head["Content-Length"])
    return head, bytes(data[stop + 4 : stop + 4 + size]), stop + 8 + size


def page_of(ident: str) -> int | None:
    inner = ident.removesuffix(">").rsplit("/", 1)[1]
    return int(inner) if inner else None


def write_monolithic(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, roll_records: int = ROLL_RECORDS) -> DataFrame:
    """Write page_id, url, html as single-stream archives; returns archive, ordinal, page_id, payload_bytes, payload_digest."""
    names = ["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"]
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _open(folder)
        system.create_dir(where, recursive=True)
        out, rows, path, size, deflate = None, [], "", 0, None

        def close():
            nonlocal out, rows
            out.write(deflate.flush())
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array(c) if c[0] is not None or any(x is not None for x in c) else pa.array(c, pa.int64()) for c in map(list, zip(*rows, strict=True))], names)
            out, rows = None, []
            return done.cast(pa.schema([("archive", pa.string()), ("ordinal", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

        for batch in batches:
            for page, url, html in zip(batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
                if out is None:
                    path, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out, deflate = system.open_output_stream(f"{where}/{path}", compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                payload = (html.as_py() or "").encode()
                sha = digest(payload)
                data = record("response", record_id(path, len(rows), page.as_py()), date, url.as_py() or "", payload, sha)
                out.write(deflate.compress(data))
                rows.append((path, len(rows), page.as_py(), len(payload), sha))
                size += len(data)
                if size >= roll_bytes or len(rows) >= roll_records:
                    yield close()
        if out is not None:
            yield close()

    known = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return known.mapInArrow(run, "archive string, ordinal int, page_id long, payload_bytes long, payload_digest string")


def decide(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with record_type and refers_to: of equal payloads of at least ``least_bytes``, the smallest id is the response.

    Rows that repeat the smallest id are told apart by archive and ordinal.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "ordinal"))
    key = ["payload_digest", "payload_bytes"]
    groups = records.groupBy(*key).agg(first.alias("r")).select(*key, F.col("r.page_id").alias("to"), F.col("r.archive").alias("in"), F.col("r.ordinal").alias("at"))
    own = (F.col("payload_bytes") < least_bytes) | ((F.col("archive") == F.col("in")) & (F.col("ordinal") == F.col("at")))
    return records.join(groups, key).select(*records.columns, F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("to")).alias("refers_to"), F.when(~own, F.col("in")).alias("refers_archive"), F.when(~own, F.col("at")).alias("refers_ordinal"))


def normalise(decided: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with one member per record and a sidecar index.

    Returns archive, records of every file written.  ``decided`` has one row per
    record; an archive has a bounded number of them.
    """
    width = shuffle_width(decided.sparkSession)
    work = decided.repartition(width, "archive").groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("ordinal", "record_type", "refers_to", "refers_archive", "refers_ordinal", "payload_bytes"))).alias("records"))
    names = ["archive", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, here), (_, there) = _open(source), _open(target)
        system.create_dir(there, recursive=True)
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records"), strict=True):
                name = f"{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with system.open_output_stream(f"{there}/{name}", compression=None) as out:
                    for head, payload, what in zip(*_stream(system, f"{here}/{archive}"), records.as_py(), strict=True):
                        again, ident = what["record_type"] == "revisit", head["WARC-Record-ID"]
                        first = record_id(what["refers_archive"], what["refers_ordinal"], what["refers_to"]) if again else None
                        data = record(what["record_type"], ident, head["WARC-Date"], head["WARC-Target-URI"], b"" if again else payload, head["WARC-Payload-Digest"].removeprefix("sha1:"), first)
                        member = _member(data)
                        out.write(member)
                        rows.append({"offset": offset, "length": len(member), "page_id": page_of(ident), "payload_bytes": what["payload_bytes"]})
                        offset += len(member)
                with system.open_output_stream(f"{there}/{name}.index.jsonl", compression=None) as side:
                    side.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], names)

    return work.mapInArrow(run, "archive string, records long")


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _stream(system: fs.FileSystem, path: str) -> tuple[Iterator[dict], Iterator[bytes]]:
    """Headers and payloads of a whole-file gzip stream, inflated once, a block at a time."""
    from itertools import tee

    def records():
        inflate, data, at = zlib.decompressobj(31), bytearray(), 0
        with system.open_input_stream(path, compression=None) as f:
            while block := f.read(1 << 20):
                data += inflate.decompress(block)  # a record over many blocks grows in place
                while (got := _whole(data, at)) is not None:
                    head, payload, at = got
                    yield head, payload
                del data[:at]
                at = 0
        data += inflate.flush()
        while at < len(data):
            head, payload, at = parse(data, at)
            yield head, payload

    one, two = tee(records())
    return (head for head, _ in one), (payload for _, payload in two)


def _whole(data: bytearray, at: int):
    """The record at ``at`` if all of it is there."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    size = data.rfind(b"Content-Length: ", at, stop)
    end = stop + 8 + int(data[size + 16 : stop])
    return parse(data, at) if end <= len(data) else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every member that the sidecar indexes of these archives name.

    A response's length and digest are taken from its payload and must equal those
    of the index and of its header; a revisit has its length in the index and its
    digest in the header.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _open(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{where}/{archive}.index.jsonl", compression=None) as side:
                    index = [json.loads(line) for line in side.read().splitlines()]
                rows = []
                with system.open_input_file(f"{where}/{archive}") as f:
                    for item in index:
                        head, payload, _ = parse(zlib.decompress(f.read_at(item["length"], item["offset"]), 31))
                        kind, sha = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if page_of(head["WARC-Record-ID"]) != item["page_id"] or (kind == "response" and (item["payload_bytes"], sha) != (len(payload), digest(payload))):
                            raise ValueError(f"damaged record in {archive} at {item['offset']}")
                        rows.append((item["page_id"], item["payload_bytes"], sha, kind, page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    work = manifest.select("archive").repartition(shuffle_width(manifest.sparkSession), "archive")
    return work.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder: archive, offset, length, page_id, payload_bytes."""
    rows = spark.read.schema("offset long, length long, page_id long, payload_bytes long").json(f"{folder}/*.index.jsonl")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.index\.jsonl$", 1)
    return rows.select(name.alias("archive"), "offset", "length", "page_id", "payload_bytes")


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write, normalise; returns (archive, records of the normalised archives; their folder)."""
    spark = pages.sparkSession
    raw, folder = new_path(spark, "raw-archives"), folder or new_path(spark, "archives")
    records = materialise(write_monolithic(pages, raw), "records")
    manifest = materialise(normalise(decide(records, least_bytes), raw, folder), "manifest")
    drop(records, raw)
    return manifest, folder


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    manifest, folder = archive_pages(pages, None, least_bytes)
    return read_archives(manifest, folder)
