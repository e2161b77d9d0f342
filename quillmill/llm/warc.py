"""WARC archives with a Zstandard dictionary per file and one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.scale import salted_join
from quillmill.session import materialize, scratch_path

#: Fixed values of the formats: magic numbers of the leading skippable frame that holds the
#: dictionary and of a full Zstandard dictionary; the revisit profile of WARC 1.1.
SKIPPABLE = 0x184D2A5D
DICTIONARY = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "record_id string, file string, start long, length long"
RECORD_SCHEMA = (
    "file string, record_id string, record_type string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def _urn(record_id: str) -> str:
    return f"<urn:quillmill:{record_id}>"


def _clean(value: str) -> str:
    """A header value: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(
    record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str
) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with its head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; a response whose payload is not what its head says is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != length or actual != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    bare = lambda urn: None if urn is None else urn[len("<urn:quillmill:"):-1]
    return {
        "record_id": bare(fields["WARC-Record-ID"]), "record_type": kind,
        "refers_to": bare(fields.get("WARC-Refers-To")),
        "target_uri": fields.get("WARC-Target-URI"), "payload_digest": digest,
        "payload_bytes": length, "payload": payload if kind == "response" else None,
    }


def train_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples; of too few samples, their bytes as raw content."""
    # The trainer wants many samples; a handful of records is offered piece by piece.
    pieces = samples if len(samples) >= 64 else [
        s[i:i + 512] for s in samples for i in range(0, len(s), 512)
    ]
    try:
        return zstandard.train_dictionary(size, pieces, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(
            b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )


def write_warc(
    records: DataFrame,
    path: str,
    dict_bytes: int = 64 << 10,
    sample_bytes: int = 4 << 20,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``records`` (record_id, uri, payload, refers_to) as ``.warc.zst`` files.

    Every task writes one archive: it holds back its first ``sample_bytes`` of records,
    trains the dictionary of the archive on them, writes it in a leading skippable frame,
    and then compresses record by record, so a task never holds more than the
    sample and a batch. ``refers_to`` makes a row a revisit. NULL and empty payloads are
    empty, a NULL uri leaves out its header. Rows are archived as they come, repeated ones
    too; an empty partition writes no file.

    Returns the written index (record_id, file, start, length). A file gets a new
    name in every attempt, and the index holds the attempts that Spark committed, so a
    retried task leaves an orphan but never a doubled or half-written archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        name = f"{uuid.uuid4().hex}.warc.zst"
        out = compressor = None
        at, held, waiting, index = 0, 0, [], []

        def begin() -> None:
            nonlocal out, compressor, at
            made = train_dictionary([r for _, r in waiting], dict_bytes)
            content = made.as_bytes()
            compressor = zstandard.ZstdCompressor(level=level, dict_data=made)
            fs.create_dir(folder, recursive=True)
            out = fs.open_output_stream(f"{folder}/{name}")
            frame = struct.pack("<II", SKIPPABLE, len(content)) + content
            out.write(frame)
            at = len(frame)
            for key, record in waiting:
                put(key, record)
            waiting.clear()

        def put(key: str, record: bytes) -> None:
            nonlocal at
            frame = compressor.compress(record)
            out.write(frame)
            index.append((key, at, len(frame)))
            at += len(frame)

        def flushed() -> pa.RecordBatch:
            keys, starts, lengths = ([*x] for x in zip(*index))
            index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([f"{path}/{name}"] * len(keys), pa.string()),
                 pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                names=["record_id", "file", "start", "length"],
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "uri", "payload", "refers_to")]
            for i in range(batch.num_rows):
                key, uri, payload, refers_to = (c[i].as_py() for c in columns)
                key = "null" if key is None else key
                record = record_bytes(key, uri, payload or b"", refers_to, date)
                if out is not None:
                    put(key, record)
                    continue
                waiting.append((key, record))
                held += len(record)
                if held >= sample_bytes:
                    begin()
            if index:
                yield flushed()
        if waiting:
            begin()
        if out is not None:
            out.close()
        if index:
            yield flushed()

    rows = records.select(
        F.col("record_id").cast("string").alias("record_id"),
        F.col("uri").cast("string").alias("uri"),
        F.col("payload").cast("binary").alias("payload"),
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    return materialize(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def _frames(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    content = stream.read(size)
    full = size >= 4 and struct.unpack("<I", content[:4])[0] == DICTIONARY
    kind = zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    rest = b""
    while True:
        piece = rest or stream.read(1 << 16)
        if not piece:
            return
        one, parts = made.decompressobj(), []
        while not one.eof:
            if not piece:
                raise ValueError("archive ends inside a record")
            parts.append(one.decompress(piece))
            piece = b"" if one.eof else stream.read(1 << 16)
        rest = one.unused_data
        yield b"".join(parts)


def read_warc(spark: SparkSession, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read all records of the archives that an index names, one task per archive.

    Dictionaries and records come from the archives alone; the index only says which files
    were committed. Payloads of responses are checked against their digests. A revisit has
    no payload of its own (NULL), its ``payload_bytes`` is that of the record it refers to.
    """
    files = index.select("file").distinct()
    count = files.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload"
                 else pa.string() for n in names]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names
            )

        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, inside = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_stream(inside) as stream:
                    for data in _frames(stream):
                        row = parse_record(data) | {"file": file}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held >= 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.repartition(max(1, count)).mapInArrow(read, RECORD_SCHEMA)


def with_revisits(records: DataFrame, min_payload: int = 0) -> DataFrame:
    """Add ``refers_to`` to ``records`` (record_id, uri, payload).

    Of records with equal payloads of at least ``min_payload`` bytes, that of the smallest
    record_id is the response and the others refer to it; rows that repeat its id with the
    same payload are responses too. A NULL record_id never refers to another record, and
    nothing refers to it. A NULL payload is empty.

    Only (record_id, digest) is shuffled to find the first records, with minima made before
    the shuffle and a payload shared by many rows spread over salts; payloads are moved
    at most once, by record_id.
    """
    data = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    rows = records.select("record_id", "uri", data.alias("payload"), F.sha1(data).alias("digest"))
    ids = materialize(
        rows.where(F.octet_length("payload") >= min_payload)
        .where(F.col("record_id").isNotNull()).select("record_id", "digest"),
        "warc-digests",
    )
    first = (
        ids.groupBy("digest").agg(F.min("record_id").alias("refers_to"),
                                  F.max("record_id").alias("last"))
        .where("refers_to < last").drop("last")
    )
    revisits = (
        salted_join(ids, first, ["digest"], ["record_id"])
        .where("record_id > refers_to").distinct()
    )
    return rows.join(materialize(revisits, "warc-revisits"), ["record_id", "digest"], "left").select(
        "record_id", "uri", "payload", "refers_to"
    )


def archive_path(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")


def archive_and_read(records: DataFrame, path: str, min_payload: int = 0) -> DataFrame:
    """Write ``records`` (record_id, uri, payload) with revisits and read the archives back."""
    spark = records.sparkSession
    rows = with_revisits(records, min_payload)
    return read_warc(spark, write_warc(rows, path), with_payload=False)
