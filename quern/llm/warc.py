"""WARC archives compressed by Zstandard with a dictionary in the file.

Each archive starts with a skippable frame that holds a dictionary, built from
the archive's own first records; every record then is a frame of its own, so
that any can be read by its offset and the dictionary alone. A payload that an
earlier record holds is written as a revisit record without it.

Tasks write under a name of their own attempt and rename when the archive is
whole, so a task that is run again leaves one archive. Paths go through
pyarrow's file systems: shared mounts and object stores alike.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import new_path, staged

#: Magic number of the skippable frame that carries a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 2 << 20, 2000, 64 << 10
ARCHIVE_BYTES = 64 << 20
REVISIT_FROM = 100
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A WARC record. Its block holds the HTTP headers, whose Content-Length is the full payload's, and for a response the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """The fields of a record. A response whose payload has not the digest or the length that its headers say is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was archived")
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the records are too few or too much alike to train on, their own beginning."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive_of(records: Iterator[bytes], out, level: int = 3) -> int:
    """Writes records to a file, the first ones sampled for the dictionary; returns how many."""
    samples, size = [], 0
    for r in records:
        samples.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES or len(samples) >= SAMPLE_RECORDS:
            break
    words = dictionary(samples)
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
    n = 0
    for part in (samples, records):
        for r in part:
            out.write(packer.compress(r))
            n += 1
    return n


def records_of(source) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't start with a dictionary")
    words = source.read(n)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    data = source.read(1 << 16)
    while data:
        frame, parts = opener.decompressobj(), []
        while data:
            parts.append(frame.decompress(data))
            data = frame.unused_data
            if frame.eof:
                break
            data = source.read(1 << 16)
        if not frame.eof:
            raise ValueError("the archive ends within a record")
        yield b"".join(parts)
        data = data or source.read(1 << 16)


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload and refers_to (null: the record is a response).

    Of records with equal payloads of 100 bytes or more those with the least
    page_id are responses; null ids refer to it like others, and are responses
    where a payload has no other.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("*", F.when(F.octet_length("payload") >= REVISIT_FROM, F.unhex(F.sha2("payload", 256))).alias("digest"))
    first = keyed.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = staged(first.select(F.col("digest").alias("k"), "first"), "first")
    met = keyed.join(first, F.col("digest") == F.col("k"), "left")
    return met.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def archived(typed: DataFrame, path: str) -> DataFrame:
    """Writes rows of ``with_types`` as archives ``*.warc.zst`` under ``path``; the manifest, staged: path, n_records, n_bytes.

    An archive is closed at 64 MB of records. An empty table makes no archive.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()

        def rows():
            for batch in batches:
                for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    yield record_bytes(page, url, payload, "response" if refers is None else "revisit", refers)

        source, part, pending = rows(), 0, []

        def until_full():
            size = 0
            while pending:
                yield pending.pop()
            for r in source:
                size += len(r)
                yield r
                if size >= ARCHIVE_BYTES:
                    return

        while True:
            if not pending and (r := next(source, None)) is not None:
                pending.append(r)
            if not pending:
                break
            name = f"{root}/part-{task.partitionId():06d}-{part:04d}.warc.zst"
            own = f"{name}.{task.taskAttemptId()}.tmp"
            with fs.open_output_stream(own, compression=None) as out:
                n = archive_of(until_full(), out)
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([fs.get_file_info(name).size], pa.int64())], ["path", "n_records", "n_bytes"])
            part += 1

    return staged(typed.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def read_back(manifest: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for (null for revisits)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(name, compression=None) as source:
                    for record in records_of(source):
                        row = parsed(record)
                        if row["record_type"] == "revisit":
                            row["payload"] = None
                        rows.append(row)
                        size += len(record) if with_payload else 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # An archive is a task's least work. The manifest's rows are small and would be merged into one task.
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def op8_warc_archive(spark, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that were written of all pages."""
    path = new_path(spark, "warc")
    manifest = archived(with_types(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return read_back(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
