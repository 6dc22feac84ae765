"""WARC archives through a chunked record table.

A record travels as rows (record, chunk number, bytes), so neither the writer nor the reader holds more than one
chunk of it; both carry the payload's SHA-1 forward from chunk to chunk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from petrichor.llm.common import shared_folder, written
from petrichor.llm.files import make_folder, open_at

CHUNK_BYTES = 64 * 1024
FILE_BYTES = 1 << 30
CHUNK_SCHEMA = (
    "file string, record_no bigint, record_id bigint, url string, record_type string, refers_to bigint, full_bytes bigint, full_digest string, "
    "chunk_no bigint, chunk binary, digest string"
)


def record_table(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, n_bytes, sha1, record_type, refers_to) per row.

    Of equal payloads of at least ``min_bytes`` bytes the largest id is the response and the others revisit it;
    smaller payloads are responses. A NULL payload is empty, a NULL id revisits unless all ids are NULL. Equality
    is that of SHA-1 and length; the table of repeated payloads is made from counts, and a payload that fills a
    third of the rows is split by the engine's skew join.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    groups = rows.groupBy("sha1", "n_bytes").agg(F.max("id").alias("first_id"))
    rows = rows.join(groups, ["sha1", "n_bytes"])
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "id", "url", "payload", "n_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def chunked(records: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, the chunks of a record in a row; a revisit has no payload and one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length(stored) / chunk_bytes), F.lit(1)) - 1
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), last.cast("long")),
        lambda k: F.struct(k.alias("chunk_no"), F.substr(stored, (k * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("chunk"), (k == last).alias("is_last")),
    )
    return records.select("id", "url", "n_bytes", "sha1", "record_type", "refers_to", F.inline(pieces))


def _urn(value: int | None) -> str:
    return f"<urn:page:{'null' if value is None else value}>"


def _from_urn(text: str | None) -> int | None:
    inner = (text or "")[len("<urn:page:") : -1]
    return int(inner) if re.fullmatch(r"-?\d+", inner) else None


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _header(row: dict, date: str) -> bytes:
    digest = _base32(row["sha1"])
    response = row["record_type"] == "response"
    length = f"Content-Length: {row['n_bytes']}\r\n" if response else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{length}\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    # the last field is an extension: a revisit record doesn't hold the payload whose length it tells
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (row['n_bytes'] if response else 0)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['n_bytes']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the chunk rows as .warc.gz files, one gzip member per record; returns (file, records) as written.

    A task writes its partition's records one after the other and starts a new file beyond ``file_bytes``. Files
    carry the task attempt in their name, and only those of attempts that ended well are in the returned table,
    so a lost executor leaves at worst an unlisted file.
    """
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, inner = open_at(folder)
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        done, out, name, count, member, sha = [], None, "", 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and out.tell() > file_bytes:
                        out.close()
                        done.append((name, count))
                        out = None
                    if out is None:
                        name, count = f"{stem}-{len(done)}.warc.gz", 0
                        out = system.open_output_stream(f"{inner}/{name}", compression=None)
                    member, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(member.compress(_header(row, date)))
                sha.update(row["chunk"])
                out.write(member.compress(row["chunk"]))
                if row["is_last"]:
                    if row["record_type"] == "response" and sha.hexdigest() != row["sha1"]:
                        raise ValueError(f"record {row['id']}: chunks and payload differ")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    count += 1
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_pydict({"file": pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), "records": pa.array([c for _, c in done], pa.int64())})

    return written(chunks.mapInArrow(write, "file string, records bigint"), "warc-files")


def _records(stream, chunk_bytes: int) -> Iterator[tuple[dict, int, bytes, str]]:
    """(fields, chunk number, chunk, SHA-1 of the payload up to here) of one archive, read forward only."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        while left and (line := stream.readline()):  # the HTTP header
            left -= len(line)
            if not line.strip():
                break
        sha, number = hashlib.sha1(), 0
        while number == 0 or left:
            chunk = stream.read(min(left, chunk_bytes))
            if len(chunk) < min(left, chunk_bytes):
                raise ValueError("the archive ends inside a record")
            left -= len(chunk)
            sha.update(chunk)
            yield fields, number, chunk, sha.copy().hexdigest()
            number += 1
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


def read_chunks(files: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = 8 << 20) -> DataFrame:
    """The chunked record table of the archives: a row per record and chunk, with the digest up to that chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in CHUNK_SCHEMA.split(", ")])
        rows, held = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, inner = open_at(file)
                with system.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    number = -1
                    for fields, k, chunk, digest in _records(stream, chunk_bytes):
                        number += k == 0
                        full = fields["warc-payload-digest"].removeprefix("sha1:")
                        rows.append(
                            (file, number, _from_urn(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _from_urn(fields.get("warc-refers-to")),
                             int(fields["x-payload-length"]), full, k, chunk, _base32(digest))
                        )
                        held += len(chunk) + 300
                        if held > batch_bytes:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    spread = files.repartition(max(1, files.count()), "file")
    return spread.select("file").mapInArrow(read, CHUNK_SCHEMA)


def records_of(chunks: DataFrame) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_bytes, payload_digest) per record of the chunk table.

    A response's length and digest come from its chunks and must agree with its header; a revisit has those of
    the payload it refers to in its header.
    """
    got = chunks.groupBy("file", "record_no").agg(
        *[F.first(c).alias(c) for c in ("record_id", "url", "record_type", "refers_to", "full_bytes", "full_digest")],
        F.sum(F.octet_length("chunk")).alias("got_bytes"), F.max_by("digest", "chunk_no").alias("got_digest"),
    )
    ok = (F.col("record_type") != "response") | ((F.col("got_bytes") == F.col("full_bytes")) & (F.col("got_digest") == F.col("full_digest")))
    checked = F.when(ok, F.col("full_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), F.col("file"))))
    return got.select("record_id", "url", "record_type", "refers_to", F.col("full_bytes").alias("payload_bytes"), checked.alias("payload_digest"))


def archive(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write one record per row and return the table of archives (file, records).

    NULL payloads are empty, other columns are ignored, an empty table gives no file. Repeated rows give one
    record each: those whose id is the largest of their payload are all responses.
    """
    records = record_table(df, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    return write_archives(chunked(records, chunk_bytes=chunk_bytes), shared_folder(df.sparkSession, "warc"))
