"""WARC archives: written with revisits for equal payloads, read sequentially.

Each record is one gzip member. The reader takes a file in small pieces, feeds
them to an incremental zlib stream, starts a new stream where a member ends,
takes each block's length from Content-Length, and checks the SHA-1 of the
payload against the record's digest. A revisit holds no payload: its size is that
of the response which it names, and their digests must agree.

Nulls and odd input: null html is an empty payload, very long ones are written
whole; a null url leaves the target out; a null page_id is written without an id
and read back as null, and never wins; pages that agree in page_id and payload
are all written, the winner's row with the smallest url (none first) as response;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .common import BROADCAST_IDS, arrow_rows, new_dir, written

#: What the reader finds in a file: a revisit's `size` is null, and `refers` is the id of a record.
FOUND = "page_id long, size long, payload_digest string, record_type string, record string, refers string"
PIECE = 1 << 16
#: Names records; any fixed namespace does.
NAMES = uuid.UUID("5f0c1d0e-9a4b-4c57-8a53-6b0b7a3f2f11")


def record_id(name: str) -> str:
    """The same id for the same name."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(record: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record with the payload, or a revisit that names the response's record."""
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    return member(headers, payload)


class DamagedArchive(ValueError):
    """The archive breaks off, a length is wrong or a digest differs."""


def _members(stream) -> Iterator[bytes]:
    """Decompressed pieces; an empty piece after each member."""
    piece, unpacker = stream.read(PIECE), None
    while piece:
        unpacker = unpacker or zlib.decompressobj(31)
        out = unpacker.decompress(piece, PIECE)
        if out:
            yield out
        if unpacker.eof:
            piece, unpacker = unpacker.unused_data or stream.read(PIECE), None
            yield b""
        else:
            piece = unpacker.unconsumed_tail or stream.read(PIECE)
    if unpacker is not None:
        raise DamagedArchive("a gzip member breaks off")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a stream; digests are checked."""
    held = bytearray()
    for piece in _members(stream):
        if piece:
            held += piece
            continue
        end = held.find(b"\r\n\r\n")
        if end < 0 or not held.startswith(b"WARC/"):
            raise DamagedArchive("a member without a record's head")
        lines = held[:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        block = bytes(held[end + 4 : end + 4 + length])
        if len(block) != length or held[end + 4 + length :] != b"\r\n\r\n":
            raise DamagedArchive("a record's length differs from its Content-Length")
        if headers["warc-type"] == "response" and "sha1:" + hashlib.sha1(block).hexdigest() != headers["warc-payload-digest"]:
            raise DamagedArchive("a payload differs from its digest")
        held = bytearray()
        yield headers, block


def resolved(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload (null: a revisit), sha1, sha256, and a revisit's winner.

    Groups are found on rows without payloads, and so are their revisits. What a
    revisit replaces is dropped from the pages by a broadcast of ids and digests
    where their number is checked, else by a join on them, which no group skews.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    keys = written(own.filter(F.octet_length("payload") >= least).select("page_id", "url", "sha1", "sha256"), "warc-keys")
    groups = keys.groupBy("sha256").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 and winner is not null").select("sha256", "winner")
    members = written(keys.join(groups, "sha256"), "warc-groups")
    # A winner's id on several rows: all are dropped, one comes back as response, the others as revisits.
    is_winner = F.col("page_id").eqNullSafe(F.col("winner"))
    urls = written(members.filter(is_winner).groupBy("sha256", "sha1", "winner", "url").agg(F.count("*").alias("n")), "warc-winners")
    twice = urls.groupBy("sha256").agg(F.sum("n").alias("rows"), F.min(F.struct("url")).alias("first")).filter("rows > 1")
    again = urls.join(twice, "sha256").withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("first.url")).cast("int")).filter("n > 0")
    again = again.select(F.col("winner").alias("page_id"), F.explode(F.array_repeat("url", F.col("n").cast("int"))).alias("url"), "sha1", "sha256", "winner")
    lost = members.filter(~is_winner)
    gone = lost.select("page_id", "sha256").unionByName(members.join(twice.select("sha256"), "sha256").filter(is_winner).select("page_id", "sha256")).distinct()
    gone = written(gone.select(F.col("page_id").alias("gone_id"), F.col("sha256").alias("gone_sha256")), "warc-gone")
    few = gone.count() <= BROADCAST_IDS // 8
    kept = own.join(F.broadcast(gone) if few else gone, F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("sha256") == F.col("gone_sha256")), "left_anti")
    one = own.join(twice.select("sha256", "first"), "sha256").join(groups, "sha256").filter(is_winner & F.col("url").eqNullSafe(F.col("first.url")))
    one = one.groupBy("page_id", "url", "sha1", "sha256").agg(F.first("payload").alias("payload"))
    columns = ["page_id", "url", "payload", "sha1", "sha256", "winner"]
    revisits = lost.unionByName(again).withColumn("payload", F.lit(None).cast("binary")).select(columns)
    return kept.select(columns[:-1]).unionByName(one.select(columns[:-1])).withColumn("winner", F.lit(None).cast("long")).unionByName(revisits)


def write_archives(pages: DataFrame, directory: str | None = None, least: int = 1000, date: str | None = None) -> DataFrame:
    """Write a record per page, a file per task; a table of files (uri, rows) of the tasks that succeeded."""
    spark = pages.sparkSession
    directory = directory or new_dir(spark, "warc")
    storage.ensure_dir(directory)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        task, out, stream = TaskContext.get(), None, None
        uri = f"{directory}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        rows = 0
        for batch in batches:
            for page_id, url, payload, sha1, sha256, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = storage.AtomicFile(uri, str(task.taskAttemptId()))
                    stream = out.__enter__()
                    stream.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"info {uri}")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                # A response that revisits may name goes by its page and payload, any other record by its place.
                named = payload is not None and len(payload) >= least and page_id is not None
                record = record_id(f"page {page_id} {sha256}" if named else f"row {uri} {rows}")
                stream.write(page_record(record, date, page_id, url, payload or b"", sha1, record_id(f"page {winner} {sha256}") if payload is None else None))
                rows += 1
        if out is not None:
            out.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "rows": [rows]})

    arrow_rows(spark)
    return written(resolved(pages, least).mapInArrow(write, "uri string, rows long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record of a table of files; each must hold as many as its row says, if it does."""

    def read(batches):
        for uri, written_rows in (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            rows: list[tuple] = []
            n = 0
            with storage.read_stream(uri) as stream:
                for headers, block in records(stream):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    n += 1
                    page_id, response = headers.get("x-page-id"), headers["warc-type"] == "response"
                    rows.append((None if page_id is None else int(page_id), len(block) if response else None, headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], headers["warc-record-id"], headers.get("warc-refers-to")))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
            if written_rows is not None and n != written_rows:
                raise DamagedArchive(f"{uri} has {n} records of {written_rows}")
            if rows:
                yield _batch(rows)

    rows_of = F.col("rows") if "rows" in files.columns else F.lit(None).cast("long")
    found = written(files.select("uri", rows_of.alias("rows")).repartition(max(1, files.count()), "uri").mapInArrow(read, FOUND), "warc-records")
    revisits = found.filter("record_type = 'revisit'").drop("size")
    named = revisits.select(F.col("refers").alias("record")).distinct()
    responses = found.filter("record_type = 'response'").join(named, "record").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"), "size", F.col("payload_digest").alias("digest"))
    lost = F.raise_error(F.lit("a revisit names no response with its digest"))
    size = F.when(F.col("digest").eqNullSafe(F.col("payload_digest")), F.col("size")).otherwise(lost.cast("long"))
    revisits = revisits.join(responses, "refers", "left").select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    own = found.filter("record_type <> 'revisit'").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.string()] * 4]
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
