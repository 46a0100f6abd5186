"""WARC archives with revisit records: write, read back, resolve.

Headers (id, payload digest, length) are shuffled by digest, without their
payloads. The digest group's largest id becomes the response, the others become
revisit records that refer to it. Payloads then travel once, by row key, to meet
that decision. Records are written with fresh headers, a payload only in
responses. Reading inflates archives piece by piece, parses records by their
Content-Length and joins revisit records to the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pozo.llm.frames import join_counted, row_key

# Fixed values of the format
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:page:"
PIECE = 1 << 20

READ_SCHEMA = ("record_type string, page_id string, uri string, payload_bytes bigint, payload_digest string, "
               "digest_ok boolean, refers_to string")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string column: 5 hex digits give 4 letters."""
    hexa = F.sha1(payload.cast("binary"))
    letters = []
    for i in range(8):
        v = F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` to (page_id, payload_digest, payload_bytes, ...).

    Of equal payloads of at least ``min_bytes`` bytes the largest id is the
    response and every other id revisits it. Equal ids tie: rows that carry
    the largest id are all responses. A null id is the smallest; payloads that
    only null ids carry are responses.

    The largest id per digest is a partial aggregate; the headers then join it
    by digest, without one task for a frequent payload.
    """
    first = headers.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    # Digests seen once have nothing to join.
    joined = join_counted(headers, first.where("_n > 1"), ["payload_digest"], "left", "_n").drop("_n")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (joined.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first"))


def _clean(c: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(c, "[\\r\\n]+", " ")


def records(pages: DataFrame, date: str, min_bytes: int = 0, id_col: str = "page_id",
            url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One string column ``value``: a WARC record per row, without its final two line ends."""
    base = pages.select(F.col(id_col).alias("page_id"),
                        (F.col(url_col) if url_col in pages.columns else F.lit(None)).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.select("*", base32_sha1(F.col("payload")).alias("payload_digest"),
                       F.octet_length("payload").cast("long").alias("payload_bytes"))
    # Rows may share an id: the key of the whole row finds a header's payload again.
    keyed = base.select("*", *row_key("page_id", "url", "payload"))
    heads = resolve(keyed.select("page_id", "payload_digest", "payload_bytes", "_k1", "_k2"), min_bytes)
    again = (heads.where("record_type = 'revisit'").select("_k1", "_k2", "refers_to").distinct())
    full = keyed.join(again, ["_k1", "_k2"], "left")
    name = lambda c: F.concat(F.lit("<" + ID), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")),
                                 F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return full.select(F.concat(head, F.octet_length(body).cast("string"), F.lit(END), body).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", min_bytes: int = 0,
                   compression: str = "gzip", **columns: str) -> str:
    """Write ``pages`` as WARC files below ``path``, from the executors.

    The text writer ends every record with the two line ends the format asks
    for. With ``gzip`` each file is one gzip member. Every input partition
    writes its own files of at most 20,000 records.
    """
    out = records(pages, date, min_bytes, **columns)
    (out.write.option("lineSep", END).option("compression", compression)
     .option("maxRecordsPerFile", 20_000).mode("errorifexists").text(path))
    return path


def _inflated(data: pa.Buffer, gz: bool) -> Iterator[bytes]:
    """The archive's bytes in pieces of at most ``PIECE``; any number of gzip members."""
    stored = (data[at:at + PIECE].to_pybytes() for at in range(0, data.size, PIECE))
    if not gz:
        yield from stored
        return
    member, out = None, b""
    while True:
        if member is None or member.eof:
            fed = (member.unused_data if member else b"") or next(stored, b"")
            if not fed:
                return
            member = zlib.decompressobj(31)
        elif member.unconsumed_tail or len(out) == PIECE:
            fed = member.unconsumed_tail       # what it was given already, or still holds inside
        else:
            fed = next(stored, b"")
            if not fed:
                raise ValueError("an archive ends within a gzip member")
        out = member.decompress(fed, PIECE)
        yield out


def _split(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; holds one record and one piece at a time."""
    held = bytearray()
    head, ends = None, 0
    for piece in pieces:
        held += piece
        done = 0
        while True:
            if head is None:
                cut = held.find(END.encode(), done)
                if cut < 0:
                    break
                if not held.startswith(VERSION.encode(), done):
                    raise ValueError("no record where one should begin")
                head = dict(line.split(": ", 1) for line in held[done:cut].decode().split("\r\n")[1:])
                done, ends = cut + 4, int(head["Content-Length"])
            if len(held) < done + ends + 4:
                break
            yield head, bytes(held[done:done + ends])
            head, done = None, done + ends + 4
        del held[:done]
    if head is not None or held:
        raise ValueError("an archive ends within a record")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bare = lambda v: None if v is None else v[1 + len(ID):-1] or None
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    names = ["record_type", "page_id", "uri", "payload_bytes", "payload_digest", "digest_ok", "refers_to"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for head, block in _split(_inflated(cell.as_buffer(), path.endswith(".gz"))):
                payload = block[block.index(b"\r\n\r\n") + 4:]
                response = head["WARC-Type"] == "response"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else digest
                rows.append((head["WARC-Type"], bare(head["WARC-Record-ID"]), head.get("WARC-Target-URI"),
                             len(payload) if response else None, own, own == digest, bare(head.get("WARC-Refers-To"))))
                if len(rows) == 4096:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Records below ``path``: (page_id, uri, payload_bytes, payload_digest, record_type,
    refers_to, digest_ok); a revisit has its response's length and digest.

    A task holds one archive file, as stored, and one inflated record at a time;
    gzip files may have one member or one per record. Digests of responses are computed
    anew from the payloads read. Revisits join the responses by record id and
    digest on headers alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = files.select("path", "content").mapInArrow(_parse, READ_SCHEMA)
    raw = raw.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
    got = raw.where("record_type = 'response'")
    # Only ids that something refers to; equal ids with equal payloads are one.
    named = got.select(F.col("page_id").alias("refers_to"), "payload_digest",
                       F.col("payload_bytes").alias("_bytes")).distinct()
    again = raw.where("record_type = 'revisit'").join(named, ["refers_to", "payload_digest"], "left")
    cols = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"]
    return got.select(cols).unionByName(
        again.withColumn("payload_bytes", F.col("_bytes")).withColumn("digest_ok", F.col("_bytes").isNotNull()).select(cols))
