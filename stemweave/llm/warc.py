"""WARC archives in Zstandard: one frame per record behind a dictionary in a leading skippable frame.

Pages become records (payloads that were met before become revisits), records are packed into
archives inside the tasks, the archives are stored as a table of binary rows, and the reader takes
archives from any such table, among them ``spark.read.format("binaryFile")``.  The reader finds each
frame from the format's own headers, loads the dictionary, decodes one frame at a time, and checks the
record's version, fields, lengths, trailer and digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small, spread_join, table

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string"


# ------------------------------------------------------------------------------- one archive


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def write_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of one record; ``refers_to`` is the page whose payload it repeats, or None."""
    block = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", page_id),
        ("WARC-Payload-Length", len(payload)), ("Content-Type", "text/html"), ("Content-Length", len(block)),
    ]
    if refers_to is not None:
        fields[3:3] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("WARC-Refers-To-Page-ID", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields and payload of a record; raises ValueError where a header, length, trailer or digest is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        fields[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"missing {need}")
    if not fields["content-length"].isdigit():
        raise ValueError("malformed content-length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, header says {n}")
    block, kind = rest[:n], fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        real = hashlib.sha256(block).hexdigest()
        if digest and real != digest:
            raise ValueError("payload digest differs")
        if int(fields.get("warc-payload-length", n)) != n:
            raise ValueError("payload length differs")
        digest = real
    elif kind == "revisit" and ("warc-refers-to" not in fields or not digest):
        raise ValueError("a revisit without its response")
    number = lambda k: int(fields[k]) if k in fields and fields[k] != "None" else None
    return {"page_id": number("warc-page-id"), "payload_bytes": number("warc-payload-length") if kind == "revisit" else n, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "url": fields.get("warc-target-uri"), "payload": block if kind == "response" else None, "error": None}


def archive_head(dictionary: bytes) -> bytes:
    """The leading skippable frame; nothing for an empty dictionary."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def _frame_end(buf: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its block headers."""
    (magic,) = struct.unpack_from("<I", buf, at)
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = buf[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(buf[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if at > len(buf):
            raise ValueError("truncated frame")
        if block & 1:
            return at + 4 * (flags >> 2 & 1)


def read_archive(content: bytes):
    """The raw records of an archive, one frame at a time; ValueError where its frames are broken."""
    buf, at, dictionary = memoryview(content), 0, None
    if len(buf) >= 8 and struct.unpack_from("<I", buf, 0)[0] == DICTIONARY_MAGIC:
        (n,) = struct.unpack_from("<I", buf, 4)
        if 8 + n > len(buf):
            raise ValueError("truncated dictionary")
        raw = bytes(buf[8 : 8 + n])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # it may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(buf):
        (magic,) = struct.unpack_from("<I", buf, at) if at + 4 <= len(buf) else (0,)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # further skippable frames are passed over
            at += 8 + struct.unpack_from("<I", buf, at + 4)[0]
            continue
        end = _frame_end(buf, at)
        try:
            yield reader.decompress(buf[at:end], max_output_size=1 << 31)
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at byte {at}: {e}") from e
        at = end


# ------------------------------------------------------------------------------- DataFrames


def train_dictionary(pages: DataFrame, sample_rows: int = 256, sample_bytes: int = 16_384, size: int = 32_768, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """A dictionary from at most ``sample_rows`` payload heads, chosen by the hash of their ids; empty where there is too little
    to learn from.  The ids are chosen first, so that only the chosen heads travel."""
    rows = pages.where(F.length(payload_col) >= 64)
    ids = rows.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)  # the bound of the broadcast
    heads = rows.join(F.broadcast(ids), id_col, "left_semi").select(F.substring(payload_col, 1, sample_bytes).alias("p"))
    got = sorted(r.p.encode() for r in heads.limit(sample_rows).collect())
    try:
        return zstandard.train_dictionary(size, got).as_bytes() if len(got) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, dictionary: bytes = b"", date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """``(archive, content)``: every row of ``pages`` as a record in exactly one archive of about ``ARCHIVE_BYTES``.

    Of rows with equal payloads of ``LEAST_REVISIT`` bytes or more, the one with the smallest id is the
    response and the others revisit it; a null payload is empty; rows that repeat that smallest id are
    responses too, and rows without an id revisit but are never revisited.  ``date_col`` is a timestamp (taken as UTC in a session
    of that zone) for the records' WARC-Date; where it is null or not given the date is ``date``.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), (F.coalesce(F.date_format(date_col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date)) if date_col else F.lit(date)).alias("date"))
    hashed = materialize(rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest")), "digests")
    first = materialize(hashed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 and refers_to is not null"), "first")
    # a payload that very many pages have does not bring them all to one task
    refs = spread_join(hashed, first, "digest", "c", hashed.count()).where("refers_to is not null").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    refs = materialize(refs.withColumnsRenamed({"page_id": "_page", "digest": "_digest"}), "refs")
    # ids tell payloads apart where they are unique; the digest settles rows that repeat an id
    joined = rows.withColumn("digest", F.sha2("payload", 256)).join(small(refs), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "digest", "refers_to", "date", "payload")

    def run(batches):
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        parts, names, raw = [archive_head(dictionary)], hashlib.sha256(), 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([names.hexdigest()[:32]]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for part in slices(batch, 5):
                for page, url, digest, refers, at, text in zip(*(c.to_pylist() for c in part.columns)):
                    record = write_record(page, url, text.encode(), digest, refers, at)
                    parts.append(writer.compress(record))
                    names.update(record[:400])
                    raw += len(record)
                    if raw >= ARCHIVE_BYTES:
                        yield flush()
                        parts, names, raw = [archive_head(dictionary)], hashlib.sha256(), 0
        if raw:
            yield flush()

    return joined.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, content_col: str = "content", strict: bool = True) -> DataFrame:
    """The records of every archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, error.

    A broken record or frame fails the read; with ``strict=False`` it becomes a row that has only ``error``, and
    reading goes on behind a broken record (but not behind a broken frame).  A null or empty archive has no records.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]

    def rows_of(content):
        frames = read_archive(content)
        while True:
            try:
                raw = next(frames)
            except StopIteration:
                return
            except ValueError as e:
                if strict:
                    raise
                yield dict.fromkeys(names) | {"error": str(e)}
                return
            try:
                yield parse_record(raw)
            except ValueError as e:
                if strict:
                    raise
                yield dict.fromkeys(names) | {"error": str(e)}

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows_of(content.as_py() or b""):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size >= 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return archives.select(F.col(content_col).alias("content")).mapInArrow(run, RECORD)


def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    archives = materialize(write_archives(pages, train_dictionary(pages)), "archives")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND m < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND m < page_id THEN m END AS refers_to FROM f"""
}
