"""WARC archives: a writer with payload de-duplication and a salvage reader.

``write_archives`` turns pages into WARC/1.1 records. Of records with the same payload
one is a ``response`` and the others are ``revisit`` records that refer to it.
``read_archives`` reads archives back. When a record fails its checks, the reader
searches for the next version line (or gzip member) that starts a valid record, goes
on from there, and reports the bytes it skipped as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col

END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("kind string, file string, offset long, length long, reason string, record_type string, record_id string, "
                 "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
MAGIC, BLANK = re.compile(re.escape(MEMBER)), re.compile(re.escape(END))
# Compressed bytes read at a time, and the largest content of a member.
STEP = 1 << 16
MEMBER_BYTES = 256 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits are four base-32 digits."""
    hexed = F.sha1(data)
    part = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, compress: bool = False,
                   file_bytes: int = 32 << 20) -> None:
    """Write one record per row of ``pages`` to WARC files under ``path``.

    Of the rows with one payload of at least ``min_bytes`` bytes, the one with the
    largest id is the response, the others are revisits; smaller payloads are all
    responses. Files hold about ``file_bytes`` bytes. With ``compress``, each record is
    a gzip member, and its closing blank lines are a member of their own.

    Defined cases: a null payload is empty; a null url is the empty string; a null id
    is a revisit unless all rows of its payload have null ids; rows that repeat id and
    payload of a response are responses too; an empty table writes no record.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    text = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).alias("id"), F.coalesce(col(url_col).cast("string"), F.lit("")).alias("url"),
                        text.alias("payload"), F.octet_length(text).cast("long").alias("n"), base32_sha1(text).alias("digest"))
    # Only payloads that occur twice or more need a decision; the table of those is
    # small or large as the data have it, and Spark joins it accordingly.
    twice = scratch.keep(
        rows.where(F.col("n") >= min_bytes).groupBy("digest", "n")
        .agg(F.max("id").alias("first"), F.max(F.struct("id", "url")).alias("last"), F.count("*").alias("copies"),
             F.sum("n").alias("bytes"))
        .where("copies > 1").select("digest", "n", "first", F.col("last.url").alias("first_url")), "twice")
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.col("n") + 600).alias("bytes")).first()
    per_file = max(1, int((size["rows"] or 1) * file_bytes / max(size["bytes"] or 1, 1)))
    chosen = rows.join(twice, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    clean = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"),
                    F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        clean(F.col("url")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")),
                                 F.lit("\r\nWARC-Refers-To-Target-URI: "), clean(F.col("first_url"))))
        .otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block),
        F.lit("\r\n\r\n"))
    records = chosen.select(F.concat(head, block).alias("value"))
    if not compress:
        # The closing blank lines of a record are the separator of the text writer.
        records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)
        return

    @F.pandas_udf("binary")
    def member(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _gzip(v.encode()))

    (records.select(member("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", _gzip(END).decode("latin-1")).option("maxRecordsPerFile", per_file).text(path))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- the reader

class _Ahead:
    """The next place of a pattern at or after a position that only grows: each byte of
    the data is searched once, however many positions are asked for."""

    def __init__(self, data: bytes, pattern: re.Pattern):
        self.data, self.pattern, self.asked, self.found = data, pattern, 0, -1

    def __call__(self, pos: int) -> int:
        """Where it starts; the length of the data if it is not there."""
        if pos < self.asked or self.found < pos:
            hit = self.pattern.search(self.data, pos)
            self.asked, self.found = pos, hit.start() if hit else len(self.data)
        return self.found


def _fields(data: bytes, at: int, end: int) -> dict[str, str]:
    """Header fields of the lines after the first one in ``data[at:end]``."""
    out = {}
    at = data.find(b"\r\n", at, end)
    while at >= 0:
        stop = data.find(b"\r\n", at + 2, end)
        line = data[at + 2:end if stop < 0 else stop]
        at = stop
        key, sep, value = line.partition(b":")
        if not sep:
            raise ValueError("malformed header line")
        out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _record(data: bytes, pos: int, blank: _Ahead) -> tuple[int, dict]:
    """(end, fields) of the record at ``pos``; ValueError says which check failed. The
    error's second argument, if any, is where the framing of the bad record ends.
    ``blank`` finds the blank line that ends a header."""
    if not VERSION.match(data, pos):
        raise ValueError("no version line")
    head_end = blank(pos)
    if head_end == len(data):
        raise ValueError("unfinished header")
    fields = _fields(data, pos, head_end)
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no content length")
    start = head_end + len(END)
    end = start + int(length)
    if end > len(data):
        raise ValueError("truncated block")
    after = data[end:end + 4]
    if after != END and end != len(data):
        raise ValueError("record does not end at its length")
    end = min(end + 4, len(data))
    framed = end == len(data) or VERSION.match(data, end)
    block = memoryview(data)[start:start + int(length)]
    payload, http = block, {}
    if fields.get("content-type", "").startswith("application/http"):
        cut = data.find(END, start, start + int(length))
        if cut < 0:
            raise ValueError("unfinished http header", *([end] if framed else []))
        payload = memoryview(data)[cut + len(END):start + int(length)]
        try:
            http = _fields(data, start, cut)
        except ValueError as bad:
            raise ValueError(str(bad), *([end] if framed else [])) from None
    digest = fields.get("warc-payload-digest", "")
    kind = fields.get("warc-type")
    if kind != "revisit" and digest.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
            raise ValueError("payload digest differs", *([end] if framed else []))
    size = http.get("content-length", "") if kind == "revisit" else str(len(payload))
    return end, {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": digest.removeprefix("sha1:") or None,
        "payload_bytes": int(size) if size.isdigit() else None, "payload": None if kind == "revisit" else bytes(payload)}


def _member(data: bytes, pos: int, most: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member at ``pos``; ValueError if it is damaged, or framed
    by its end if the content has over ``most`` bytes. Inflated in steps, so that neither a
    bomb nor the rest of the file is held."""
    unpack, at, parts, size = zlib.decompressobj(31), pos, [], 0
    view = memoryview(data)
    while not unpack.eof:
        step = unpack.unconsumed_tail
        if not step:
            if at >= len(data):
                raise ValueError("truncated gzip member")
            step = view[at:at + STEP]
            at += len(step)
        try:
            part = unpack.decompress(step, STEP * 16)
        except zlib.error as bad:
            raise ValueError(f"bad gzip member: {bad}") from None
        size += len(part)
        if size <= most:
            parts.append(part)
        else:
            parts.clear()
    end = at - len(unpack.unused_data)
    if size > most:
        raise ValueError(f"gzip member of over {most} bytes", end)
    return end, b"".join(parts)


def _at(data: bytes, pos: int, blank: _Ahead, most: int) -> tuple[int, dict | None]:
    """(end, fields) of what starts at ``pos``: a plain record, or a gzip member with
    one record. Fields are None for a member of blank lines only."""
    if data.startswith(MEMBER, pos):
        end, content = _member(data, pos, most)
        if not content.strip(b"\r\n"):
            return end, None
        try:
            stop, fields = _record(content, 0, _Ahead(content, BLANK))
        except ValueError as bad:  # its offsets are of the content; the member is framed by its own end
            raise ValueError(str(bad.args[0]), end) from None
        if content[stop:].strip(b"\r\n"):
            raise ValueError("more than a record in a gzip member", end)
        return end, fields
    return _record(data, pos, blank)


def salvage(data: bytes, member_bytes: int = MEMBER_BYTES) -> Iterator[dict]:
    """Records and gaps of one archive, in order, as dicts of ``RECORD_SCHEMA`` without
    the file. Every byte belongs to a record, a gap or blank lines between records.

    A gzip member whose content has over ``member_bytes`` bytes is quarantined. The search
    after a failure keeps the next version line, member and blank line it has seen, so
    damage costs time in proportion to the file, not to failures times the file."""
    pos, gap, reason = 0, None, ""
    version, member, blank = _Ahead(data, VERSION), _Ahead(data, MAGIC), _Ahead(data, BLANK)

    def quarantined(end):
        return {"kind": "gap", "offset": gap, "length": end - gap, "reason": reason}

    while pos < len(data):
        if data[pos] in b"\r\n" and gap is None:
            pos += 1
            continue
        try:
            end, fields = _at(data, pos, blank, member_bytes)
        except ValueError as bad:
            if gap is None:
                gap, reason = pos, str(bad.args[0])
            if len(bad.args) > 1:  # framed: what lies inside is not a record of its own
                pos = bad.args[1]
            else:
                pos = min(version(pos + 1), member(pos + 1))
            continue
        if gap is not None:
            yield quarantined(pos)
            gap = None
        if fields is not None:
            yield {"kind": "record", "offset": pos, "length": end - pos, **fields}
        pos = end
    if gap is not None:
        yield quarantined(len(data))


def read_archives(spark: SparkSession, path: str, payloads: bool = True, glob: str = "[!_.]*") -> DataFrame:
    """Records (``kind`` = record) and quarantined byte ranges (``kind`` = gap) of all
    archives under ``path``. ``payload_bytes`` and ``payload_digest`` are of the full
    payload, also for revisits, whose payload is null. An empty folder gives no row.

    An archive is read whole by one task, so a file should stay in the order of
    hundreds of megabytes; ``write_archives`` bounds its files."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path"), batch.column("content")):
                rows = []
                for row in salvage(data.as_py() or b""):
                    rows.append(row | {"file": file.as_py()} | ({} if payloads else {"payload": None}))
                    if len(rows) == 1024:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    def _table(rows):
        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], types[f.split()[1]]) for n, f in zip(names, RECORD_SCHEMA.split(", "))], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def page_number(record_id: Column) -> Column:
    """The id inside ``<urn:page:...>``; null for a null id."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
