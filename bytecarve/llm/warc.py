r"""WARC archives of pages, with revisit records, and a salvage reader.

Records are gzip members of their own. The reader checks every member (gzip CRC, record length, payload
digest); after a failed check it searches for the next valid member or ``WARC/1.`` version line, goes on
from there, and logs the bytes between as a quarantined gap. The whole records of a damaged member of several are kept
too. A record of type application/http has its digest over the HTTP body. Reading is linear in the archive:
members are inflated piece by piece, up to MOST_BYTES, and no stretch is searched twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import read_file, write_file
from .shared import hot_keys, limit_arrow, materialise, salted_join, work_dir

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: Compressed bytes at which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Inflated bytes beyond which a member is quarantined.
MOST_BYTES = 1 << 30
_PIECE = 1 << 16
_ID = "urn:bytecarve:page:"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit carries the payload's digest and length but not its bytes."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    offset: int
    http: bytes = b""  # the HTTP head in front of the payload


@dataclass
class Salvage:
    """Records of an archive in order; gaps (start, end, reason) are the bytes that gave none."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """A record of plain bytes at ``at`` and the place after it; ValueError if it fails a check."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the record does not end at its length")
    payload, http = data[start:stop], b""
    if headers.get("content-type", "").lower().startswith("application/http") and headers.get("warc-type") == "response":
        head, gap, payload = payload.partition(b"\r\n\r\n")
        http = head + gap
    told = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and told.startswith("sha1:") and told[5:] != digest(payload):
        raise ValueError("payload digest differs")
    return Record(headers, payload, at, http), stop + 4


class Damaged(ValueError):
    """A member that failed a check; ``found`` are the whole records in it."""

    def __init__(self, reason: str, found: list[Record]) -> None:
        super().__init__(reason)
        self.found = found


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The inflated bytes of the gzip member at ``at``, the place after it, and what is wrong with it."""
    inflate, parts, size, k = zlib.decompressobj(31), [], 0, at
    try:
        while not inflate.eof:
            piece = inflate.unconsumed_tail or bytes(data[k : k + _PIECE])
            if not piece:
                return b"".join(parts), k, "gzip: the member is cut off"
            if not inflate.unconsumed_tail:
                k += len(piece)
            parts.append(inflate.decompress(piece, 1 << 20))
            size += len(parts[-1])
            if size > MOST_BYTES:
                return b"", k, f"gzip: the member inflates to over {MOST_BYTES} bytes"
    except zlib.error as e:
        return b"".join(parts), k, f"gzip: {e}"
    return b"".join(parts), k - len(inflate.unused_data), ""


def _member(data: bytes, view: memoryview, at: int) -> tuple[list[Record], int]:
    """All records of the gzip member or the plain record at ``at``, and the place after it."""
    if not data.startswith(_MAGIC, at):
        one, after = _parse(data, at)
        return [one], after
    if len(data) > at + 3 and data[at + 3] & 0xE0:
        raise Damaged("gzip: reserved flags", [])
    plain, after, wrong = _inflate(view, at)
    inner, found = 0, []
    while inner < len(plain):
        try:
            one, inner = _parse(plain, inner)
        except ValueError as e:
            wrong = wrong or str(e)
            following = _VERSION.search(plain, inner + 1)
            inner = following.start() if following else len(plain)
            continue
        one.offset = at
        found.append(one)
    if wrong:
        raise Damaged(wrong, found)
    return found, after


def salvage(data: bytes) -> Salvage:
    """Read what can be read of an archive, compressed by record or plain."""
    out, at, bad, reason, version, view = Salvage(), 0, None, "", -1, memoryview(data)
    again: list[Record] = []  # records of a damaged member, whose bytes a stored block shows once more
    while at < len(data):
        try:
            found, after = _member(data, view, at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            again += getattr(e, "found", [])
            out.records += getattr(e, "found", [])
            if version <= at:
                following = _VERSION.search(data, at + 1)
                version = following.start() if following else len(data)
            magic = data.find(_MAGIC, at + 1, version)
            at = magic if magic >= 0 else version
            continue
        if bad is not None and len(found) == 1 and any(found[0].headers == r.headers and found[0].payload == r.payload for r in again):
            at = after
            continue
        if bad is not None:
            out.gaps.append((bad, at, reason))
            bad, again = None, []
        out.records += found
        at = after
    if bad is not None:
        out.gaps.append((bad, len(data), reason))
    return out


def _number(headers: dict[str, str], name: str) -> int | None:
    value = headers.get(name, "").strip("<>")
    return int(value[len(_ID) :]) if value.startswith(_ID) and value != _ID else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a name for each attempt: the listing names the files of the one that counts
        task, serial, held, size = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0, [], 0
        out = []

        def close() -> None:
            nonlocal serial, held, size
            if held:
                path = f"{folder}/pages-{task}-{serial:04d}.warc.gz"
                write_file(path, b"".join(held))
                out.append((path, len(held)))
                serial, held, size = serial + 1, [], 0

        for batch in batches:
            for row in batch.to_pylist():
                one = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["revisit"])
                held.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "n_records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC files in ``folder``: (path, n_records) of each file.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest page_id is the response
    and the others revisit it; smaller payloads are all responses. A null html is an empty payload. A null page_id never
    is the response of a group with another id; rows that repeat the largest id are all responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    limit_arrow(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    raw = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumns({"sha1": F.sha1(raw), "n": F.octet_length(raw)})
    groups = rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and response is not null")
    groups = materialise(groups, f"{folder}/groups")
    # payloads that very many pages have are spread; by a shuffle at every size, since both sides grow
    joined = salted_join(rows, groups, "sha1", hot_keys(groups, "sha1", "copies"), ["page_id", "url"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))
    return materialise(joined.mapInArrow(_writer(f"{folder}/archives"), "path string, n_records long"), f"{folder}/listing")


_READ = "path string, offset long, gap_end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, reason string"


def _reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, count in zip(frame.path, frame.n_records):
            got = salvage(read_file(path))
            if count >= 0 and len(got.records) != count:
                told = "; ".join(f"bytes {s} to {e}: {why}" for s, e, why in got.gaps[:20])
                raise ValueError(f"{path}: {len(got.records)} of {int(count)} records, {len(got.gaps)} gaps: {told}")
            rows = []
            for r in got.records:
                kind = r.headers.get("warc-type")
                revisit = kind == "revisit"
                size = int(r.headers.get("x-payload-length", "0")) if revisit else len(r.payload)
                told = r.headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(r.payload)
                rows.append((path, r.offset, r.offset, _number(r.headers, "warc-record-id"), r.headers.get("warc-target-uri"), size, told, kind, _number(r.headers, "warc-refers-to"), None if revisit else r.payload, None))
            rows += [(path, s, e, None, None, e - s, None, "gap", None, None, why) for s, e, why in got.gaps]
            out = pd.DataFrame(rows, columns=["path", "offset", "gap_end", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "reason"])
            out["page_id"], out["refers_to"] = out.page_id.astype("Int64"), out.refers_to.astype("Int64")
            yield out


def read_archives(listing: DataFrame, whole: bool = False) -> DataFrame:
    """All records of the files in ``listing`` (path), and a row with record_type ``gap`` for each quarantined byte range.

    ``whole``: an archive with another number of records than its ``n_records`` is an error that tells the gaps.
    """
    n = max(1, listing.count())
    count = F.col("n_records") if whole else F.lit(-1)
    return listing.select("path", count.cast("long").alias("n_records")).repartition(n).mapInPandas(_reader, _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Fails if an archive gives fewer records than were written to it.
    """
    listing = write_archives(pages, work_dir(pages.sparkSession, "warc"), **options)
    return read_archives(listing, whole=True).where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
      right('000' || CAST(CAST(bin(strpos('0123456789abcdef', h[i]) - 1) AS VARCHAR) AS VARCHAR), 4)), '') AS bits,
    max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
      CAST(bits[5 * k + j + 1] AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
