"""WARC archives as seekable Zstandard bundles.

Records are grouped into bundles; a bundle's records are packed into independent Zstandard frames
of bounded size, and a seek table of the frames' sizes ends the bundle as a skippable frame. The
index maps each record identifier to its bundle, frame and offset in the frame, so that one record
costs one frame to read. A bundle is a row (bundle, content binary): Spark writes and reads it on
any store, and each content is a valid ``.warc.zst`` file.

Of records with equal payloads (by length and SHA-1) of at least ``least`` bytes the one with the
greatest key is stored as ``response``; the others are ``revisit`` records that name it and have no
payload. The greatest key comes from an aggregate of digests that combines before its shuffle. Digests that hold
more than 1 in HOT of the pages with repeated digests, fewer than HOT, are broadcast, so that their pages
are not shuffled; of the others only pages whose digest may repeat are.

Defined cases: a null payload is empty; a null URL becomes ``urn:unknown``; pages with equal keys
count as one origin (none refers to itself); rows with a null key are left out; an empty table
gives no bundles; keys may have any type that casts to a string and back; other columns, whatever
their names, are left alone (``marked`` replaces one that has the name of its own).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from .common import arrow_type, batches_of, column, columns, flagged, hot_keys, kind_of, released, spare, stored, table, without

FRAME_BYTES, BUNDLE_BYTES, LEAST = 1 << 18, 1 << 22, 0
_DATE = "2026-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the seekable format: the skippable frame's and the seek table's magic numbers.
_SKIP, _SEEK = 0x184D2A5E, 0x8F92EAB1


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(key: object, url: str | None, payload: bytes, origin: object | None) -> bytes:
    """One WARC/1.1 record; with an origin, a revisit of that record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if origin is None else b"")
    fields = [
        ("WARC-Type", "response" if origin is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", (url or "urn:unknown").replace("\r", " ").replace("\n", " ")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Page-Key", quote(str(key))),
    ]
    if origin is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(origin)), ("WARC-Refers-To-Key", quote(str(origin)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Fields, HTTP fields, payload and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    split = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:split].decode().split("\r\n")[1:])
    return fields, http, block[split + 4 :], end + 4 + size + 4


def pack(frames: list[bytes], level: int = 3) -> bytes:
    """Independent frames and the seek table that finds them."""
    coder = zstandard.ZstdCompressor(level=level, write_content_size=True)
    coded = [coder.compress(f) for f in frames]
    sizes = b"".join(struct.pack("<II", len(c), len(f)) for c, f in zip(coded, frames, strict=True))
    foot = sizes + struct.pack("<IBI", len(frames), 0, _SEEK)
    return b"".join(coded) + struct.pack("<II", _SKIP, len(foot)) + foot


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, coded size, size) of each frame, from the bundle's end only."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEK:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, at = [], 0
    for i in range(n):
        start = len(bundle) - 9 - width * (n - i)
        coded, size = struct.unpack_from("<II", bundle, start)
        out.append((at, coded, size))
        at += coded
    return out


def read_frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    at, coded, size = place
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + coded], max_output_size=size)


def marked(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST, origin: str = "origin", held: list[str] | None = None) -> DataFrame:
    """pages with a key, and ``origin``: the key of the record that a page revisits, null for responses.

    Digests that repeat are stored first; ``held`` gets that table."""
    kept = without(pages, origin)
    sha, size, last, n, again, most = spare(kept, "sha", "size", "last", "n", "again", "most")
    body = F.coalesce(column(payload), F.lit("")).cast("binary")
    rows = kept.where(column(key).isNotNull()).withColumn(sha, F.sha1(body)).withColumn(size, F.octet_length(body).cast("bigint"))
    groups = rows.where(F.col(size) >= least).groupBy(sha, size).agg(F.max(column(key)).alias(last), F.count("*").alias(n))
    groups = stored(groups.where(F.col(n) > 1), "repeats", held)
    hot = hot_keys(groups, [sha, size, F.col(last).alias(most)], n)
    marks = flagged(rows, sha, groups, sha, again).join(F.broadcast(hot), [sha, size], "left")
    own = columns(kept)
    greater = lambda c: F.when(F.col(c) > column(key), F.col(c)).alias(origin)
    settled = ~F.col(again) | F.col(most).isNotNull()
    joined = marks.where(~settled).join(groups.drop(n), [sha, size], "left")
    return marks.where(settled).select(*own, greater(most)).union(joined.select(*own, greater(last)))


def _bundle(key: pa.DataType) -> pa.Schema:
    entry = pa.struct([("key", key), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])
    return pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("entries", pa.list_(entry))])


def write_bundles(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> None:
    """Writes ``path``/all (bundle, content, entries: what ``index`` reads).

    The number of bundles follows the payloads' size.
    """
    kind, schema = kind_of(pages, key), _bundle(arrow_type(pages, key))
    plain = pages.select(column(key).alias("key"), column(url).alias("url"), column(payload).alias("payload"))
    tables: list[str] = []
    rows = marked(plain, "key", "payload", least, held=tables).select("key", "url", F.coalesce("payload", F.lit("")).cast("binary").alias("payload"), "origin")
    batches_of(pages.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: list[bytes] = []
        held, size, total, entries = [], 0, 0, []
        name = uuid.uuid4().hex

        def bundle() -> pa.RecordBatch:
            content = pack([*frames, b"".join(held)] if held else frames)
            return pa.RecordBatch.from_pylist([{"bundle": name, "content": content, "entries": entries}], schema)

        for batch in batches:
            for k, u, p, origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = write_record(k, u, p, origin)
                entries.append({"key": k, "record_id": record_id(k), "frame": len(frames), "offset": size})
                held.append(record)
                size += len(record)
                total += len(record)
                if size >= FRAME_BYTES:
                    frames.append(b"".join(held))
                    held, size = [], 0
                if total >= BUNDLE_BYTES:
                    yield bundle()
                    frames, held, size, total, entries = [], [], 0, 0, []
                    name = uuid.uuid4().hex
        if entries:
            yield bundle()

    made = rows.mapInArrow(run, f"bundle string, content binary, entries array<struct<key:{kind},record_id:string,frame:int,offset:int>>")
    made.write.parquet(f"{path}/all")
    released(pages.sparkSession, tables)


def index(spark, path: str) -> DataFrame:
    """(key, record_id, frame, offset, bundle)."""
    return spark.read.parquet(f"{path}/all").select(F.inline("entries"), "bundle")


def read_bundles(spark, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, record_type, url, payload_digest, refers_to, payload_size, payload) of all records, or of
    the record identifiers in ``wanted(record_id)`` only, whose frames alone are then read.
    """
    places = index(spark, path)
    if wanted is not None:
        places = places.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    asked = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("asked"))
    rows = spark.read.parquet(f"{path}/all").select("bundle", "content").join(asked, "bundle").select("content", "asked")
    batches_of(spark, 4)  # a row is a whole bundle
    kind = kind_of(places, "key")
    schema = pa.schema([("key", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_size", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = seek_table(content)
                by_frame: dict[int, list[int]] = {}
                for a in asked:
                    by_frame.setdefault(a["frame"], []).append(a["offset"])
                for frame, offsets in by_frame.items():
                    data, out = read_frame(content, places[frame]), []
                    for offset in offsets:
                        fields, http, payload, _ = read_record(data, offset)
                        if fields["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                        refers = fields.get("WARC-Refers-To-Key")
                        out.append((unquote(fields["WARC-Page-Key"]), fields["WARC-Type"], fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), refers and unquote(refers), int(http["Content-Length"]), payload))
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema)

    found = rows.mapInArrow(run, "key string, record_type string, url string, payload_digest string, refers_to string, payload_size bigint, payload binary")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to")})


def op7_warc_bundles(spark, sf_dir):
    path = fresh_path(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), path)
    read = read_bundles(spark, path)
    return read.select(F.col("key").alias("page_id"), F.col("payload_size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


# SHA-1 in hex becomes base 32 by five bits at a time: two hex digits hold eight bits, so digit i
# starts in hex digit 5 * i // 4.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages WHERE page_id IS NOT NULL
), d AS (
  SELECT page_id, n, h, html, list_transform(range(40), lambda i: instr('0123456789abcdef', h[i + 1]) - 1) AS x FROM p
), b AS (
  SELECT page_id, n, html, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x[5 * i // 4 + 1] * 16 + coalesce(x[5 * i // 4 + 2], 0)) // CAST(pow(2, 3 - (5 * i) % 4) AS INTEGER)) % 32 + 1, 1)), '') AS digest FROM d
), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END::BIGINT AS refers_to
FROM m
"""
