"""Media columns: GIF images, written and read as binary columns.

``encode_gifs`` stores 8-bit samples as the frames of a GIF; ``decode_gifs`` parses any GIF87a or
GIF89a: LZW code streams, global and local palettes, interlacing, transparency and the four
disposal methods. ``round_trip_gifs`` does both in one pass. They are narrow maps over Arrow batches,
one row at a time, so that memory is bounded by a batch and nothing is shuffled; a text's cost is in
proportion to its length.

Defined cases: a null or empty payload becomes an image of one blank row; a null medium, bytes that
are no GIF, or an image that asks for more than ``CANVAS`` pixels of canvas or ``PIXELS`` in all give
no frames and an ``error``; repeated rows are encoded alike; columns that have the name of one that
an operator adds are replaced by it, all others are passed on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, numbered, table, utf8, without

WIDTH, ROWS, DELAY = 192, 64, 4
#: Pixels that an image may have: bytes of a few dozen can ask for a canvas of four thousand million.
CANVAS, PIXELS = 1 << 24, 1 << 31

FRAME = T.StructType(
    [
        T.StructField("frame_no", T.IntegerType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("delay_ms", T.IntegerType()),
        T.StructField("disposal", T.IntegerType()),
        T.StructField("transparent", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("luma", T.BinaryType()),
        T.StructField("histogram", T.ArrayType(T.IntegerType())),
    ]
)
_ARROW_FRAME = pa.list_(
    pa.struct(
        [(f.name, {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.list_(pa.int32()))) for f in FRAME]
    )
)

# A code's bits depend only on how many codes came since the last clear code.
_FIRST, _LAST = 258, 4095
_CYCLE = _LAST - _FIRST + 2


def _pack(cycles: list[list[int]], end: int) -> bytes:
    """Codes (eight bits to the left) of an 8-bit stream as little-endian bits; a clear code precedes
    every cycle."""
    codes, widths = [], []
    for i, cycle in enumerate(cycles):
        # the clear code that ends a cycle has that cycle's width, the first one nine bits
        codes.append(256 << 8)
        widths.append(9 if i == 0 else _width(len(cycles[i - 1])))
        codes += cycle
        widths.append(_WIDTHS[: len(cycle)])
    codes.append(end << 8)
    widths.append(_width(len(cycles[-1])))
    code = np.array(codes, np.uint32) >> 8
    width = np.concatenate([np.atleast_1d(np.asarray(w, np.int64)) for w in widths])
    bits = np.zeros((len(code), 12), np.uint8)
    for k in range(12):
        bits[:, k] = (code >> k) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def _width(n: int) -> int:
    return min(12, max(9, (_FIRST - 1 + n).bit_length()))


_WIDTHS = np.array([_width(n) for n in range(_CYCLE + 1)])


def lzw_encode(data: bytes) -> bytes:
    """The LZW stream of 8-bit samples; the table is cleared whenever it is full."""
    cycles: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    # codes stand eight bits to the left, so that the next sample completes a key
    slot, full = _FIRST << 8, _LAST + 1 << 8
    prefix = data[0] << 8
    put = codes.append
    for sample in data[1:]:
        key = prefix | sample
        if key in known:
            prefix = known[key]
            continue
        put(prefix)
        known[key] = slot
        slot += 256
        prefix = sample << 8
        if slot == full:
            cycles.append(codes)
            codes, slot = [], _FIRST << 8
            known.clear()
            put = codes.append
    put(prefix)
    cycles.append(codes)
    return _pack(cycles, 257)


def lzw_decode(bits: int, stream: bytes, pixels: int) -> bytes:
    """Up to ``pixels`` samples of a code stream whose samples have ``bits`` bits.

    All codes of one width are unpacked at once; a clear or end code among them cuts the run.
    """
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total = 8 * len(stream)
    clear, at = 1 << bits, 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    known, last, width = list(base), b"", bits + 1
    out: list[bytes] = []
    made = 0
    while made < pixels and at + width <= total:
        free = min(1 << width, 4096) - len(known)
        room = free + (not last) if free else total
        place = at + width * np.arange(max(1, min(room, (total - at) // width)))
        byte = place >> 3
        run = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7).astype(np.uint32) & ((1 << width) - 1)
        stops = np.flatnonzero((run == clear) | (run == clear + 1))
        stop = stops[0] if len(stops) else len(run)
        codes = run[:stop].tolist()
        at += width * (stop + (stop < len(run)))
        if not free:  # the table is full and stays as it is
            pieces = [known[code] for code in codes]
        else:
            pieces, add = [], known.append
            put = pieces.append
            if codes and not last:
                last = known[codes.pop(0)]
                put(last)
            size = len(known)
            for size, code in enumerate(codes, size):
                if code < size:
                    piece = known[code]
                elif code == size:
                    piece = last + last[:1]
                else:
                    raise ValueError(f"code {code} is not in the table")
                add(last + piece[:1])
                put(piece)
                last = piece
        done = b"".join(pieces)
        out.append(done)
        made += len(done)
        if stop < len(run):
            if run[stop] == clear + 1:
                break
            known, last, width = list(base), b"", bits + 1
        elif len(known) >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:pixels]


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A grey animation whose frames hold ``rows`` rows of ``width`` samples each, one after another."""
    if not samples or len(samples) % width:
        raise ValueError("the samples must fill whole rows")
    step = width * rows
    height = min(rows, len(samples) // width)
    palette = bytes(v for i in range(256) for v in (i, i, i))
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for start in range(0, len(samples), step):
        frame = samples[start : start + step]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0) + b"\x08")
        coded = lzw_encode(frame)
        for k in range(0, len(coded), 255):
            block = coded[k : k + 255]
            parts += (bytes([len(block)]), block)
        parts.append(b"\0")
    parts.append(b"\x3b")
    return b"".join(parts)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 3 << ((packed & 7) + 1)
    full = np.zeros((256, 3), np.uint8)
    full[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
    return full, at + n


def _rows_of(height: int) -> np.ndarray:
    """The order in which an interlaced frame stores its rows."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> list[dict]:
    """The timed frames: what of the canvas each one covers once it is drawn, as luma, and the
    canvas's colours counted in 4 x 4 x 4 bins (undrawn pixels count as black)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > CANVAS:
        raise ValueError(f"a canvas of {width} x {height} is larger than {CANVAS} pixels")
    at, shared, left_over = 13, np.zeros((256, 3), np.uint8), PIXELS
    if packed & 0x80:
        shared, at = _palette(data, at, packed)
    canvas = np.zeros((height, width, 3), np.uint8)
    frames: list[dict] = []
    disposal, delay, transparent, clock = 0, 0, -1, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else -1
            _, at = _blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError(f"block {data[at]:#x} is unknown")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        left_over -= w * h
        if w * h > CANVAS or left_over < 0:
            raise ValueError(f"a frame of {w} x {h} is larger than allowed")
        at, palette = at + 10, shared
        if packed & 0x80:
            palette, at = _palette(data, at, packed)
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        samples = lzw_decode(bits, stream, w * h)
        grid = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if packed & 0x40:
            order = np.empty_like(grid)
            order[_rows_of(h)] = grid
            grid = order
        before = canvas.copy() if disposal == 3 else None
        patch = canvas[top : top + h, left : left + w]
        grid = grid[: patch.shape[0], : patch.shape[1]]
        colours = palette[grid]
        if transparent < 0:
            patch[...] = colours
        else:
            shown = grid != transparent
            patch[shown] = colours[shown]
        wide = patch.astype(np.uint32)
        luma = ((wide[..., 0] * 299 + wide[..., 1] * 587 + wide[..., 2] * 114 + 500) // 1000).astype(np.uint8)
        cells = canvas >> 6
        counts = np.bincount((cells[..., 0] << 4 | cells[..., 1] << 2 | cells[..., 2]).ravel(), minlength=64)
        values = (len(frames), clock, delay * 10, disposal, transparent, left, top, w, h, luma.tobytes(), counts.tolist())
        frames.append(dict(zip(FRAME.names, values, strict=True)))
        clock += delay * 10
        if disposal == 2:
            patch[...] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, transparent = 0, 0, -1
    return frames


Added = list[tuple[str, str, pa.DataType]]


def _mapped(df: DataFrame, column: str, added: Added, work) -> DataFrame:
    """df with new columns that ``work(value of column)`` returns."""
    names = [n for n, _, _ in added]
    kept = without(df, *names)
    if column not in kept.columns:
        raise ValueError(f"{column} is read and written")
    at = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(v) for v in batch.column(at).to_pylist()]
            arrays = [pa.array([m[i] for m in made], kind) for i, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in added)])
    batches_of(df.sparkSession, 500)
    return numbered(kept).mapInArrow(run, schema)


def _encoded(value: bytes | None) -> bytes:
    value = value or b""
    return encode_gif(value.ljust(max(WIDTH, -(-len(value) // WIDTH) * WIDTH)))


def _decoded(value: bytes | None) -> tuple[list[dict], str | None]:
    try:
        return decode_gif(value or b""), None
    except (ValueError, IndexError, struct.error) as problem:
        return [], f"{type(problem).__name__}: {problem}"


_FRAMES: Added = [("frames", T.ArrayType(FRAME).simpleString(), _ARROW_FRAME), ("error", "string", pa.string())]


def encode_gifs(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds the binary column ``media``: the GIF of the samples in ``payload``, padded with blanks."""
    return _mapped(df, payload, [(media, "binary", pa.binary())], lambda v: (_encoded(v),))


def decode_gifs(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``frames`` (array of FRAME) and ``error`` (null unless the bytes can't be read)."""
    return _mapped(df, media, _FRAMES, _decoded)


def round_trip_gifs(df: DataFrame, payload: str, media: str = "media", samples: str = "samples") -> DataFrame:
    """Adds ``media``, what is read back from it (``frames`` and ``error`` as ``decode_gifs`` has them,
    but without luma) and ``samples``, the frames' luma one after another."""

    def work(value: bytes | None) -> tuple[bytes, bytes, list[dict], str | None]:
        stored = _encoded(value)
        frames, error = _decoded(stored)
        return stored, b"".join(f["luma"] for f in frames), [f | {"luma": None} for f in frames], error

    return _mapped(df, payload, [(media, "binary", pa.binary()), (samples, "binary", pa.binary()), *_FRAMES], work)


def frame_rows(decoded: DataFrame, *keys: str) -> DataFrame:
    """One row for each timed frame of ``decode_gifs``."""
    return decoded.select(*keys, F.inline("frames"))


def op1_gif_media(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", utf8("text").alias("text"))
    read = round_trip_gifs(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text"), "text")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("frames="), F.size("frames")),
            F.concat(F.lit("ms="), F.aggregate("frames", F.lit(0), lambda a, f: a + f["delay_ms"])),
            F.concat(F.lit("colours="), F.sha1(F.to_json(F.transform("frames", lambda f: f["histogram"])).cast("binary"))),
        ).alias("feature"),
    )
