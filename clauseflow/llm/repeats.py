"""Repeated fixed-length windows of a corpus: what the two substring operators share.

A window is ``window`` consecutive units (words or bytes) of one document. Each window is assigned
to the k-gram in it whose rolling hash is least, its trigger. Neighbouring windows with one trigger
form a phrase: it runs from the first such window to the end of the last one, so phrases overlap by
``window - 1`` units, every window lies in exactly one phrase, and equal windows, wherever they
stand, lie in phrases with the same trigger and at the same distance from it. (Hashes are compared
by their first 43 bits, the leftmost of equal ones wins: that depends on the window alone.)

So the corpus becomes a parse (one row for each phrase occurrence, no text) and a dictionary of
distinct phrases. Only phrases whose trigger occurs twice can hold a repeated window:

* if all occurrences of a trigger are one phrase, the parse alone settles it;
* otherwise the distinct phrases' contents are fetched and compared trigger by trigger, in shards
  of bounded size (a suffix array or a suffix automaton; ``rows`` phrases or one trigger's);
* a trigger with more distinct phrases than a shard holds is not gathered: its windows are hashed
  one by one, once, and aggregated, which is exact too (128-bit hashes) and has no hot group.

In periodic text every period is a phrase of its own, equal to the one before; such runs are one row
of the parse with a count (``times``), so they make no hot trigger.

Everything is shuffled by trigger or by document, as small rows; whole texts move twice, by
document. A document's own phrases are its size at most. Where rows are joined to what their own
trigger or window sums up to, both sides are dealt by a salt as well (``_spread``); where occurrences
are joined to what is known of their trigger or phrase, the hot ones are (``_salted``). So a trigger, a
phrase or a window that very many rows share is spread over SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, batches_of, hot_keys, kind_of, released, stored

TILE, SALTS = 1 << 19, 32
#: Low bits of a key that hold a place in a chunk, which has under 2 * TILE units and a window.
_PLACE = np.uint64((1 << 21) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)

#: Text (UTF-8) -> its units as a uint64 array, and where units stand: what ``piece`` cuts.
Units = Callable[[bytes], np.ndarray]


def _grams(units: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-grams (k a power of two); the last k - 1 are meaningless."""
    h = (units + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    size = 1
    while size < k:
        right = np.zeros_like(h)
        right[:-size] = h[size:]
        h = h * _ODD + right
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(30)
        size *= 2
    return h


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive keys, by doubling."""
    n, size, cur = len(keys), 1, keys
    while size * 2 <= span:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    last = n - span + 1
    return np.minimum(cur[:last], cur[span - size : span - size + last])


def phrases(chunk: list[tuple[int, int, np.ndarray]], k: int, window: int) -> tuple[np.ndarray, ...]:
    """chunk: (row, base, units) tiles -> row, first, windows, times, trigger's distance, its hash,
    content.

    ``first`` is the first window's place in the document, ``times`` how often the phrase follows
    upon itself there, and ``content`` two 64-bit halves of the phrase's hash.
    """
    units = np.concatenate([u for _, _, u in chunk])
    sizes = np.array([len(u) for _, _, u in chunk])
    ends = np.cumsum(sizes)
    n = len(units)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64)) + (np.zeros((0, 2), np.int64),)
    if n < window:
        return empty
    if n > int(_PLACE):
        raise ValueError("the chunk is too long")
    grams = _grams(units, k)
    keys = grams & ~_PLACE | np.arange(n, dtype=np.uint64)
    place = (_least(keys, window - k + 1) & _PLACE).astype(np.int64)
    whole = np.zeros(n + 1, np.int32)
    starts = ends - sizes
    fits = sizes >= window
    whole[starts[fits]] += 1
    whole[(ends - window + 1)[fits]] -= 1
    at = np.flatnonzero(np.cumsum(whole[: len(place)]))
    if not len(at):
        return empty
    place = place[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    first = at[new]
    count = np.diff(np.append(new, len(at)))
    trigger = place[new]
    tile = np.searchsorted(ends, first, side="right")
    content = _digests(units, first, first + count + window - 1)
    rows = np.array([r for r, _, _ in chunk])[tile]
    base = np.array([b for _, b, _ in chunk], np.int64)[tile] - starts[tile]
    first, ahead, hashed = first + base, trigger - first, grams[trigger].view(np.int64)
    same = (rows[1:] == rows[:-1]) & (first[1:] == first[:-1] + count[:-1]) & (count[1:] == count[:-1]) & (hashed[1:] == hashed[:-1]) & (content[1:] == content[:-1]).all(axis=1)
    kept = np.flatnonzero(np.concatenate([[True], ~same]))
    times = np.diff(np.append(kept, len(rows)))
    return rows[kept], first[kept], count[kept], times, ahead[kept], hashed[kept], content[kept]


def _digests(units: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(units).view(np.uint8))
    size = units.itemsize
    found = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((lo * size).tolist(), (hi * size).tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def content_hash(units: np.ndarray) -> tuple[int, int]:
    a, b = _digests(units, np.array([0]), np.array([len(units)]))[0]
    return int(a), int(b)


def _tiles(texts: list[bytes], units: Units, window: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Documents in chunks of about TILE units; a longer one in tiles that overlap by a window."""
    chunk, size = [], 0
    for row, text in enumerate(texts):
        whole = units(text)
        for base in range(0, max(1, len(whole) - window + 1), TILE):
            tile = whole[base : base + TILE + window - 1]
            if len(tile) < window:
                continue
            chunk.append((row, base, tile))
            size += len(tile)
            if size >= TILE:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def parse(docs: DataFrame, units: Units, k: int, window: int) -> DataFrame:
    """docs(key, text binary) -> a row for each phrase occurrence, without its text."""
    kind = kind_of(docs, "key")
    names = ["key", "first", "windows", "times", "ahead", "trigger", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for chunk in _tiles(batch.column(1).to_pylist(), units, window):
                rows, first, count, times, ahead, trigger, content = phrases(chunk, k, window)
                arrays = [pa.array(x, t) for x, t in ((first, pa.int32()), (count, pa.int32()), (times, pa.int32()), (ahead, pa.int32()), (trigger, pa.int64()), (content[:, 0], pa.int64()), (content[:, 1], pa.int64()))]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *arrays], names=names)

    batches_of(docs.sparkSession)
    schema = f"key {kind}, first int, windows int, times int, ahead int, trigger bigint, c1 bigint, c2 bigint"
    return docs.where("key IS NOT NULL").mapInArrow(run, schema)


def repeated(docs: DataFrame, units: Units, piece: Callable[[bytes, list[tuple[int, int]]], list[bytes]], shard: Callable, k: int, window: int, held: list[str], rows: int = 4096) -> DataFrame:
    """(key, first, lo, hi, least, copies): windows lo..hi (from the phrase's first one, inclusive)
    that start ``copies`` times in all, ``least`` being the least key that holds them.

    Only windows with two starts or more are listed. ``piece(text, ranges)`` returns the contents
    of ranges of units and ``shard(rows)`` compares phrases: rows are (trigger, ahead, windows,
    copies, least, content); it yields for each row the ranges (lo, hi, copies, least). ``held`` gets
    the tables that the result reads.
    """
    kind = (kind_of(docs, "key"), arrow_type(docs, "key"))
    first: list[str] = []
    found = stored(parse(docs, units, k, window), "parse", first)
    often = found.groupBy("trigger").agg(F.sum("times").alias("n"), F.count("*").alias("met")).where("n > 1")
    often = stored(often.select("trigger", "met"), "often", first)
    occurrences = stored(_salted(found, often, ["trigger"], "left_semi"), "occurrences", held)
    released(docs.sparkSession, first)
    words = ["trigger", "c1", "c2"]
    dictionary = occurrences.groupBy(*words).agg(
        F.sum("times").alias("copies"), F.count("*").alias("met"), F.min("key").alias("least"), F.min(F.struct("key", "first", "windows", "ahead")).alias("at")
    )
    dictionary = stored(dictionary.withColumn("salt", _salt("c1")), "dictionary", held)
    kinds = dictionary.groupBy("trigger", "salt").agg(F.count("*").alias("kinds"))
    sized = dictionary.join(_spread(kinds, ["trigger"], F.sum("kinds").alias("kinds")), ["trigger", "salt"]).drop("salt")

    alone = sized.where("kinds = 1").select(*words, F.array(F.struct(F.lit(0).alias("lo"), (F.col("at.windows") - 1).alias("hi"), "copies", "least")).alias("ranges"))

    wanted = sized.where("kinds > 1").select(
        F.col("at.key").alias("key"),
        F.struct("trigger", "c1", "c2", F.col("at.first").alias("first"), F.col("at.windows").alias("windows"), F.col("at.ahead").alias("ahead"), "copies", "least", (F.col("kinds") > rows).alias("crowd")).alias("phrase"),
    )
    by_doc = wanted.groupBy("key").agg(F.collect_list("phrase").alias("phrases"))
    contents = stored(_contents(by_doc.join(docs, "key"), kind, units, piece, window), "contents", held)

    shards = contents.where("NOT crowd").drop("crowd").repartition("trigger").sortWithinPartitions("trigger")
    compared = _compared(shards, kind, shard, rows)

    windows = stored(_hashed(contents.where("crowd"), kind, units, window).withColumn("salt", _salt("c1")), "windows", held)
    parts = windows.groupBy("w1", "w2", "salt").agg(F.sum("copies").alias("copies"), F.min("least").alias("least"))
    totals = _spread(parts, ["w1", "w2"], F.sum("copies").alias("copies"), F.min("least").alias("least")).where("copies > 1")
    single = windows.drop("copies", "least").join(totals, ["w1", "w2", "salt"])
    hashed = single.groupBy(*words).agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), "copies", "least")).alias("ranges"))

    ranges = alone.union(compared.select(alone.columns)).union(hashed.select(alone.columns))
    met = _salted(occurrences, ranges, words, counts=dictionary).select("key", "first", "windows", "times", F.inline("ranges"))
    # a range of the whole phrase goes on through all its times, any other starts anew each time
    through = (F.col("lo") == 0) & (F.col("hi") == F.col("windows") - 1)
    starts = F.when(through, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("times") - 1))
    last = F.when(through, F.col("times") * F.col("windows") - 1).otherwise(F.col("hi"))
    each = met.select("key", "first", "windows", "lo", last.alias("hi"), "copies", "least", F.explode(starts).alias("i"))
    return each.select("key", (F.col("first") + F.col("i") * F.col("windows")).alias("first"), "lo", "hi", "copies", "least")


def _salt(name: str) -> F.Column:
    return F.pmod(F.col(name), F.lit(SALTS)).cast("int")


def _salted(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows(key, first, ...) joined with ``wanted``, which has each of the keys once. Rows of a hot key,
    by ``met`` in ``counts`` (wanted itself by default), are dealt over SALTS tasks by their places,
    and what is wanted of it goes to each."""
    hot = F.broadcast(hot_keys(wanted if counts is None else counts, [*keys, F.lit(True).alias("hot")], "met"))
    place = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "first"), F.lit(SALTS)).cast("int")).otherwise(0)
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, keys, "left").withColumn("salt", place).drop("hot")
    copied = wanted.join(hot, keys, "left").withColumn("salt", F.explode(places)).drop("hot")
    return dealt.join(copied, [*keys, "salt"], how).drop("salt")


def _spread(parts: DataFrame, keys: list[str], *sums: F.Column) -> DataFrame:
    """parts(keys, salt, partial sums) -> (keys, salt, sums): the key's sums beside each of its salts,
    so that rows join them by key and salt. A key has SALTS parts at the most."""
    whole = parts.groupBy(*keys).agg(*sums, F.collect_set("salt").alias("salts"))
    return whole.withColumn("salt", F.explode("salts")).drop("salts")


def _contents(rows: DataFrame, kind: tuple[str, pa.DataType], units: Units, piece, window: int) -> DataFrame:
    """A row for each wanted phrase with its content; the hash proves that it is the right one."""
    fields = ("trigger", "c1", "c2", "windows", "ahead", "copies", "least", "crowd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("phrases").to_pylist(), strict=True):
                spans = [(p["first"], p["first"] + p["windows"] + window - 1) for p in wanted]
                for p, content in zip(wanted, piece(text, spans), strict=True):
                    if content_hash(units(content)) == (p["c1"], p["c2"]):
                        out.append({f: p[f] for f in fields} | {"content": content})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("trigger", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("windows", pa.int32()), ("ahead", pa.int32()), ("copies", pa.int64()), ("least", kind[1]), ("crowd", pa.bool_()), ("content", pa.binary())])
    return rows.select("text", "phrases").mapInArrow(run, f"trigger bigint, c1 bigint, c2 bigint, windows int, ahead int, copies bigint, least {kind[0]}, crowd boolean, content binary")


_RANGES = "array<struct<lo:int,hi:int,copies:bigint,least:{}>>"


def _compared(rows: DataFrame, kind: tuple[str, pa.DataType], shard, most: int) -> DataFrame:
    """Rows sorted by trigger, handed to ``shard`` in runs of whole triggers of about ``most`` rows."""
    schema = pa.schema([("trigger", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("ranges", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("copies", pa.int64()), ("least", kind[1])])))])

    def answer(rows: list[dict]) -> pa.RecordBatch:
        found = shard(rows)
        out = [{"trigger": r["trigger"], "c1": r["c1"], "c2": r["c2"], "ranges": [dict(zip(("lo", "hi", "copies", "least"), x, strict=True)) for x in f]} for r, f in zip(rows, found, strict=True) if f]
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= most and row["trigger"] != held[-1]["trigger"]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return rows.mapInArrow(run, f"trigger bigint, c1 bigint, c2 bigint, ranges {_RANGES.format(kind[0])}")


def _hashed(rows: DataFrame, kind: tuple[str, pa.DataType], units: Units, window: int) -> DataFrame:
    """Every window of the phrases by itself, as a 128-bit hash."""
    names = ["trigger", "c1", "c2", "copies", "least", "at", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, digests = [], []
            for i, (content, count) in enumerate(zip(batch.column("content").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
                lo = np.arange(count)
                digests.append(_digests(units(content), lo, lo + window))
                parts.append((np.full(count, i), lo))
            if not parts:
                continue
            row, at, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(digests)
            held = [batch.column(n).take(pa.array(row)) for n in names[:5]]
            yield pa.RecordBatch.from_arrays([*held, pa.array(at, pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1])], names=names)

    return rows.mapInArrow(run, f"trigger bigint, c1 bigint, c2 bigint, copies bigint, least {kind[0]}, at int, w1 bigint, w2 bigint")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; touching ones join."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]
