"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

A corpus is encoded, and each document's ids are followed by an end id. Ids are replaced by their
rank in the corpus, most frequent first, so most of them fit one byte. A shard holds whole documents
in key order:

    "FRID", version (uint32), documents (uint32), reserved (uint32), ids (uint64)
    ids of each document (uint32 each)
    control bytes: two bits an id, its length in bytes less one; four ids a byte, low bits first
    data bytes: the ranks, little-endian, 1 to 4 bytes each

Integers are little-endian. A folder has two Parquet tables: ``shards`` (first: the ids ahead of the
shard, keys, content) and ``ranks`` (rank, id). Lengths are looked up in a table of 256 control bytes
and all ids of a shard are decoded at once by numpy.

Spark deals documents to ranges of keys (a hash of the text splits a key that very many rows share),
sorts them there and encodes them; frames of some ``FRAME_IDS`` ids are stored. Counts of ids, and the
ids ahead of each part, are sums over what is stored; ranking and coding is then a narrow map.

``WordEncoder`` gives the very ids of the tokenizers library. Texts made of characters whose case and
class are settled one by one are split by whole arrays, and each distinct word is encoded once a
worker by the library; any other text, and one with a special token's string, goes to it whole.

Defined cases: null texts are empty; an empty text has its end id only; a very long text is one
task's and lies whole in one shard; null keys come first; repeated rows and equal keys stand each for
themselves, ordered by a hash of their text; an empty table gives empty files and an empty result;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from .bpe import loaded
from .common import arrow_type, column, kind_of, released, stored, table
from .words import Ragged, Rows, distinct, points, slices

END, FRAME_IDS = 1, 1 << 19
_HEAD = struct.Struct("<4sIIIQ")

#: Fixed: the words of this vocabulary, after lower-casing; a word is a contraction, letters, one digit or others.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Characters that no neighbour changes in normalising: no marks that combine are among them.
_SETTLED = ((0, 0x300), (0x370, 0x3A3), (0x3A4, 0x483), (0x48A, 0x530), (0x2010, 0x2028), (0x20A0, 0x20C0), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6))
_SPACE, _LETTER, _DIGIT, _OTHER, _OPEN = range(5)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _characters(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Each character's normal form and class; the class is _OPEN where the library must decide."""
    normal = loaded(path).normalizer.normalize_str
    forms, kinds = np.arange(0xA000, dtype=np.uint32), np.full(0xA000, _OPEN, np.uint8)
    classes = [(kind, regex.compile(p).fullmatch) for kind, p in ((_SPACE, r"\p{White_Space}"), (_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"))]
    for lo, hi in _SETTLED:
        for c in range(lo, hi):
            form = normal(f"a{chr(c)}a")[1:-1]
            if len(form) == 1 and ord(form) < 0xA000 and normal(f"a{form}a")[1:-1] == form:
                forms[c], kinds[c] = ord(form), next((k for k, fits in classes if fits(form)), _OTHER)
    return forms, kinds


class WordEncoder:
    """texts -> ids of the tokenizers library, without special tokens added."""

    def __init__(self, path: str) -> None:
        self.tokenizer = loaded(path)
        with open(path, encoding="utf-8") as file:
            source = json.load(file)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in source["added_tokens"]) or "(?!)").search
        vocabulary = source["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith(source["model"]["end_of_word_suffix"])]] = True
        self.forms, self.kinds = _characters(path)
        self.known = Rows(self._fresh, self._learn)

    def _fresh(self) -> None:
        self.ids = Ragged("i4")

    def _learn(self, words: list[str]) -> None:
        """Words are encoded some hundred at a time with blanks between them: each ends with a piece
        that only ends words, which tells them apart again."""
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            spoken = np.array([self.kinds[ord(w[-1])] != _SPACE for w in part])
            text = " ".join(w for w, s in zip(part, spoken, strict=True) if s)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            sizes = np.zeros(len(part), np.int64)
            if len(ends) == spoken.sum() and (ends[-1:] == len(ids)).all():
                sizes[spoken] = np.diff(ends, prepend=0)
            else:  # a word without such an end
                each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
                ids, sizes = np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each])
            self.ids.add(ids, sizes)

    def _runs(self, characters: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where words start, each with the white space ahead of it."""
        turns = np.empty(len(kinds), bool)
        turns[:1] = True
        turns[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        at = np.flatnonzero(characters == ord("'"))
        at = at[turns[at] & (kinds[np.minimum(at + 1, len(kinds) - 1)] == _LETTER)]
        for p in at.tolist():  # the apostrophe stands alone ahead of letters
            tail = characters[p : p + 3].tobytes().decode("utf-32-le")
            size = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
            if size:
                turns[p + 1], turns[p + size] = False, True
        turns[1:] &= kinds[:-1] != _SPACE
        return np.flatnonzero(turns)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, how many each has)."""
        characters, starts = points(texts, "\n")
        open_ = np.minimum(characters, len(self.kinds) - 1)
        kinds = np.where(characters < len(self.kinds), self.kinds[open_], _OPEN)
        apart = set(np.searchsorted(starts, np.flatnonzero(kinds == _OPEN), "right") - 1)
        if any(map(self.special, texts)):
            apart |= {i for i, t in enumerate(texts) if self.special(t)}
        if apart:
            return self._mixed(texts, apart)
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        characters = self.forms[characters]
        runs = self._runs(characters, kinds)
        codes, words = distinct(characters, runs)
        rows = self.known.of(words)[codes]  # this may put new arrays in place of the old
        ids, sizes = self.ids.take(rows)
        # a text's first word may have its white space, and that of empty texts, ahead of the text
        before = np.concatenate([[0], np.cumsum(sizes)])[np.append(np.searchsorted(runs, starts, "right") - 1, len(runs))]
        return ids, np.diff(before)

    def _mixed(self, texts: list[str], apart: set[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.encode(["" if i in apart else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i in apart:
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts])


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One a process, so that words stay known from task to task."""
    return WordEncoder(path)


def frames(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END, size: int = FRAME_IDS) -> DataFrame:
    """(part, before, keys, sizes, ids): documents in key order, ``before`` the ids ahead in the part."""
    kind, key_type = kind_of(docs, key), arrow_type(docs, key)
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part, before = encoder(path), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def frame() -> pa.RecordBatch:
            nonlocal before
            counts, ids = np.concatenate(sizes), np.concatenate(held)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([[k for some in keys for k in some.to_pylist()]], pa.list_(key_type)),
                pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                pa.array([ids.astype("<u4").tobytes()], pa.binary()),
            ]
            before += len(ids)
            for some in (keys, sizes, held):
                some.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "before", "keys", "sizes", "ids"])

        for batch in batches:
            for some in slices(batch):
                ids, counts = work.encode(some.column(1).to_pylist())
                keys.append(some.column(0))
                sizes.append(counts + 1)
                held.append(np.insert(ids, np.cumsum(counts), end))
                if sum(map(len, held)) >= size:
                    yield frame()
        if keys:
            yield frame()

    return rows.select("key", "text").mapInArrow(run, f"part int, before bigint, keys array<{kind}>, sizes binary, ids binary")


def counted(ids: DataFrame) -> DataFrame:
    """ids(ids binary) -> (id, n): summed up in a vocabulary-length vector a task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                some = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"), minlength=len(total))
                some[: len(total)] += total
                total = some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# the table of control bytes: the four lengths, and the bytes of all four
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1


def pack(ranks: np.ndarray, sizes: np.ndarray) -> bytes:
    """A shard's bytes."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return b"".join([_HEAD.pack(b"FRID", 1, len(sizes), 0, len(ranks)), sizes.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, ids of each document) of a shard."""
    magic, version, n_docs, _, n = _HEAD.unpack_from(content)
    if (magic, version) != (b"FRID", 1):
        raise ValueError("no shard of this format")
    sizes = np.frombuffer(content, "<u4", n_docs, _HEAD.size)
    at = _HEAD.size + 4 * n_docs
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    lengths = _LENGTHS[control].ravel()[:n]
    data = np.frombuffer(content, np.uint8, offset=at + len(control))
    if sizes.sum(dtype=np.int64) != n or lengths.sum() != len(data):
        raise ValueError("a damaged shard")
    starts, data = np.cumsum(lengths) - lengths, np.append(data, np.zeros(3, np.uint8))
    ranks = data[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = lengths > k
        if not longer.any():
            break
        ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks, sizes


def write_ids(docs: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Writes ``folder``/shards and ``folder``/ranks.

    The driver gets the counts of ids, as many as the vocabulary has, and a number for each part.
    """
    spark, held, path = docs.sparkSession, [], path or vocabulary_path()
    made = stored(frames(docs, path, key, text, end), "frames", held)
    counts = counted(made).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64)
    ranks = np.zeros(counts.max() + 1 if len(counts) else 0, np.uint32)
    ranks[counts] = np.arange(len(counts))
    sums = made.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("bigint").alias("n")).orderBy("part").collect()
    first = dict(zip([r["part"] for r in sums], np.cumsum([0, *(r["n"] for r in sums)]).tolist(), strict=False))
    kind, key_type = kind_of(docs, key), arrow_type(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part, before, keys, sizes, ids = (c[i] for c in batch.columns)
                content = pack(ranks[np.frombuffer(ids.as_buffer(), "<u4")], np.frombuffer(sizes.as_buffer(), "<u4"))
                columns = [pa.array([first[part.as_py()] + before.as_py()], pa.int64()), pa.array([keys.as_py()], pa.list_(key_type)), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["first", "keys", "content"])

    made.mapInArrow(run, f"first bigint, keys array<{kind}>, content binary").write.parquet(f"{folder}/shards")
    by_rank = spark.createDataFrame(list(enumerate(counts.tolist())), "rank bigint, id bigint")
    by_rank.coalesce(1).write.parquet(f"{folder}/ranks")
    released(spark, held)


def read_ids(spark, folder: str) -> DataFrame:
    """(key, start, ids binary): a row for each document, ``start`` the ids of all documents before
    it, ``ids`` as little-endian unsigned 32-bit integers."""
    shards = spark.read.parquet(f"{folder}/shards")
    by_rank = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toPandas()["id"].to_numpy("<u4")
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ranks, sizes = unpack(batch.column(2)[i].as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = by_rank[ranks].tobytes() if len(ranks) else b""
                offsets = (4 * np.concatenate([[0], ends])).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                starts = pa.array(batch.column(0)[i].as_py() + ends - sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, starts, ids], names=["key", "start", "ids"])

    return shards.select("first", "keys", "content").mapInArrow(run, f"key {kind}, start bigint, ids binary")


def op11_id_files(spark, sf_dir):
    folder = fresh_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), folder)
    read = read_ids(spark, folder)
    return read.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
