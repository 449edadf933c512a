"""BPE encoding and decoding through a distinct-word table.

Texts are split into words as the tokenizer's pre-tokenizer does; each distinct word is encoded
once, by the tokenizers library, and its ids are laid out at the word's positions. Decoding joins
ids to pieces, a table as large as the vocabulary (so its size is bounded), by an Arrow gather.

``encode`` keeps a distinct-word table in each Python worker: it fills as batches come, task after
task, and is emptied when it holds ``KNOWN_WORDS``. Nothing is shuffled. ``encode_joined`` makes one table of the
whole corpus instead: documents are dealt to groups of bounded size, each group's distinct words
are joined to the corpus's distinct words, which are encoded once, and the ids are laid out group
by group. It moves every text once and every word once per group; the README has its figures.

Special tokens that stand in a text are encoded as such, as the library does by default.

Defined cases: null is empty; an empty text has no ids; very long texts are split whole, by one
task; repeated rows are encoded alike; rows with a null key are encoded too.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, kind_of, stored, table

GROUP_CHARS, KNOWN_WORDS, BATCH = 1 << 23, 1 << 17, 100

#: Fixed: the pattern by which byte-level BPE of this kind splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for
    themselves, the others for letters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What of a tokenizer file the operators use."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            source = json.load(file)
        self.special = {t["content"]: t["id"] for t in source["added_tokens"]}
        self.model = source["model"]["vocab"]

    def pieces(self) -> list[bytes]:
        """The bytes of each id, in order; an id that is not in use has none."""
        letters = byte_letters()
        found = {i: bytes(letters[c] for c in piece) for piece, i in self.model.items()}
        found |= {i: t.encode() for t, i in self.special.items()}
        return [found.get(i, b"") for i in range(max(found) + 1)]


def splitter(special: list[str]):
    """A function from a text to its words: special tokens first, then the pattern between them."""
    words = regex.compile(PATTERN).findall
    if not special:
        return words
    ends = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")")

    def split(text: str) -> list[str]:
        parts = ends.split(text)
        if len(parts) == 1:
            return words(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else words(part))]

    return split


@lru_cache(maxsize=1)
def loaded(path: str):
    """The library's tokenizer without truncation and padding, and without threads of its own; one a
    process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=1)
def known_words(path: str) -> dict[str, bytes]:
    """The words that this process has encoded, with their ids."""
    return {}


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """words(word), distinct -> (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            found = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.ids for f in found], pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


Batches = Iterator[pa.RecordBatch]


def _encoder(path: str):
    """batches(key, text) -> batches(key, ids)."""
    special = list(Vocabulary(path).special)

    def run(batches: Batches) -> Batches:
        tokenizer, split, known = loaded(path), splitter(special), known_words(path)

        def learn(words: list[str]) -> None:
            # few at a time: what the library returns for a word is far larger than its ids, which
            # are kept as bytes, four for each, so that laying them out is one join
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                known.update((w, array("i", f.ids).tobytes()) for w, f in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))

        for batch in batches:
            placed = [split(t) for t in batch.column(1).to_pylist()]
            words = set(chain.from_iterable(placed))
            new = words.difference(known)
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = words
            learn(list(new))
            laid = [b"".join(map(known.__getitem__, words)) for words in placed]
            ends = np.cumsum([0, *map(len, laid)]) // 4
            flat = np.frombuffer(b"".join(laid), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row of docs; a narrow map."""
    kind = kind_of(docs, key)
    batches_of(docs.sparkSession, BATCH)
    return _rows(docs, key, text).mapInArrow(_encoder(path), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass of Python: half the workers, and ids cross over once."""
    encoder, decoder = _encoder(path), _decoder(docs.sparkSession, path)
    kind = kind_of(docs, key)
    batches_of(docs.sparkSession, BATCH)
    both = _rows(docs, key, text).mapInArrow(lambda batches: decoder(encoder(batches)), f"key {kind}, ids array<int>, decoded binary")
    return both.withColumnRenamed("key", key)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode_joined(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row of docs."""
    vocabulary = Vocabulary(path)
    special = list(vocabulary.special)
    kind = kind_of(docs, key)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_CHARS))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("key", "text"), F.lit(groups)).cast("int")).repartition(groups, "group")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(special), {}
        for batch in batches:
            new: list[tuple[int, str]] = []
            for group, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = seen.setdefault(group, set())
                fresh = set(split(t)) - held
                held |= fresh
                new += [(group, w) for w in fresh]
                if len(held) > 1 << 20:  # repeats do no harm
                    held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in new], pa.int32()), pa.array([w for _, w in new], pa.string())], names=["group", "word"])

    batches_of(docs.sparkSession)
    used = stored(dealt.select("group", "text").mapInArrow(distinct, "group int, word string"), "words")
    ids = _encode_words(used.select("word").distinct(), path)
    by_group = used.join(ids, "word").select("group", "word", "ids")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        split = splitter(special)
        at = {w: i for i, w in enumerate(right.column("word").to_pylist())}.__getitem__
        table_of = right.column("ids").combine_chunks()
        table_of = table_of if isinstance(table_of, pa.ListArray) else pa.concat_arrays(table_of.chunks) if table_of.num_chunks else pa.array([], pa.list_(pa.int32()))
        values, offsets = [], [0]
        for t in left.column("text").to_pylist():
            flat = table_of.take(pa.array([at(w) for w in split(t)], pa.int32())).flatten()
            values.append(flat)
            offsets.append(offsets[-1] + len(flat))
        flat = pa.concat_arrays(values) if values else pa.array([], pa.int32())
        return pa.table({"key": left.column("key"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)})

    pairs = dealt.select("group", "key", "text").groupBy("group").cogroup(by_group.groupBy("group"))
    return pairs.applyInArrow(place, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def _decoder(spark, path: str):
    """batches(key, ids) -> batches(key, ids, decoded)."""
    pieces = spark.sparkContext.broadcast(Vocabulary(path).pieces())

    def run(batches: Batches) -> Batches:
        table_of = pa.array(pieces.value, pa.large_binary())
        for batch in batches:
            ids = batch.column(1)
            found = table_of.take(ids.flatten())
            # the gathered pieces lie one after another: a row's text is one cut of their bytes
            raw = memoryview(found.buffers()[2]) if len(found) else b""
            starts = np.frombuffer(found.buffers()[1], np.int64)[found.offset :] if len(found) else np.zeros(1, np.int64)
            ends = starts[np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])]
            cut = [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.binary())], names=["key", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) -> the same with ``decoded``, the bytes of the ids' pieces (binary).

    The pieces go to every task: they are as many as the vocabulary has.
    """
    kind = kind_of(encoded, key)
    rows = encoded.select(F.col(key).alias("key"), "ids")
    return rows.mapInArrow(_decoder(encoded.sparkSession, path), f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): whole texts decode to their own valid UTF-8."""
    return decoded.select(key, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe_round_trip(spark, sf_dir):
    path = vocabulary_path()
    return digests(round_trip(table(spark, sf_dir, "documents"), path))
