"""Alignment of two tokenizers' ids over a corpus, with an identity map as the fast path.

Both tokenizers cut a text's bytes (a blank ahead of it). Offsets where tokens of both end cut the
tokens into groups, and the two tokens that end there are linked. An array from each A id to the B id
of the same bytes says for most groups, those of one token each, what they are: they are counted in a
vector as long as A's vocabulary. Only the links of the other groups are pairs that Spark shuffles, a
row for each document and pair.

A text is cut into chunks, mostly a word with the blank ahead of it or a sign: neither tokenizer's tokens
reach over such an edge. A worker aligns each distinct chunk once and keeps the outcome; documents are
laid out from their chunks' numbers by whole arrays.

What is broadcast are three vectors as long as a vocabulary: A's counts, whether each is its B id's
highest, and B's highest counts. Pairs are joined by a shuffle, a pair's rows dealt by a salt.

Defined cases: texts that are null or empty, and those whose tokens' bytes differ from the text's, have
no tokens; special tokens' strings are plain text; a very long text is one task's; repeated rows, and
rows with equal or null keys, stand each for themselves; an empty table gives an empty result; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import arrow_type, column, kind_of, released, stored, table
from .words import Ragged, Rows, distinct, gathered, points, slices

SALTS, KNOWN_CHUNKS, RUN = 16, 1 << 18, 1024
#: Ids of A stand in the upper half of a pair.
_SHIFT = 32


def vocabulary_paths() -> tuple[str, str, str]:
    """A's file, B's file, and A's vocabulary once more as ranks."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))


class Pieces:
    """A tokenizer as two functions: a text to its ids, and ids to the sizes of their bytes."""

    def __init__(self, pieces: list[bytes], ids_of) -> None:
        self.pieces, self.ids_of = pieces, ids_of
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def byte_level(path: str, ranks: str | None = None) -> Pieces:
    """The tokenizer of a tokenizers file; with ``ranks``, the same vocabulary's file for tiktoken, ids
    come from that library, which takes a quarter of the time."""
    pieces = Vocabulary(path).pieces()
    if ranks:
        import tiktoken

        with open(ranks, "rb") as file:
            merges = {base64.b64decode(piece): int(i) for piece, i in map(bytes.split, file)}
        if any(pieces[i] != piece for piece, i in merges.items()):
            raise ValueError("the two files are not of one vocabulary")
        return Pieces(pieces, tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    return Pieces(pieces, lambda text: tokenizer.encode(text, add_special_tokens=False).ids)


def sentence_pieces(path: str) -> Pieces:
    """ids of a text that starts with a line feed: the blank that the model adds stands alone ahead of it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(s[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else s.replace("▁", " ").encode() for i, s in enumerate(spelt)]
    return Pieces(pieces, lambda text: model.encode(text, num_threads=1)[1:])


def identity(a: Pieces, b: Pieces) -> np.ndarray:
    """For each A id the B id of the same bytes, the first if several have them; -1 for none."""
    by_bytes: dict[bytes, int] = {}
    for i, piece in enumerate(b.pieces):
        by_bytes.setdefault(piece, i)
    return np.array([by_bytes.get(p, -1) if p else -1 for p in a.pieces], np.int64)


class Aligner:
    """Chunks to groups, remembered; ``laid`` puts documents together from them."""

    def __init__(self, a_path: str, b_path: str, ranks: str | None = None) -> None:
        self.a, self.b = byte_level(a_path, ranks), sentence_pieces(b_path)
        if any(b" " in p.lstrip(b" ") for p in self.b.pieces):
            raise ValueError("a piece reaches over a blank, so texts can't be cut there")
        if any(p[:1] != b"\n" and b"\n" in p for t in (self.a, self.b) for p in t.pieces) or self.b.pieces.count(b"\n") > 1:
            raise ValueError("a piece has a line feed and more, so chunks can't be told apart by them")
        self.joins = np.zeros((256, 256), bool)
        for piece in self.b.pieces:
            text = piece.decode(errors="replace")
            for x, y in zip(text, text[1:], strict=False):
                self.joins[min(ord(x), 255), min(ord(y), 255)] = True
        self.same = identity(self.a, self.b)
        self.alike_spelt = [f"{a}|{b}" for a, b in enumerate(self.same.tolist())]
        self.known = Rows(self._fresh, self._learn, KNOWN_CHUNKS)

    def _fresh(self) -> None:
        # of each chunk: numbers of A's tokens, of B's, of groups (-1: bytes differ); groups as text;
        # A ids of one-to-one groups, pairs of the others
        self.counts, self.spelt = Ragged("i8"), []
        self.alike, self.pairs = Ragged("i8"), Ragged("i8")

    def _learn(self, chunks: list[str]) -> None:
        """Chunks are encoded some hundred at a time, with line feeds between them, which no token has
        in common with anything else; those with white space inside are encoded by themselves."""
        run: list[str] = []
        for chunk in chunks:
            if _PLAIN(chunk) and len(run) < RUN:
                run.append(chunk)
                continue
            self._encoded(run)
            run = [chunk] if _PLAIN(chunk) else []
            if not run:
                self._alone(chunk)
        self._encoded(run)

    def _encoded(self, chunks: list[str]) -> None:
        if not chunks:
            return
        text = "".join(f"\n{c}" for c in chunks)
        a, b = (np.array(t.ids_of(text), np.int64) for t in (self.a, self.b))
        if self._lossless(text, a, b):
            sizes = np.array([len(c.encode()) for c in chunks], np.int64)
            ends = np.cumsum(sizes + 1)
            self._grouped(a, b, ends - sizes, ends)
        else:
            for chunk in chunks:
                self._alone(chunk)

    def _alone(self, chunk: str) -> None:
        a, b = np.array(self.a.ids_of(chunk), np.int64), np.array(self.b.ids_of(f"\n{chunk}")[1:], np.int64)
        if self._lossless(chunk, a, b):
            self._grouped(a, b, np.array([0]), np.array([len(chunk.encode())]))
            return
        self.counts.add(np.array([-1, -1, -1]), np.array([3]))
        self.spelt.append("")
        for held in (self.alike, self.pairs):
            held.add(np.empty(0, np.int64), np.array([0]))

    def _lossless(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        return self.a.joined(a) == self.b.joined(b) == text.encode()

    def _grouped(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Appends a row for each stretch of bytes; a and b are ids of the same bytes."""
        cuts, at_a, at_b = np.intersect1d(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]), assume_unique=True, return_indices=True)
        if not np.isin(np.concatenate([starts[starts > 0], ends]), cuts).all():
            raise ValueError("a token reaches over the edge of a chunk")
        lo, hi = np.searchsorted(cuts, starts, "right"), np.searchsorted(cuts, ends) + 1
        from_a, from_b = (np.concatenate([[0], x[:-1] + 1]) for x in (at_a, at_b))
        a_id, b_id = a[at_a], b[at_b]
        one = (from_a == at_a) & (from_b == at_b) & (self.same[a_id] == b_id)
        self.counts.add(np.stack([at_a[hi - 1] + 1 - from_a[lo], at_b[hi - 1] + 1 - from_b[lo], hi - lo], 1).ravel(), np.full(len(lo), 3))
        spelt = list(map(self.alike_spelt.__getitem__, a_id.tolist()))
        for i in np.flatnonzero(~one).tolist():
            spelt[i] = f"{','.join(map(str, a[from_a[i] : at_a[i] + 1]))}|{','.join(map(str, b[from_b[i] : at_b[i] + 1]))}"
        self.spelt += [";".join(spelt[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        own = gathered(np.arange(len(cuts)), lo, hi - lo)
        ones = np.concatenate([[0], np.cumsum(one)])
        n_one = ones[hi] - ones[lo]
        self.alike.add(a_id[own[one[own]]], n_one)
        odd = own[~one[own]]
        self.pairs.add(a_id[odd] << _SHIFT | b_id[odd], hi - lo - n_one)

    def _cuts(self, characters: np.ndarray) -> np.ndarray:
        """Whether a character starts a chunk: a blank or line feed behind other than white space, what
        follows a line feed that stands alone, and a sign behind a letter if no piece of B has both."""
        known = np.minimum(characters, len(_KINDS) - 1)
        kinds = _KINDS[known]
        space, cut = kinds == _SPACE, np.zeros(len(characters), bool)
        cut[1:] = ((characters[1:] == 32) | (characters[1:] == 10)) & ~space[:-1]
        cut[1:] |= (kinds[:-1] == _LETTER) & (kinds[1:] == _SIGN) & ~self.joins[np.minimum(characters[:-1], 255), np.minimum(characters[1:], 255)]
        cut[2:] |= (characters[1:-1] == 10) & ~space[:-2] & ~space[2:]
        return cut

    def laid(self, texts: list[str]) -> list[pa.Array]:
        """n_a, n_b, n_groups, digest, and as lists: A ids of one-to-one groups and how often each, pairs
        and how often each."""
        full = [" " + t if t else "" for t in texts]
        characters, starts = points(full, "")
        cut = self._cuts(characters)
        cut[starts[[bool(t) for t in texts]]] = True
        codes, chunks = distinct(characters, np.flatnonzero(cut))
        rows = self.known.of(chunks)[codes]  # this may put new arrays in place of the old
        counts = self.counts.take(rows)[0].reshape(-1, 3)
        ends = np.concatenate([[0], np.cumsum(cut)])[np.append(starts, len(characters))]
        n = len(texts)
        doc = np.repeat(np.arange(n), np.diff(ends))
        whole = np.ones(n, bool)
        whole[doc[counts[:, 2] < 0]] = False
        used = whole[doc]
        sums = [np.bincount(doc[used], counts[used, i], n).astype(np.int64) for i in range(3)]
        spelt, digests = list(map(self.spelt.__getitem__, rows.tolist())), []
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            digests.append(hashlib.sha256(";".join(spelt[lo:hi]).encode()).hexdigest() if whole[i] and hi > lo else "")
        lists = [x for held in (self.alike, self.pairs) for x in _histograms(held, rows[used], doc[used], n)]
        return [*map(pa.array, sums), pa.array(digests, pa.string()), *lists]


_SPACE, _LETTER, _SIGN, _ELSE = range(4)


def _kind(c: str) -> int:
    if c.isspace():
        return _SPACE
    return _ELSE if ord(c) > 255 else _LETTER if c.isalpha() else _ELSE if c.isalnum() else _SIGN


#: Of characters: white space of any kind; letters and signs of one byte in Latin-1; anything else.
_KINDS = np.array([_kind(chr(c)) for c in range(0x3001)] + [_ELSE], np.uint8)
_PLAIN = re.compile(r" ?\S+").fullmatch


def _histograms(held: Ragged, rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each document the distinct values of its rows, and how often each stands there."""
    values, sizes = held.take(rows)
    owner = np.repeat(doc, sizes)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(values)))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values[at], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str, ranks: str | None) -> Aligner:
    """One a process, so that chunks stay known from task to task."""
    return Aligner(a_path, b_path, ranks)


_LAID = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, alike array<bigint>, alike_times array<bigint>, pairs array<bigint>, pair_times array<bigint>"


def aligned(docs: DataFrame, a_path: str, b_path: str, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, ...): a row for each of docs, numbered, with its links summed up; a narrow map."""
    kind, key_type = kind_of(docs, key), arrow_type(docs, key)
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"))
    names = ["row", "key", *(c.split()[0] for c in _LAID.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, row = aligner(a_path, b_path, ranks), TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch):
                columns = work.laid(some.column(1).to_pylist())
                numbers = pa.array(np.arange(row, row + len(some)))
                row += len(some)
                yield pa.RecordBatch.from_arrays([numbers, some.column(0).cast(key_type), *columns], names=names)

    return rows.mapInArrow(run, f"row bigint, key {kind}, {_LAID}")


def counted(laid: DataFrame, values: str, times: str) -> DataFrame:
    """(value, n) over all rows: each task sums up first, in one sorted array of what it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            kinds, place = np.unique(value, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(np.bincount(place, n, len(kinds)).astype(np.int64))], names=["value", "n"])

    return laid.select(values, times).mapInArrow(run, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


def added(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of each owner's values; owners come in order."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[np.searchsorted(owner, np.arange(n + 1))])


def vector(counts: DataFrame, size: int) -> np.ndarray:
    """(value, n) as an array as long as a vocabulary."""
    out = np.zeros(size, np.int64)
    rows = counts.toPandas()
    out[rows["value"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def alignment(docs: DataFrame, a_path: str, b_path: str, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the links of
    the corpus: a_id, b_id, n). A link's count is how often its pair is linked in the corpus; ``n_best``
    are links whose count is their B id's highest, ``count_sum`` is the sum of counts over links."""
    spark, held = docs.sparkSession, []
    a, b = byte_level(a_path), sentence_pieces(b_path)
    same = identity(a, b)
    laid = stored(aligned(docs, a_path, b_path, ranks, key, text), "aligned", held)
    alike = vector(counted(laid, "alike", "alike_times"), len(same))
    pairs = stored(counted(laid, "pairs", "pair_times"), "pairs", held)
    b_of = F.col("value").bitwiseAND((1 << _SHIFT) - 1)
    best = vector(pairs.groupBy(b_of.alias("value")).agg(F.max("n").alias("n")), len(b.pieces))
    used = np.flatnonzero(alike)
    np.maximum.at(best, same[used], alike[used])
    tops = spark.createDataFrame(list(enumerate(best.tolist())), "b bigint, top bigint")  # as many as B has ids
    ranked = pairs.join(F.broadcast(tops), b_of == F.col("b")).select("value", "n", (F.col("n") == F.col("top")).alias("is_best"))
    is_top = np.zeros(len(same), bool)
    is_top[used] = alike[used] == best[same[used]]

    # each row of a pair has one of SALTS salts, its count stands under all of them
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = laid.select("row", F.inline(F.arrays_zip("pairs", "pair_times"))).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    met = spread.join(ranked.withColumnRenamed("value", "pairs").withColumn("salt", salts), ["pairs", "salt"])
    odd = met.groupBy("row").agg(F.sum(F.col("pair_times") * F.col("n")).alias("odd_sum"), F.sum(F.when(F.col("is_best"), F.col("pair_times")).otherwise(0)).alias("odd_best"))

    kind = kind_of(laid, "key")
    plain = ("row", "key", "n_a", "n_b", "n_groups", "groups_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, times = batch.column(6), batch.column(7)
            owner = np.repeat(np.arange(len(batch)), ids.value_lengths().to_numpy(zero_copy_only=False))
            ids, times = (c.flatten().to_numpy(zero_copy_only=False) for c in (ids, times))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(added(times * alike[ids], owner, len(batch))), pa.array(added(times * is_top[ids], owner, len(batch)))], names=[*plain, "even_sum", "even_best"])

    even = laid.select(*plain, "alike", "alike_times").mapInArrow(run, f"row bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, even_sum bigint, even_best bigint")
    out = even.join(odd, "row", "left").select(
        F.col("key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        (F.col("even_best") + F.coalesce("odd_best", F.lit(0))).alias("n_best"),
        (F.col("even_sum") + F.coalesce("odd_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
    per_document = stored(out, "alignment")
    ones = spark.createDataFrame([(int(i), int(same[i]), int(alike[i])) for i in used], "a_id bigint, b_id bigint, n bigint")
    links = stored(pairs.select(F.shiftright("value", _SHIFT).alias("a_id"), b_of.alias("b_id"), "n").union(ones), "links")
    released(spark, held)
    return per_document, links


def op12_token_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"), *vocabulary_paths())[0]
