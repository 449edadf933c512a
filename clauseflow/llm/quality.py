"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, in a narrow map. Trees are grown on a bounded sample of labelled
rows (``TRAIN_ROWS``, by hash order of the key, so it is the same in every run), with features cut
into histogram bins; the fitted trees are flattened into arrays, and scoring walks all rows of a
batch down each tree at once with numpy. The arrays go to every task; their size is that of the
parameters (trees x nodes), never of the data.

Defined cases: null is empty; an empty text has all-zero statistics and gets a score like any
other; labels that are null are ignored, and of several labels of one key the greatest counts;
without labels of both classes every score is the share of label 1 (0.5 if there are none); a
column that has the name of the score's is replaced by it, all others are passed on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches_of, kind_of, numbered, table, utf8, without

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 10_000, 80, 4, 64, 0.15, 10, 1.0

FEATURES = (
    "bytes", "words", "word_mean", "word_std", "word_max", "distinct_words", "top_word", "top_ten_words", "distinct_pairs",
    "letters", "upper", "digits", "spaces", "marks", "symbols", "high_bytes", "byte_entropy", "run_share",
    "lines", "distinct_lines", "line_mean", "line_std", "marked_line_ends", "marked_word_ends", "odd_word_ends",
    "upper_words", "capital_words", "plain_words", "short_words", "pipes", "sentence_mean",
)

_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = (
        1 if chr(_c).isalpha() and _c < 128 and chr(_c).islower() else 2 if chr(_c).isalpha() and _c < 128 else 3 if 48 <= _c < 58
        else 4 if _c in b" \t\r\n\x0b\x0c" else 5 if _c in b".,;:!?'\"()-" else 7 if _c > 127 else 6
    )


def statistics(text: bytes) -> list[float]:
    """The FEATURES of one text, all of it."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / n
    share = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    common = [c for _, c in Counter(words).most_common(10)] or [0]
    lines = text.split(b"\n")
    widths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = Counter(map(_last, words))
    starts = Counter(map(_first, words))
    odd = sum(c for e, c in ends.items() if _KIND[e] == 6)
    stops = counts[46] + counts[33] + counts[63]
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), sizes.max(), len(set(words)) / w, common[0] / w, sum(common) / w,
        len(set(zip(words, words[1:], strict=False))) / w,
        kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], -(share * np.log2(share)).sum(),
        np.count_nonzero(raw[1:] == raw[:-1]) / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), widths.mean(), widths.std(),
        sum(x[-1:] in _MARKS for x in lines) / len(lines),
        sum(c for e, c in ends.items() if _KIND[e] == 5) / w, odd / w,
        sum(map(bytes.isupper, words)) / w, sum(c for e, c in starts.items() if _KIND[e] == 2) / w, sum(map(bytes.isalpha, words)) / w,
        np.count_nonzero(sizes <= 2) / w, counts[124] / n, w / (stops + 1),
    ]


_MARKS = (b".", b"!", b"?", b":", b";")


def _last(word: bytes) -> int:
    return word[-1]


def _first(word: bytes) -> int:
    return word[0]


class Trees:
    """Boosted trees for logistic loss, as arrays: feature (-1 at a leaf), threshold, value.

    Node i of a tree has children 2 i + 1 (value at or under the threshold) and 2 i + 2.
    """

    def __init__(self, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST_ROWS, ridge: float = RIDGE) -> None:
        self.count, self.depth, self.bins, self.rate, self.least, self.ridge = trees, depth, bins, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.count, nodes), -1, np.int32)
        self.threshold = np.zeros((self.count, nodes))
        self.value = np.zeros((self.count, nodes))
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        self.base = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        codes = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
        at_bin = codes + np.arange(x.shape[1]) * self.bins
        score = np.full(len(y), self.base)
        for tree in range(self.count):
            p = 1 / (1 + np.exp(-score))
            self._grow(tree, codes, at_bin, cuts, y - p, p * (1 - p))
            score += self.value[tree, self._leaves(tree, x)]
        return self

    def _grow(self, tree: int, codes: np.ndarray, at_bin: np.ndarray, cuts: list[np.ndarray], pull: np.ndarray, weight: np.ndarray) -> None:
        shape = (codes.shape[1], self.bins)
        open_nodes = {0: np.arange(len(codes))}
        for level in range(self.depth + 1):
            below: dict[int, np.ndarray] = {}
            for node, rows in open_nodes.items():
                g, h = pull[rows].sum(), weight[rows].sum()
                self.value[tree, node] = self.rate * g / (h + self.ridge)
                if level == self.depth or len(rows) < 2 * self.least:
                    continue
                flat = at_bin[rows].ravel()
                sums = [np.bincount(flat, v, shape[0] * self.bins).reshape(shape).cumsum(axis=1) for v in (np.repeat(pull[rows], shape[0]), np.repeat(weight[rows], shape[0]), None)]
                left_g, left_h, left_n = sums
                gain = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g**2 / (h + self.ridge)
                gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = 0
                f, b = np.unravel_index(gain.argmax(), shape)
                if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                    continue
                self.feature[tree, node], self.threshold[tree, node] = f, cuts[f][b]
                left = codes[rows, f] <= b
                below[2 * node + 1], below[2 * node + 2] = rows[left], rows[~left]
            open_nodes = below

    def _leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            feature = self.feature[tree, node]
            inner = feature >= 0
            node = np.where(inner, 2 * node + 2 - (x[rows, feature] <= self.threshold[tree, node]), node)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        for tree in range(self.count):
            total += self.value[tree, self._leaves(tree, x)]
        return 1 / (1 + np.exp(-total))


def held_out(key: str) -> "F.Column":
    """Whether a row's label may not be learnt: the CRC-32 of its key as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fits trees on at most ``rows`` labelled documents that are not held out."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    sample = marks.orderBy(F.xxhash64("key"), "key").limit(rows)
    picked = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).join(F.broadcast(sample), "key")
    kind = kind_of(picked, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), found], names=["key", "label", "x"])

    batches_of(docs.sparkSession)
    found = picked.select("key", F.col("label").cast("int").alias("label"), "text").mapInArrow(run, f"key {kind}, label int, x array<double>").toArrow()
    order = np.argsort(found.column("key").to_numpy(zero_copy_only=False), kind="stable")
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return Trees().fit(x, found.column("label").to_numpy(zero_copy_only=False).astype(float)[order])


def scored(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """docs with the column ``score`` (double) for every row, from the text alone."""
    kept = without(docs, score)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(at).to_pylist()]
            x = np.array([statistics(t) for t in raw], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=schema.names)

    batches_of(docs.sparkSession)
    schema = StructType([*kept.schema.fields, StructField(score, DoubleType())])
    return numbered(kept).mapInArrow(run, schema)


def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
