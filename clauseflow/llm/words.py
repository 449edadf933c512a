"""Texts as runs of characters, found and told apart by whole arrays instead of word by word.

A batch of texts becomes one array of code points; a run's boundaries are places in it; distinct runs
are found by Arrow's dictionary encoding, so what is done for a run in Python is done once a batch for
each distinct run, and once a worker for most. ``Rows`` keeps what is known of a run as ragged arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are worked on at a time, and distinct runs that a worker remembers.
SLICE_CHARS, KNOWN = 1 << 20, 1 << 19


def slices(batch: pa.RecordBatch, text: int = 1, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have ``most`` bytes together, or one row; no session setting
    is needed for that."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def points(texts: list[str], end: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by ``end``, and where each text starts."""
    joined = end.join(texts) + end if texts else ""
    starts = np.cumsum([0, *(len(t) + len(end) for t in texts)])[:-1]
    return np.frombuffer(joined.encode("utf-32-le"), "<u4"), starts


def distinct(characters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For runs that start at the given places: the number of each run's kind, and the kinds' texts."""
    narrow = characters.size == 0 or characters.max() < 256
    data, width = (characters.astype(np.uint8), 1) if narrow else (characters, 4)
    offsets = np.append(starts, characters.size).astype(np.int64) * width
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    found = runs.dictionary_encode()
    kinds = [k.decode("latin-1" if narrow else "utf-32-le") for k in found.dictionary.to_pylist()]
    return found.indices.to_numpy(zero_copy_only=False), kinds


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one behind the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(total)]


class Ragged:
    """Rows of integers of any length, appended in blocks."""

    def __init__(self, kind: str) -> None:
        self.flat, self.used = np.empty(1 << 16, kind), 0
        self.starts, self.sizes, self.rows = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        need, rows = self.used + len(values), self.rows + len(sizes)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while rows > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used : need] = values
        self.starts[self.rows : rows] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.rows : rows] = sizes
        self.used, self.rows = need, rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows one behind the other, sizes)."""
        sizes = self.sizes[rows]
        return gathered(self.flat, self.starts[rows], sizes), sizes


class Rows:
    """A number for each run that a worker knows; ``learn`` is given new runs and appends their rows.

    Beyond ``KNOWN`` runs all are forgotten (``fresh``), which costs time and nothing else.
    """

    def __init__(self, fresh: Callable[[], None], learn: Callable[[list[str]], None], most: int = KNOWN) -> None:
        self.fresh, self.learn, self.most = fresh, learn, most
        self.places: dict[str, int] = {}
        fresh()

    def of(self, kinds: list[str]) -> np.ndarray:
        found = list(map(self.places.get, kinds))
        new = [k for k, place in zip(kinds, found, strict=True) if place is None]
        if new and len(new) + len(self.places) > self.most:
            self.places.clear()
            self.fresh()
            new = kinds
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.learn(new)
            found = list(map(self.places.__getitem__, kinds))
        return np.array(found, np.int64)
