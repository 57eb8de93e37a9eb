"""Texts of a batch as integer codes: split and dictionary-encoded in Arrow, so Python sees each distinct piece once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time within a record batch; what a task holds besides the batch is a multiple of it.
SLICE_BYTES = 1 << 20
#: Distinct pieces, and characters of them, that a table remembers before it begins anew.
LIMIT, LIMIT_CHARACTERS = 500_000, 16_000_000


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``size`` bytes of text each, at least one row a part."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch, null as empty, with 64-bit offsets.

    They are copied: some of Arrow's string kernels misread an array that is a slice of another.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


class Codes:
    """Pieces of every text: ``codes[offsets[i]:offsets[i + 1]]`` index ``uniques``."""

    def __init__(self, lists: pa.Array) -> None:
        flat = lists.flatten().dictionary_encode()
        self.offsets = np.asarray(lists.offsets, np.int64)
        self.offsets = self.offsets - self.offsets[0]
        self.codes = np.asarray(flat.indices, np.int64)
        self.uniques: pa.Array = flat.dictionary

    def drop(self, unwanted: np.ndarray) -> Codes:
        """Without the pieces whose entry in ``unwanted`` (over ``uniques``) is true."""
        keep = ~unwanted[self.codes]
        before = np.concatenate(([0], np.cumsum(keep)))
        self.offsets, self.codes = before[self.offsets], self.codes[keep]
        return self

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """Row of each piece."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per row, the sum of ``values`` (one a piece; columns allowed)."""
        zero = np.zeros((1, *values.shape[1:]), np.result_type(values, np.int64) if values.dtype.kind in "iub" else values.dtype)
        total = np.concatenate((zero, np.cumsum(values, axis=0, dtype=zero.dtype)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def words(texts: pa.Array) -> Codes:
    """Words: the longest runs without blank, tab, line end, vertical tab, form feed or carriage return."""
    found = Codes(pc.ascii_split_whitespace(texts))
    return found.drop(np.asarray(pc.equal(pc.binary_length(found.uniques), 0)))


def lines(texts: pa.Array) -> Codes:
    return Codes(pc.split_pattern(texts, "\n"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers for the places of a window.
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` neighbours in ``values``."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += values[i : i + n] * PLACES[i]
    return mix(out)


class Table:
    """What each distinct piece maps to, as arrays; learnt in batches and bounded in size."""

    def __init__(self, learn: Callable[[list[str]], np.ndarray], limit: int = LIMIT) -> None:
        self.learn, self.limit = learn, limit
        self.index: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self._used = self._characters = 0

    def rows(self, uniques: pa.Array) -> np.ndarray:
        """Values of every piece in ``uniques``."""
        names = uniques.to_pylist()
        if len(self.index) > self.limit or self._characters > LIMIT_CHARACTERS:
            self.index, self.values, self._used, self._characters = {}, None, 0, 0
        index = self.index
        fresh = [p for p in names if p not in index]
        if fresh:
            self._characters += sum(map(len, fresh))
            new = self.learn(fresh)
            if self.values is None:
                self.values = np.empty((max(1 << 16, 2 * len(fresh)), *new.shape[1:]), new.dtype)
            while self._used + len(fresh) > len(self.values):
                self.values = np.concatenate((self.values, np.empty_like(self.values)))
            self.values[self._used : self._used + len(fresh)] = new
            index.update(zip(fresh, range(self._used, self._used + len(fresh)), strict=True))
            self._used += len(fresh)
        at = np.fromiter(map(index.__getitem__, names), np.int64, len(names))
        return self.values[at] if self.values is not None else np.empty(0, np.int64)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: the worker's executor has use for it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:  # glibc keeps freed memory otherwise
        _TRIM(0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What this worker process has learnt under ``key``, for its later tasks.

    Only the last key's is held: operators that follow one another in the same
    workers do not add up their tables.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def in_order(names: list[str], found: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What ``Ragged`` learns, from one array of ids a piece."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return names, sizes, np.concatenate(found) if found else np.zeros(0, np.int32)


class Ragged:
    """Variable-length id sequences of pieces in one growing array, bounded in pieces.

    ``learn`` gives the pieces in an order of its choice, the number of ids of each, and all ids in that order.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = LIMIT) -> None:
        self.learn, self.limit = learn, limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data = np.zeros(0, np.int32)
        self._characters = 0

    def gather(self, coded: Codes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch in order, and the number of ids of each row."""
        names = coded.uniques.to_pylist()
        if len(self.index) > self.limit or self._characters > LIMIT_CHARACTERS:
            self._reset()
        index = self.index
        fresh = [p for p in names if p not in index]
        if fresh:
            self._characters += sum(map(len, fresh))
            learnt, sizes, ids = self.learn(fresh)
            starts = len(self.data) + np.cumsum(sizes) - sizes
            index.update(zip(learnt, range(len(self.starts), len(self.starts) + len(learnt)), strict=True))
            self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))
            self.data = np.concatenate((self.data, ids)).astype(np.int32)
        at = np.fromiter(map(index.__getitem__, names), np.int64, len(names))[coded.codes]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.data[where], coded.sums(sizes)
