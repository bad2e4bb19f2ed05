"""NumPy kernels over the buffers of Arrow string columns: words, hashes, windows.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f, \\r.  UTF-8 never uses these
inside a character, so bytes suffice.  Texts are worked on whole, a few MB of rows at a time.
"""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels hold at a time (a longer row alone is held whole).
CHUNK = 1 << 20

_U = np.uint64
#: Bytes that are white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_powers: dict[int, np.ndarray] = {}


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on are mapped, so that their memory goes back when they are freed
except OSError:  # another C library: memory stays with the worker
    _libc = None


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


#: What a worker keeps from task to task, by the operator it belongs to: a function that drops it.
kept: dict[str, object] = {}


#: Seconds without a task after which a worker drops what it keeps.
IDLE = 4.0
_timer: list[threading.Timer] = []


def _drop(spared: str | None = None) -> None:
    for other in [k for k in kept if k != spared]:
        kept.pop(other)()
    trim()


def tenant(name: str) -> None:
    """Called when a task begins: what other operators' tasks have kept in this worker goes."""
    while _timer:
        _timer.pop().cancel()
    _drop(name)


def rest() -> None:
    """Called when a task ends: what is kept goes too if no task comes soon."""
    trim()
    if kept and not _timer:
        _timer.append(threading.Timer(IDLE, _drop))
        _timer[0].daemon = True
        _timer[0].start()


class Known:
    """Keys that a task found frequent, each with a value, for the rest of the task.  When it is full no more are learned."""

    def __init__(self, most: int = 1 << 16) -> None:
        self.most, self.keys, self.values = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray, default: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value (else its default), and which keys are known."""
        if not len(self.keys):
            return default.copy(), np.zeros(len(keys), bool)
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[spot] == keys
        return np.where(known, self.values[spot], default), known

    def learn(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not known yet; of one that stands twice the first counts."""
        room = self.most - len(self.keys)
        if len(keys) and room > 0:
            keys, first = np.unique(keys, return_index=True)
            keys, values = keys[:room], values[first[:room]]
            at = np.searchsorted(self.keys, keys)
            self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, CHUNK + 1)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= CHUNK + 1:
            _powers[int(base)] = got
    return got[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``limit`` bytes of ``text``: (rows, bytes, offsets)."""
    try:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
                yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
                at = end
            trim()
    finally:
        rest()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row where its words begin (one entry more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, of the word with A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _TABLE)[data] * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts])


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each run of ``width`` hashes; entry i is of hashes[i : i + width], row ends are the caller's."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    base = _U(seed | 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(mix(hashes ^ base) * powers(base, n), out=sums[1:])
    inverse = _U(pow(int(base), -1, 1 << 64))
    return mix((sums[width:] - sums[:-width]) * powers(inverse, n)[: n - width + 1])


def row_of(pointers: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' first words."""
    return np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
